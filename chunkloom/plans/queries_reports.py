"""Queries of the diagnostic suite over the chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkloom.operators import diagnostics as d
from chunkloom.operators.indexes import file_level
from chunkloom.plans import bridges, oracle as o
from chunkloom.plans.registry import ORACLES, flat, query
from chunkloom.plans.queries_sources import _tracked
from chunkloom.session import scratch_path

L = "length(content)"
BAND = f"""CASE WHEN {L} < 100 THEN 'Very Short (<100)' WHEN {L} < 500 THEN 'Short (100-500)'
  WHEN {L} < 1000 THEN 'Medium (500-1000)' WHEN {L} < 2000 THEN 'Long (1000-2000)' ELSE 'Very Long (>2000)' END"""
MEASURES = f"""count(*) AS chunk_count, round(avg({L}), 6) AS avg_chunk_length, min({L}) AS min_chunk_length,
  max({L}) AS max_chunk_length, count(DISTINCT type) AS chunk_type_count"""
SHARE = "round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2)::DOUBLE"
OVERVIEW = f"""SELECT count(*) AS total_chunks, count(DISTINCT path) AS unique_files, round(avg({L}), 6) AS avg_chunk_length,
  min({L}) AS min_chunk_length, max({L}) AS max_chunk_length FROM chunks"""
CLASSES, FUNCTIONS = o.joined("class_names"), o.joined("function_names")


def chunks(spark, sf):
    return bridges.prose_chunks(spark, sf)


def stored_chunks(spark, sf):
    """The chunks without their bodies, made once and written to the shared folder: a bundle reads them once per section."""
    folder = scratch_path(spark, "report-chunks")
    made = chunks(spark, sf).drop("body")
    made.write.parquet(folder)
    return spark.read.schema(made.schema).parquet(folder)


def stored_vectors(spark, sf):
    return bridges.vectors(spark, sf).withColumnRenamed("vec_id", "id")


# -- filters ---------------------------------------------------------------------------------

@query("has_anchor", o.prose("SELECT id, has_semantic_anchors FROM chunks"))
def has_anchor(spark, sf):
    return chunks(spark, sf).select("id", "has_semantic_anchors")


@query("anchorless_chunks", o.prose(f"""SELECT id, path AS source, type AS chunk_type, {L} AS content_length,
  substr(content, 1, 100) AS content_preview FROM chunks WHERE NOT has_semantic_anchors ORDER BY {L} DESC, id LIMIT 10"""))
def anchorless(spark, sf):
    return d.anchorless_chunks(chunks(spark, sf))


@query("anchorless_summaries", o.prose("""SELECT path, chunk_index, substr(summary, 1, 80) AS summary FROM chunks WHERE NOT has_semantic_anchors"""))
def anchorless_summaries(spark, sf):
    return flat(d.anchorless_summaries(chunks(spark, sf)), "path", "chunk_index", "summary")


@query("short_chunks", f"""WITH t AS (SELECT path, unnest(string_split(content, {o.NL})) AS content, unnest(range(1, len(string_split(content, {o.NL})) + 1)) AS i FROM ({o.PROSE_FILES}))
  SELECT path || '#' || i AS id, path AS source, 'line' AS chunk_type, {L} AS content_length, content FROM t WHERE {L} < 50""")
def short_chunks(spark, sf):
    """Lines of the documents as chunks: every line below 50 characters."""
    lines = bridges.prose_files(spark, sf).select(
        "path", F.posexplode(F.split("content", "\n", -1)).alias("i", "content")).select(
        F.concat_ws("#", "path", F.col("i") + 1).alias("id"), "path", F.lit("line").alias("type"), "content")
    return d.short_chunks(lines)


@query("long_chunks", o.prose(f"""SELECT id, path AS source, type AS chunk_type, {L} AS content_length,
  substr(content, 1, 200) AS content_preview FROM chunks WHERE {L} > 3000 ORDER BY {L} DESC, id LIMIT 10"""))
def long_chunks(spark, sf):
    return d.long_chunks(chunks(spark, sf))


@query("missing_metadata", o.prose("""SELECT id, path AS source, type AS chunk_type,
  CASE WHEN len(class_names) = 0 THEN 'Missing class names' WHEN len(function_names) = 0 THEN 'Missing function names' ELSE 'Missing screen name' END AS missing_field
  FROM chunks WHERE len(class_names) = 0 OR len(function_names) = 0 OR screen_name IS NULL"""))
def missing_metadata(spark, sf):
    return d.missing_metadata(chunks(spark, sf), None)


@query("missing_metadata_first", o.prose("""SELECT id, path AS source, type AS chunk_type,
  CASE WHEN len(class_names) = 0 THEN 'Missing class names' WHEN len(function_names) = 0 THEN 'Missing function names' ELSE 'Missing screen name' END AS missing_field
  FROM chunks WHERE len(class_names) = 0 OR len(function_names) = 0 OR screen_name IS NULL ORDER BY path, id LIMIT 20"""))
def missing_metadata_first(spark, sf):
    return d.missing_metadata(chunks(spark, sf))


@query("search_content", o.prose("""SELECT id, path AS source, type AS chunk_type, substr(content, 1, 150) AS content_preview FROM chunks
  WHERE content ILIKE '%token%' OR content ILIKE '%licensed%' OR content ILIKE '%null%' ORDER BY path, id LIMIT 10"""))
def search_content(spark, sf):
    return d.search_content(chunks(spark, sf), ("token", "licensed", "null"))


@query("chunks_of_file", o.prose("""SELECT path, chunk_index, type, content, 0::BIGINT AS start_line, 0::BIGINT AS end_line FROM chunks WHERE path = 'src1/1.en'"""))
def chunks_of_file(spark, sf):
    return flat(d.chunks_of_file(chunks(spark, sf), "src1/1.en"))


# -- store level -----------------------------------------------------------------------------

@query("store_overview", o.prose(OVERVIEW))
def store_overview(spark, sf):
    return d.store_overview(chunks(spark, sf))


@query("length_histogram", o.prose(f"SELECT {BAND} AS length_category, count(*) AS chunk_count, {SHARE} AS percentage FROM chunks GROUP BY 1"))
def length_histogram(spark, sf):
    return d.length_histogram(chunks(spark, sf))


@query("file_chunk_stats", o.prose(f"SELECT path AS file_path, {MEASURES} FROM chunks GROUP BY path ORDER BY chunk_count DESC, path LIMIT 20"))
def file_chunk_stats(spark, sf):
    return d.file_chunk_stats(chunks(spark, sf))


@query("file_chunk_stats_all", o.prose(f"SELECT path AS file_path, {MEASURES} FROM chunks GROUP BY path"))
def file_chunk_stats_all(spark, sf):
    return d.file_chunk_stats(chunks(spark, sf), None)


@query("chunk_type_stats", o.prose(f"SELECT type AS chunk_type, count(*) AS count, round(avg({L}), 6) AS avg_length, {SHARE} AS percentage FROM chunks GROUP BY 1"))
def chunk_type_stats(spark, sf):
    return d.chunk_type_stats(chunks(spark, sf))


@query("metadata_completeness", o.prose("""SELECT count(*) AS total_chunks, count(path) AS has_source,
  count(*) FILTER (len(class_names) > 0) AS has_class_names, count(*) FILTER (len(function_names) > 0) AS has_function_names,
  count(screen_name) AS has_screen_name, count(*) FILTER (len(business_logic_indicators) > 0) AS has_business_logic,
  count(*) FILTER (len(ui_elements) > 0) AS has_ui_elements, count(*) FILTER (len(dependencies) > 0) AS has_dependencies,
  0::BIGINT AS has_api_endpoints, count(*) FILTER (has_semantic_anchors) AS has_semantic_anchors FROM chunks"""))
def metadata_completeness(spark, sf):
    return d.metadata_completeness(chunks(spark, sf))


@query("sample_metadata", o.prose(f"""SELECT id, path AS source, {CLASSES} AS class_names, {FUNCTIONS} AS function_names, screen_name,
  type AS chunk_type, has_semantic_anchors AS has_anchors, {L} AS content_length FROM chunks ORDER BY md5(id), id LIMIT 10"""))
def sample_metadata(spark, sf):
    return d.sample_metadata(chunks(spark, sf))


@query("sample_embeddings", "SELECT vec_id AS id, len(embedding) AS embedding_size FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 10")
def sample_embeddings(spark, sf):
    return d.sample_embeddings(stored_vectors(spark, sf))


def _distribution(value: str, limit: int, unnested: bool = False) -> str:
    e = f"unnest({value})" if unnested else o.joined(value)
    return o.prose(f"""SELECT value, count(*) AS count FROM (SELECT {e} AS value FROM chunks) WHERE value IS NOT NULL
      GROUP BY value ORDER BY count DESC, value LIMIT {limit}""")


@query("class_distribution", _distribution("class_names", 20))
def class_distribution(spark, sf):
    return d.class_distribution(chunks(spark, sf))


@query("class_distribution_items", o.prose("SELECT value, count(*) AS count FROM (SELECT unnest(class_names) AS value FROM chunks) GROUP BY value"))
def class_distribution_items(spark, sf):
    return d.value_distribution(chunks(spark, sf), "class_names", None, exploded=True)


@query("function_distribution", _distribution("function_names", 20))
def function_distribution(spark, sf):
    return d.function_distribution(chunks(spark, sf))


@query("indicator_distribution", _distribution("business_logic_indicators", 15))
def indicator_distribution(spark, sf):
    return d.indicator_distribution(chunks(spark, sf))


@query("ui_distribution", _distribution("ui_elements", 15))
def ui_distribution(spark, sf):
    return d.ui_distribution(chunks(spark, sf))


ANCHOR_STATS = """SELECT count(*) FILTER (has_semantic_anchors) AS chunks_with_anchors, count(*) FILTER (NOT has_semantic_anchors) AS chunks_without_anchors,
  count(*) AS total_chunks, round(count(*) FILTER (has_semantic_anchors) * 100.0::DOUBLE / count(*), 2) AS anchor_percentage FROM chunks"""


@query("anchor_stats", o.prose(ANCHOR_STATS))
def anchor_stats(spark, sf):
    return d.anchor_stats(chunks(spark, sf))


@query("semantic_entities", o.prose(f"""SELECT {CLASSES} AS class_names, {FUNCTIONS} AS function_names, screen_name, count(*) AS count FROM chunks
  WHERE len(class_names) > 0 OR len(function_names) > 0 OR screen_name IS NOT NULL GROUP BY 1, 2, 3
  ORDER BY count DESC, class_names NULLS FIRST, function_names NULLS FIRST, screen_name NULLS FIRST LIMIT 20"""))
def semantic_entities(spark, sf):
    return d.semantic_entities(chunks(spark, sf))


@query("embedding_stats", """SELECT count(*) AS total_embeddings, round(avg(len(embedding)), 6) AS avg_embedding_size,
  min(len(embedding)) AS min_embedding_size, max(len(embedding)) AS max_embedding_size FROM embeddings""")
def embedding_stats(spark, sf):
    return d.embedding_stats(stored_vectors(spark, sf))


@query("extension_stats", o.prose(f"""SELECT right(path, 4) AS file_extension, count(*) AS chunk_count, count(DISTINCT path) AS file_count,
  round(avg({L}), 6) AS avg_chunk_length FROM chunks GROUP BY 1"""))
def extension_stats(spark, sf):
    return d.extension_stats(chunks(spark, sf))


@query("top_files", o.prose(f"""SELECT path AS file_path, count(*) AS chunk_count, round(avg({L}), 6) AS avg_chunk_length,
  count(DISTINCT type) AS chunk_type_count FROM chunks GROUP BY path ORDER BY chunk_count DESC, path LIMIT 15"""))
def top_files(spark, sf):
    return d.top_files(chunks(spark, sf))


@query("table_sizes", o.prose(f"""SELECT 'chunks' AS table_name, count(*) AS row_count, sum({L})::BIGINT AS total_content_size, 0::BIGINT AS total_embedding_size FROM chunks
  UNION ALL SELECT 'embeddings', count(*), 0, sum(len(embedding))::BIGINT FROM embeddings
  UNION ALL SELECT 'collections', count(DISTINCT source), 0, 0 FROM documents"""))
def table_sizes(spark, sf):
    collections = bridges.table(spark, sf, "documents").select("source").distinct()
    return d.table_sizes(chunks(spark, sf), stored_vectors(spark, sf), collections)


@query("file_type_chunks", o.all_code("""SELECT path AS file_path, count(*) AS chunk_count, string_agg(DISTINCT type, ',' ORDER BY type) AS chunk_types
  FROM chunks WHERE path LIKE '%.kt' GROUP BY path ORDER BY chunk_count DESC, path LIMIT 10"""))
def file_type_chunks(spark, sf):
    return d.file_type_chunks(bridges.all_code_chunks(spark, sf))


@query("file_type_chunks_all", o.all_code("""SELECT path AS file_path, count(*) AS chunk_count, string_agg(DISTINCT type, ',' ORDER BY type) AS chunk_types
  FROM chunks WHERE path LIKE '%.js' GROUP BY path"""))
def file_type_chunks_all(spark, sf):
    return d.file_type_chunks(bridges.all_code_chunks(spark, sf), ".js", None)


@query("duplicate_content", o.prose("""SELECT content_hash, duplicate_count, source, id FROM (
    SELECT *, dense_rank() OVER (ORDER BY duplicate_count DESC, content_hash) AS r FROM (
      SELECT sha256(lower(replace(replace(content, ' ', ''), chr(10), ''))) AS content_hash, path AS source, id,
        count(*) OVER (PARTITION BY sha256(lower(replace(replace(content, ' ', ''), chr(10), '')))) AS duplicate_count FROM chunks)
    WHERE duplicate_count > 1) WHERE r <= 10"""))
def duplicate_content(spark, sf):
    return d.duplicate_content(chunks(spark, sf))


@query("file_export_stats", o.prose(f"""SELECT path AS file_path, {MEASURES}, count(*) FILTER (has_semantic_anchors) AS chunks_with_anchors,
  count(*) FILTER (len(class_names) > 0) AS chunks_with_class_names, count(*) FILTER (len(function_names) > 0) AS chunks_with_function_names
  FROM chunks GROUP BY path"""))
def file_export_stats(spark, sf):
    return d.file_export_stats(chunks(spark, sf))


@query("inspect_store", o.prose("SELECT path, count(*) AS chunk_count FROM chunks GROUP BY path"))
def inspect_store(spark, sf):
    return d.inspect_store(chunks(spark, sf))[1]


@query("anchor_counts", o.prose("""SELECT count(screen_name) AS screen_name, count(*) FILTER (len(class_names) > 0) AS class_names,
  count(*) FILTER (len(function_names) > 0) AS function_names, count(component_name) AS component_name,
  count(*) FILTER (NOT has_semantic_anchors) AS no_anchors, count(*) AS total_chunks,
  round(count(*) FILTER (has_semantic_anchors) * 100.0::DOUBLE / count(*), 2) AS coverage FROM chunks"""))
def anchor_counts(spark, sf):
    return d.anchor_counts(chunks(spark, sf))


@query("chunks_per_file", o.prose("""SELECT round(avg(n), 6) AS avg_chunks, max(n) AS max_chunks, min(n) AS min_chunks, count(*) AS total_files
  FROM (SELECT count(*) AS n FROM chunks GROUP BY path)"""))
def chunks_per_file(spark, sf):
    return d.chunks_per_file(file_level(chunks(spark, sf)))


@query("chunk_distribution", o.prose(f"""SELECT {o.dotted_ext('path')} AS extension, count(*) AS files, sum(n)::BIGINT AS total_chunks
  FROM (SELECT path, count(*) AS n FROM chunks GROUP BY path) GROUP BY 1"""))
def chunk_distribution(spark, sf):
    return d.chunk_distribution(file_level(chunks(spark, sf)))


@query("files_by_extension", f"""SELECT {o.dotted_ext('path')} AS extension, count(*) AS files, {o.dotted_ext('path')} IN ('.en', '.fr') AS supported
  FROM ({o.PROSE_FILES}) GROUP BY 1""")
def files_by_extension(spark, sf):
    return d.files_by_extension(bridges.prose_files(spark, sf), (".en", ".fr"))


@query("file_coverage", o.prose("""SELECT (SELECT count(*) FROM documents) AS project_files, count(DISTINCT path) AS indexed_files,
  count(DISTINCT path) AS covered, (SELECT count(*) FROM documents) - count(DISTINCT path) AS missing,
  round(count(DISTINCT path) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 2) AS coverage FROM chunks"""))
def file_coverage(spark, sf):
    return d.file_coverage(bridges.prose_files(spark, sf), chunks(spark, sf))


@query("missing_files", o.prose(rf"""SELECT path FROM ({o.PROSE_FILES}) WHERE path NOT IN (
  SELECT path FROM chunks WHERE regexp_extract(path, '/(\d+)\.', 1)::BIGINT IN (SELECT doc_id FROM labels))"""))
def missing_files(spark, sf):
    """Files without a chunk in the index of the older snapshot, which knew the labelled documents only."""
    labelled = bridges.table(spark, sf, "labels").select("doc_id")
    return d.missing_files(bridges.prose_files(spark, sf), chunks(spark, sf).join(labelled, "doc_id", "left_semi"), None)


# -- bundles -----------------------------------------------------------------------------------

def _sections(report):
    """Section and row of a bundle."""
    return d.report_rows(report, as_text=True)


def _row(name: str, select: str, columns: str) -> str:
    """Rows of a section; ``columns`` in their order, marked ``:d`` for a number with a fraction, ``:l`` for a list."""
    def text(column: str) -> str:
        name, _, kind = column.partition(":")
        value = f"printf('%.6f', {name})" if kind == "d" else f"nullif(array_to_string({name}, ', '), '')" if kind == "l" else f"CAST({name} AS VARCHAR)"
        return f"'{name}', coalesce({value}, 'null')"
    return f"SELECT '{name}' AS section, CAST(json_object({', '.join(map(text, columns.split()))}) AS VARCHAR) AS row FROM ({select})"


def _known(name: str) -> str:
    """The SQL of a registered query, without its chunk table."""
    return ORACLES[name].removeprefix(o.prose(""))


def _bundle(*rows: str) -> str:
    return o.prose(" UNION ALL ".join(rows))


_FILE = "file_path chunk_count avg_chunk_length:d min_chunk_length max_chunk_length chunk_type_count"
_BY_COUNT = "FROM chunks GROUP BY path ORDER BY chunk_count DESC, path LIMIT"
_CUT = "SELECT id, path AS source, type AS chunk_type, length(content) AS content_length"
_QUICK = (
    _row("database_info", OVERVIEW, "total_chunks unique_files avg_chunk_length:d min_chunk_length max_chunk_length"),
    _row("chunk_distribution", _known("length_histogram"), "length_category chunk_count percentage:d"),
    _row("metadata_completeness", _known("metadata_completeness"), "total_chunks has_source has_class_names has_function_names has_screen_name has_business_logic "
         "has_ui_elements has_dependencies has_api_endpoints has_semantic_anchors"),
    _row("top_files", f"SELECT path AS file_path, {MEASURES} {_BY_COUNT} 10", "file_path chunk_count avg_chunk_length:d chunk_type_count"),
    _row("chunk_types", _known("chunk_type_stats"), "chunk_type count avg_length:d percentage:d"),
)
_CHUNKING = (
    _row("very_short_chunks", f"{_CUT}, content FROM chunks WHERE {L} < 50", "id source chunk_type content_length content"),
    _row("very_long_chunks", _known("long_chunks"), "id source chunk_type content_length content_preview"),
    _row("file_distribution", f"SELECT path AS file_path, {MEASURES} {_BY_COUNT} 15", _FILE),
)
_META = (
    _row("missing_metadata", _known("missing_metadata_first"), "id source chunk_type missing_field"),
    _row("semantic_anchors", ANCHOR_STATS, "chunks_with_anchors chunks_without_anchors total_chunks anchor_percentage:d"),
    _row("sample_metadata", _known("sample_metadata"), "id source class_names function_names screen_name chunk_type has_anchors content_length"),
)
_RETRIEVAL = (
    _row("embedding_stats", _known("embedding_stats"), "total_embeddings avg_embedding_size:d min_embedding_size max_embedding_size"),
    _row("sample_embeddings", _known("sample_embeddings"), "id embedding_size"),
)
_PERF = (
    _row("database_size", _known("table_sizes"), "table_name row_count total_content_size total_embedding_size"),
    _row("file_extensions", _known("extension_stats"), "file_extension chunk_count file_count avg_chunk_length:d"),
)


@query("quick_report", _bundle(*_QUICK))
def quick_report(spark, sf):
    return _sections(d.quick_report(stored_chunks(spark, sf)))


def _focused(kind: str):
    def run(spark, sf):
        collections = bridges.table(spark, sf, "documents").select("source").distinct()
        return _sections(d.focused_report(kind, stored_chunks(spark, sf) if kind != "retrieval" else chunks(spark, sf), stored_vectors(spark, sf), collections))
    return run


for _kind, _parts in (("chunking", _CHUNKING), ("metadata", _META), ("retrieval", _RETRIEVAL), ("performance", _PERF)):
    query(f"focused_report_{_kind}", _bundle(*_parts))(_focused(_kind))


@query("full_report", _bundle(
    *_QUICK, *_CHUNKING, *_META, *_RETRIEVAL, *_PERF, _row("semantic_entities", _known("semantic_entities"), "class_names function_names screen_name count"),
    _row("file_processing_stats", f"SELECT path AS file_path, {MEASURES} FROM chunks GROUP BY path", _FILE)))
def full_report(spark, sf):
    collections = bridges.table(spark, sf, "documents").select("source").distinct()
    return _sections(d.full_report(stored_chunks(spark, sf), stored_vectors(spark, sf), collections))


@query("debug_report", o.prose("""SELECT count(*) AS total_chunks, count(DISTINCT path) AS unique_files, count(DISTINCT path) AS file_count,
  count(*) AS indexed_chunks, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS tracked_files, 'c1' AS last_commit FROM chunks"""))
def debug_report(spark, sf):
    c = stored_chunks(spark, sf)
    return d.debug_report(c, file_level(c), _tracked(bridges.snapshots(spark, sf)[1], "c1", 1.0))


_OLD = "SELECT DISTINCT path FROM (" + o.PROSE_FILES + ") JOIN labels USING (doc_id) WHERE quality IS NOT NULL"


@query("chunk_overview", _bundle(
    _row("totals", "SELECT count(*) AS total_chunks, count(DISTINCT path) AS unique_files FROM chunks", "total_chunks unique_files"),
    _row("top_files", f"SELECT path, count(*) AS chunk_count {_BY_COUNT} 10", "path chunk_count"),
    _row("processed", f"{_OLD} ORDER BY path LIMIT 10", "path"),
    _row("processed_rest", f"SELECT greatest(count(*) - 10, 0) AS more_files FROM ({_OLD})", "more_files"),
    _row("anchors", _known("anchor_counts"), "screen_name class_names function_names component_name no_anchors total_chunks coverage:d")))
def chunk_overview(spark, sf):
    return _sections(d.chunk_overview(stored_chunks(spark, sf), bridges.snapshots(spark, sf)[1]))


_BARE = "FROM chunks WHERE NOT has_semantic_anchors"


@query("index_panel", _bundle(
    _row("anchorless_total", f"SELECT count(*) AS anchorless {_BARE}", "anchorless"),
    _row("anchorless_first", f"""SELECT path, chunk_index, substr(summary, 1, 80) AS summary, screen_name, class_names, function_names, component_name
      {_BARE} ORDER BY path, chunk_index LIMIT 20""", "path chunk_index summary screen_name class_names:l function_names:l component_name"),
    _row("files_first", "SELECT path, count(*) AS chunk_count, arg_min(file_type, chunk_index) AS file_type FROM chunks GROUP BY path ORDER BY path LIMIT 5",
         "path chunk_count file_type"),
    _row("missing_first", "SELECT 'missing_files' AS level, path, chunk_index FROM chunks WHERE path IS NULL", "level path chunk_index"),
    _row("extensions", f"SELECT {o.dotted_ext('path')} AS extension, count(*) AS files, false AS supported FROM ({o.PROSE_FILES}) GROUP BY 1",
         "extension files supported")))
def index_panel(spark, sf):
    c = stored_chunks(spark, sf)
    return _sections(d.index_panel(c, file_level(c), bridges.prose_files(spark, sf)))


@query("canned_queries", _bundle(
    _row("row_count", "SELECT count(*) AS n FROM chunks", "n"), _row("distinct_sources", "SELECT count(DISTINCT path) AS n FROM chunks", "n"),
    _row("length_stats", OVERVIEW, "avg_chunk_length:d min_chunk_length max_chunk_length"),
    _row("chunks_per_file", f"SELECT path AS file_path, count(*) AS chunk_count {_BY_COUNT} 10", "file_path chunk_count"),
    _row("types", _known("chunk_type_stats"), "chunk_type count"), _row("anchors", ANCHOR_STATS, "total_chunks chunks_with_anchors"),
    _row("extensions", _known("extension_stats"), "file_extension chunk_count"), _row("embedding_size", _known("embedding_stats"), "avg_embedding_size:d"),
    _row("sample", f"{_CUT} FROM chunks ORDER BY md5(id), id LIMIT 5", "id source content_length")))
def canned_queries(spark, sf):
    return _sections(d.canned_queries(stored_chunks(spark, sf), stored_vectors(spark, sf)))
