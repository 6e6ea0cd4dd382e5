"""Queries over chunking and metadata extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkloom.functions.text import head
from chunkloom.operators.chunking import (
    build_stats, dedupe_chunks, first_meaningful_line, recursive_split,
)
from chunkloom.plans import bridges, oracle as o
from chunkloom.plans.bridges import CODE_RULES
from chunkloom.plans.build import build_chunks
from chunkloom.plans.registry import flat, query


@query("chunk_segments", o.prose("SELECT path, chunk_index, body, chunk_size FROM chunks"))
def chunk_segments(spark, sf):
    return flat(bridges.prose_chunks(spark, sf), "path", "chunk_index", "body", "chunk_size")


@query("chunk_overlap", o.prose(
    "SELECT path, chunk_index, content, has_prev_context, has_next_context, has_context_overlap FROM chunks"))
def chunk_overlap(spark, sf):
    return flat(bridges.prose_chunks(spark, sf), "path", "chunk_index", "content", "has_prev_context",
                "has_next_context", "has_context_overlap")


@query("fingerprints", o.prose("SELECT id, fingerprint FROM chunks"))
def fingerprints(spark, sf):
    return bridges.prose_chunks(spark, sf).select("id", "fingerprint")


@query("chunk_dedupe", o.prose("""SELECT path, chunk_index, fingerprint FROM
  (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY path, chunk_index) AS r FROM chunks) WHERE r = 1"""))
def chunk_dedupe(spark, sf):
    chunks = bridges.prose_chunks(spark, sf).select("path", "chunk_index", "fingerprint")
    return flat(dedupe_chunks(chunks))


@query("build_stats", o.prose("""SELECT (SELECT count(*) FROM documents) AS files_processed,
    count(DISTINCT fingerprint) AS chunks_created, count(*) - count(DISTINCT fingerprint) AS duplicates_skipped,
    (SELECT count(*) FROM (SELECT DISTINCT ON (fingerprint) has_semantic_anchors AS a FROM chunks ORDER BY fingerprint, path, chunk_index) WHERE NOT a) AS anchorless_chunks,
    0::BIGINT AS errors FROM chunks"""))
def stats(spark, sf):
    chunks = bridges.prose_chunks(spark, sf)
    return build_stats(bridges.prose_files(spark, sf), chunks, F.col("has_semantic_anchors"))


@query("generic_split", f"""WITH rest AS (SELECT doc_id AS rid, path, content FROM ({o.PROSE_FILES}) WHERE content <> ''),
  split_ AS (SELECT * FROM ({o.generic_split('rest')}))
  SELECT path, i - 1 AS chunk_index, bodies[i] AS content FROM (SELECT path, bodies, unnest(range(1, len(bodies) + 1)) AS i FROM split_)""")
def generic_split(spark, sf):
    """The fallback splitter over every document."""
    files = bridges.prose_files(spark, sf)
    return files.select("path", F.posexplode(recursive_split(F.col("content"))).alias("chunk_index", "content"))


@query("full_build", o.prose("""SELECT id, path, chunk_index, type, name, summary, fingerprint, has_semantic_anchors,
    nullif(array_to_string(class_names, ', '), '') AS class_names,
    nullif(array_to_string(function_names, ', '), '') AS function_names, 'prose' AS project_type
  FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY path, chunk_index) AS r FROM chunks) WHERE r = 1"""))
def full_build(spark, sf):
    """Every document through the whole job: semantic cut or fallback, duplicates removed, metadata."""
    files = bridges.prose_files(spark, sf).select("path", "content")
    return flat(build_chunks(files, bridges.PROSE), "id", "path", "chunk_index", "type", "name", "summary",
                "fingerprint", "has_semantic_anchors", "class_names", "function_names", "project_type")


@query("first_lines", f"SELECT path, {o.first_line('content')} AS line FROM ({o.PROSE_FILES})")
def first_lines(spark, sf):
    return bridges.prose_files(spark, sf).select("path", first_meaningful_line(F.col("content")).alias("line"))


_PROPERTIES = ["id", "file_type", "type", "name", "class_symbols", "function_symbols", "chunk_hierarchy", "semantic_score", "summary"]
_METADATA = ["id", "screen_name", "component_name", "function_names", "class_names", "dependencies", "input_fields",
             "ui_elements", "validation_rules", "business_logic_indicators", "has_semantic_anchors"]
_LISTS = {"class_symbols", "function_symbols", "function_names", "class_names", "dependencies", "input_fields",
          "ui_elements", "validation_rules", "business_logic_indicators"}


def _select(columns: list[str]) -> str:
    return "SELECT " + ", ".join(f"{o.joined(c)} AS {c}" if c in _LISTS else c for c in columns) + " FROM chunks"


def _register() -> None:
    tables = {"prose": (o.prose, bridges.prose_chunks), "web": (o.web, bridges.web_chunks)}
    for lang, (ext, _, _) in CODE_RULES.items():
        tables[ext] = (
            lambda select, lang=lang: o.code(lang, select),
            lambda spark, sf, lang=lang: bridges.code_chunks(spark, sf, lang),
        )
    for name, (sql, chunks) in tables.items():
        # Types, names, symbols, score, hierarchy, summary of the chunks of one kind of file.
        query(f"chunk_properties_{name}", sql(_select(_PROPERTIES)))(
            lambda spark, sf, chunks=chunks: flat(chunks(spark, sf), *_PROPERTIES))
        # Screens, components, names, dependencies, fields, widgets, rules, indicators.
        query(f"chunk_metadata_{name}", sql(_select(_METADATA)))(
            lambda spark, sf, chunks=chunks: flat(chunks(spark, sf), *_METADATA))


_register()


@query("web_fields", f"""WITH files AS ({o.WEB_FILES}) SELECT path,
  {o.joined(o.sorted_set("regexp_extract_all(content, '[<(][^>]*\\s(?:id|name)=[\"'']([\\w_]+)[\"'']', 1)"))} AS input_fields,
  {o.joined(o.tags([(t, f"contains(lower(content), '{t.lower()}')") for t in bridges.WEB.ui_elements]))} AS ui_elements,
  {o.any_word('lower(content)', bridges.WEB.navigation_words)} AS navigates FROM files""")
def web_fields(spark, sf):
    """Input fields, widgets and navigation of whole pages."""
    from chunkloom.functions.text import contains_any
    from chunkloom.operators.metadata import input_fields, ui_elements

    c = F.col("content")
    return flat(bridges.web_files(spark, sf).select(
        "path", input_fields(c, F.lit("html"), bridges.WEB).alias("input_fields"),
        ui_elements(c, bridges.WEB).alias("ui_elements"),
        contains_any(F.lower(c), bridges.WEB.navigation_words).alias("navigates")))


@query("text_previews", f"SELECT path, substr(content, 1, 10) AS head, {o.preview('content', 200)} AS preview FROM ({o.PROSE_FILES})")
def text_previews(spark, sf):
    from chunkloom.functions.text import preview

    return bridges.prose_files(spark, sf).select(
        "path", head(F.col("content"), 10).alias("head"), preview(F.col("content"), 200).alias("preview"))
