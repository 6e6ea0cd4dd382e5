"""Reports on a chunk table: ``id, path, content, type, metadata columns``.

Everything is a grouped aggregate or a top-k with an explicit tie-break. Lists are compared
in their stored form (joined text), as the store's reports do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from chunkloom.functions import paths
from chunkloom.functions.text import head, joined
from chunkloom.operators.chunking import one_row
from chunkloom.operators.metadata import has_value
from chunkloom.profiles import ANCHORS


def _length() -> Column:
    return F.length("content").cast("bigint")


def _n() -> Column:
    return F.count(F.lit(1))


def _as_text(df: DataFrame, column: str) -> Column:
    return joined(F.col(column)) if dict(df.dtypes)[column].startswith("array<") else F.col(column)


def _percent(part: Column, whole: Column) -> Column:
    return F.round(part.cast("double") * 100.0 / whole, 2)


def _with_share(counts: DataFrame, count: str) -> DataFrame:
    """Adds the percentage of the total to a table of counts that has one row per length
    band or chunk type; the window sees these few rows, never the chunks."""
    total = F.sum(count).over(Window.partitionBy())
    return counts.withColumn("percentage", _percent(F.col(count), total))


# -- filters ---------------------------------------------------------------------------------

def anchorless_chunks(chunks: DataFrame, limit: int | None = 10) -> DataFrame:
    """Chunks without anchors, longest first."""
    out = chunks.filter(~F.col("has_semantic_anchors")).select(
        "id", F.col("path").alias("source"), F.col("type").alias("chunk_type"),
        _length().alias("content_length"), head(F.col("content"), 100).alias("content_preview"),
    )
    return out if limit is None else out.orderBy(F.desc("content_length"), "id").limit(limit)


def anchorless_summaries(chunks: DataFrame) -> DataFrame:
    return chunks.filter(~F.col("has_semantic_anchors")).select(
        "path", "chunk_index", head(F.coalesce("summary", F.lit("")), 80).alias("summary"), *ANCHORS
    )


def short_chunks(chunks: DataFrame, below: int = 50) -> DataFrame:
    return chunks.filter(F.length("content") < below).select(
        "id", F.col("path").alias("source"), F.col("type").alias("chunk_type"),
        _length().alias("content_length"), "content",
    ).orderBy("content_length", "id")


def long_chunks(chunks: DataFrame, above: int = 3000, limit: int = 10) -> DataFrame:
    return chunks.filter(F.length("content") > above).select(
        "id", F.col("path").alias("source"), F.col("type").alias("chunk_type"),
        _length().alias("content_length"), head(F.col("content"), 200).alias("content_preview"),
    ).orderBy(F.desc("content_length"), "id").limit(limit)


def missing_metadata(chunks: DataFrame, limit: int | None = 20) -> DataFrame:
    """Chunks without class, function or screen, labelled with the first that is missing."""
    label = (
        F.when(F.col("class_names").isNull(), "Missing class names")
        .when(F.col("function_names").isNull(), "Missing function names")
        .when(F.col("screen_name").isNull(), "Missing screen name")
    )
    out = chunks.select(
        "id", F.col("path").alias("source"), F.col("type").alias("chunk_type"), label.alias("missing_field")
    ).filter("missing_field is not null")
    return out if limit is None else out.orderBy("source", "id").limit(limit)


def search_content(chunks: DataFrame, words: tuple[str, ...] = ("error", "exception", "null"), limit: int | None = 10) -> DataFrame:
    hit = reduce(lambda a, b: a | b, [F.col("content").ilike(f"%{w}%") for w in words])
    out = chunks.filter(hit).select(
        "id", F.col("path").alias("source"), F.col("type").alias("chunk_type"),
        head(F.col("content"), 150).alias("content_preview"),
    )
    return out if limit is None else out.orderBy("source", "id").limit(limit)


def chunks_of_file(chunks: DataFrame, path: str) -> DataFrame:
    """One file's chunks in order; the filter reaches the scan of a stored table."""
    def number(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0)) if column in chunks.columns else F.lit(0)

    return chunks.filter(F.col("path") == path).select(
        "path", "chunk_index", F.coalesce("type", F.lit("unknown")).alias("type"), "content",
        number("start_line").alias("start_line"), number("end_line").alias("end_line"),
    ).orderBy("chunk_index")


# -- store level -----------------------------------------------------------------------------

def store_overview(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        _n().alias("total_chunks"), F.count_distinct("path").alias("unique_files"),
        F.round(F.avg(_length()), 6).alias("avg_chunk_length"),
        F.min(_length()).alias("min_chunk_length"), F.max(_length()).alias("max_chunk_length"),
    )


def length_band() -> Column:
    return (
        F.when(_length() < 100, "Very Short (<100)").when(_length() < 500, "Short (100-500)")
        .when(_length() < 1000, "Medium (500-1000)").when(_length() < 2000, "Long (1000-2000)")
        .otherwise("Very Long (>2000)")
    )


def length_histogram(chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy(length_band().alias("length_category")).agg(_n().alias("chunk_count"))
    return _with_share(counts, "chunk_count").orderBy(F.desc("chunk_count"), "length_category")


def _file_measures() -> list[Column]:
    return [
        _n().alias("chunk_count"), F.round(F.avg(_length()), 6).alias("avg_chunk_length"),
        F.min(_length()).alias("min_chunk_length"), F.max(_length()).alias("max_chunk_length"),
        F.count_distinct("type").alias("chunk_type_count"),
    ]


def file_chunk_stats(chunks: DataFrame, limit: int | None = 20) -> DataFrame:
    out = chunks.filter("path is not null").groupBy(F.col("path").alias("file_path")).agg(*_file_measures())
    return out if limit is None else out.orderBy(F.desc("chunk_count"), "file_path").limit(limit)


def top_files(chunks: DataFrame, limit: int = 15) -> DataFrame:
    return file_chunk_stats(chunks, limit).select("file_path", "chunk_count", "avg_chunk_length", "chunk_type_count")


def chunk_type_stats(chunks: DataFrame) -> DataFrame:
    """Per type: count, average length, share of all chunks (typed or not)."""
    by_type = chunks.groupBy(F.col("type").alias("chunk_type")).agg(
        _n().alias("count"), F.round(F.avg(_length()), 6).alias("avg_length")
    )
    return _with_share(by_type, "count").filter("chunk_type is not null").orderBy(F.desc("count"), "chunk_type")


def metadata_completeness(chunks: DataFrame) -> DataFrame:
    def filled(column: str) -> Column:
        return F.count_if(F.col(column).isNotNull()) if column in chunks.columns else F.lit(0).cast("bigint")

    return chunks.agg(
        _n().alias("total_chunks"),
        filled("path").alias("has_source"),
        filled("class_names").alias("has_class_names"),
        filled("function_names").alias("has_function_names"),
        filled("screen_name").alias("has_screen_name"),
        filled("business_logic_indicators").alias("has_business_logic"),
        filled("ui_elements").alias("has_ui_elements"),
        filled("dependencies").alias("has_dependencies"),
        filled("api_endpoints").alias("has_api_endpoints"),
        F.count_if("has_semantic_anchors").alias("has_semantic_anchors"),
    )


def sample_metadata(chunks: DataFrame, limit: int = 10) -> DataFrame:
    """A repeatable random sample: rows in the order of a digest of their id."""
    return chunks.filter("path is not null").orderBy(F.md5(F.col("id")), "id").limit(limit).select(
        "id", F.col("path").alias("source"), _as_text(chunks, "class_names").alias("class_names"),
        _as_text(chunks, "function_names").alias("function_names"), "screen_name",
        F.col("type").alias("chunk_type"), F.col("has_semantic_anchors").alias("has_anchors"),
        _length().alias("content_length"),
    )


def sample_embeddings(vectors: DataFrame, limit: int = 10) -> DataFrame:
    digest = F.md5(F.col("id").cast("string"))
    return vectors.orderBy(digest, "id").limit(limit).select(
        "id", F.size("embedding").cast("bigint").alias("embedding_size")
    )


def value_distribution(chunks: DataFrame, column: str, limit: int | None = 20, exploded: bool = False) -> DataFrame:
    """``(value, count)`` of a metadata column, as stored or item by item."""
    value = F.explode(column) if exploded else _as_text(chunks, column)
    out = chunks.select(value.alias("value")).filter("value is not null").groupBy("value").agg(_n().alias("count"))
    return out if limit is None else out.orderBy(F.desc("count"), "value").limit(limit)


def class_distribution(chunks: DataFrame, limit: int = 20) -> DataFrame:
    return value_distribution(chunks, "class_names", limit)


def function_distribution(chunks: DataFrame, limit: int = 20) -> DataFrame:
    return value_distribution(chunks, "function_names", limit)


def indicator_distribution(chunks: DataFrame, limit: int = 15) -> DataFrame:
    return value_distribution(chunks, "business_logic_indicators", limit)


def ui_distribution(chunks: DataFrame, limit: int = 15) -> DataFrame:
    return value_distribution(chunks, "ui_elements", limit)


def anchor_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count_if("has_semantic_anchors").alias("chunks_with_anchors"),
        F.count_if(~F.col("has_semantic_anchors")).alias("chunks_without_anchors"),
        _n().alias("total_chunks"),
    ).withColumn("anchor_percentage", _percent(F.col("chunks_with_anchors"), F.col("total_chunks")))


def semantic_entities(chunks: DataFrame, limit: int = 20) -> DataFrame:
    keys = ["class_names", "function_names", "screen_name"]
    texts = chunks.select(*[_as_text(chunks, k).alias(k) for k in keys])
    present = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in keys])
    return texts.filter(present).groupBy(*keys).agg(_n().alias("count")).orderBy(F.desc("count"), *keys).limit(limit)


def embedding_stats(vectors: DataFrame) -> DataFrame:
    size = F.size("embedding").cast("bigint")
    return vectors.agg(
        _n().alias("total_embeddings"), F.round(F.avg(size), 6).alias("avg_embedding_size"),
        F.min(size).alias("min_embedding_size"), F.max(size).alias("max_embedding_size"),
    )


def distance_histogram(hits: DataFrame, digits: int = 2) -> DataFrame:
    return hits.filter("distance is not null").groupBy(F.round("distance", digits).alias("distance")).agg(
        _n().alias("count")
    ).orderBy("distance")


def extension_stats(chunks: DataFrame) -> DataFrame:
    """Per last four characters of the path."""
    return chunks.filter("path is not null").groupBy(F.substring("path", -4, 4).alias("file_extension")).agg(
        _n().alias("chunk_count"), F.count_distinct("path").alias("file_count"),
        F.round(F.avg(_length()), 6).alias("avg_chunk_length"),
    ).orderBy(F.desc("chunk_count"), "file_extension")


def table_sizes(chunks: DataFrame, vectors: DataFrame, collections: DataFrame) -> DataFrame:
    """Rows and sizes of the chunk, vector and collection tables, stacked."""
    none = F.lit(0).cast("bigint")

    def sized(name: str, df: DataFrame, content: Column, embedding: Column) -> DataFrame:
        return df.agg(
            F.lit(name).alias("table_name"), _n().alias("row_count"),
            content.alias("total_content_size"), embedding.alias("total_embedding_size"),
        )

    return (
        sized("chunks", chunks, F.coalesce(F.sum(_length()), none), none)
        .unionByName(sized("embeddings", vectors, none, F.coalesce(F.sum(F.size("embedding").cast("bigint")), none)))
        .unionByName(sized("collections", collections, none, none))
    )


def file_type_chunks(chunks: DataFrame, suffix: str = ".kt", limit: int | None = 10) -> DataFrame:
    """Files with one suffix: chunk count and their distinct types, concatenated."""
    by_type = chunks.filter(F.endswith("path", F.lit(suffix))).groupBy("path", "type").agg(_n().alias("n"))
    out = by_type.groupBy(F.col("path").alias("file_path")).agg(
        F.sum("n").alias("chunk_count"),
        F.array_join(F.sort_array(F.collect_set("type")), ",").alias("chunk_types"),
    )
    return out if limit is None else out.orderBy(F.desc("chunk_count"), "file_path").limit(limit)


def normalised_hash(content: Column) -> Column:
    bare = F.replace(F.replace(content, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.sha2(F.lower(bare), 256)


def duplicate_content(chunks: DataFrame, limit: int = 10) -> DataFrame:
    """Members of the ``limit`` largest groups of equal normalised text, a row per member.

    A group may hold a third of all chunks, so its sources are never gathered into one
    value: groups are counted first, and the few winning digests select their members.
    """
    hashed = chunks.select("id", F.col("path").alias("source"), normalised_hash(F.col("content")).alias("content_hash"))
    top = (
        hashed.groupBy("content_hash").agg(_n().alias("duplicate_count")).filter("duplicate_count > 1")
        .orderBy(F.desc("duplicate_count"), "content_hash").limit(limit)
    )
    return hashed.join(F.broadcast(top), "content_hash").select("content_hash", "duplicate_count", "source", "id")


def file_export_stats(chunks: DataFrame) -> DataFrame:
    return chunks.filter("path is not null").groupBy(F.col("path").alias("file_path")).agg(
        *_file_measures(),
        F.count_if("has_semantic_anchors").alias("chunks_with_anchors"),
        F.count_if(F.col("class_names").isNotNull()).alias("chunks_with_class_names"),
        F.count_if(F.col("function_names").isNotNull()).alias("chunks_with_function_names"),
    )


def inspect_store(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, rows per file)."""
    per_file = chunks.filter("path is not null").groupBy("path").agg(_n().alias("chunk_count"))
    totals = chunks.agg(_n().alias("total_chunks"), F.count_distinct("path").alias("unique_files"))
    return totals, per_file


def anchor_counts(chunks: DataFrame) -> DataFrame:
    """Rows having each anchor, rows having none, coverage in percent."""
    types = dict(chunks.dtypes)
    filled = {a: has_value(F.col(a), types[a]) for a in ANCHORS}
    any_ = reduce(lambda a, b: a | b, filled.values())
    return chunks.agg(
        *[F.count_if(c).alias(a) for a, c in filled.items()],
        F.count_if(~any_).alias("no_anchors"), _n().alias("total_chunks"),
    ).withColumn("coverage", _percent(F.col("total_chunks") - F.col("no_anchors"), F.col("total_chunks")))


def chunks_per_file(files: DataFrame) -> DataFrame:
    """One row over the file level: average, largest and smallest chunk count, files."""
    return files.agg(
        F.round(F.avg("chunk_count"), 6).alias("avg_chunks"), F.max("chunk_count").alias("max_chunks"),
        F.min("chunk_count").alias("min_chunks"), _n().alias("total_files"),
    )


def chunk_distribution(files: DataFrame) -> DataFrame:
    """Per extension of the file level: files and chunks."""
    return files.groupBy(paths.dotted_ext(F.col("path")).alias("extension")).agg(
        _n().alias("files"), F.sum("chunk_count").alias("total_chunks")
    )


def files_by_extension(listing: DataFrame, supported: tuple[str, ...] = ()) -> DataFrame:
    """Files per extension, most first, and whether the profile reads them."""
    return listing.groupBy(paths.dotted_ext(F.col("path")).alias("extension")).agg(_n().alias("files")).select(
        "extension", "files", F.col("extension").isin(list(supported)).alias("supported")
    ).orderBy(F.desc("files"), "extension")


def file_coverage(listing: DataFrame, indexed: DataFrame) -> DataFrame:
    """Project files against indexed files: totals, covered, missing, percent."""
    both = (
        listing.select("path").distinct().withColumn("project", F.lit(1))
        .join(indexed.select("path").distinct().withColumn("indexed", F.lit(1)), "path", "full")
    )
    return both.agg(
        F.count("project").alias("project_files"), F.count("indexed").alias("indexed_files"),
        F.count_if(F.col("project").isNotNull() & F.col("indexed").isNotNull()).alias("covered"),
        F.count_if(F.col("indexed").isNull()).alias("missing"),
    ).withColumn("coverage", _percent(F.col("covered"), F.col("project_files")))


def missing_files(listing: DataFrame, indexed: DataFrame, limit: int | None = 10) -> DataFrame:
    out = listing.select("path").distinct().join(indexed.select("path").distinct(), "path", "left_anti")
    return out if limit is None else out.orderBy("path").limit(limit)


# -- bundles ---------------------------------------------------------------------------------

def quick_report(chunks: DataFrame) -> dict[str, DataFrame]:
    return {
        "database_info": store_overview(chunks),
        "chunk_distribution": length_histogram(chunks),
        "metadata_completeness": metadata_completeness(chunks),
        "top_files": top_files(chunks, 10),
        "chunk_types": chunk_type_stats(chunks),
    }


def focused_report(kind: str, chunks: DataFrame, vectors: DataFrame, collections: DataFrame) -> dict[str, DataFrame]:
    """One of chunking, metadata, retrieval, performance."""
    if kind == "chunking":
        return {
            "very_short_chunks": short_chunks(chunks), "very_long_chunks": long_chunks(chunks),
            "file_distribution": file_chunk_stats(chunks, 15),
        }
    if kind == "metadata":
        return {
            "missing_metadata": missing_metadata(chunks), "semantic_anchors": anchor_stats(chunks),
            "sample_metadata": sample_metadata(chunks),
        }
    if kind == "retrieval":
        return {"embedding_stats": embedding_stats(vectors), "sample_embeddings": sample_embeddings(vectors)}
    if kind == "performance":
        return {"database_size": table_sizes(chunks, vectors, collections), "file_extensions": extension_stats(chunks)}
    raise ValueError(f"unknown report kind: {kind}")


def full_report(chunks: DataFrame, vectors: DataFrame, collections: DataFrame) -> dict[str, DataFrame]:
    out = quick_report(chunks)
    for kind in ("chunking", "metadata", "retrieval", "performance"):
        out.update(focused_report(kind, chunks, vectors, collections))
    out["semantic_entities"] = semantic_entities(chunks)
    out["file_processing_stats"] = file_chunk_stats(chunks, None)
    return out


def _same_text(field: T.StructField) -> Column:
    """A value as text that does not depend on the engine: six digits after the point, lists joined; ``null``, also for an empty list."""
    value = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = F.format_string("%.6f", value.cast("double"))
        return F.when(F.col(field.name).isNull(), "null").otherwise(value).alias(field.name)
    if isinstance(field.dataType, T.ArrayType):
        value = F.when(F.size(field.name) > 0, F.array_join(field.name, ", "))
    return F.coalesce(value.cast("string"), F.lit("null")).alias(field.name)


def report_rows(report: dict[str, DataFrame], as_text: bool = False) -> DataFrame:
    """A bundle as one table ``(section, row)``, rows as JSON, so it can be stored or hashed.

    With ``as_text`` all values are texts of one form, for comparison with reports made elsewhere.
    """
    parts = [
        df.select(F.lit(name).alias("section"), F.to_json(F.struct(*([_same_text(f) for f in df.schema] if as_text else df.columns))).alias("row"))
        for name, df in report.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def debug_report(chunks: DataFrame, files: DataFrame, tracking: DataFrame) -> DataFrame:
    """One record: stored rows and files, chunks of the index, tracked files, last commit."""
    return one_row(
        chunks.agg(_n().alias("total_chunks"), F.count_distinct("path").alias("unique_files")),
        files.agg(_n().alias("file_count"), F.sum("chunk_count").alias("indexed_chunks")),
        tracking.agg(_n().alias("tracked_files"),
                     F.coalesce(F.max_by("commit_sha", "processed_at"), F.lit("unknown")).alias("last_commit")),
    )


def chunk_overview(chunks: DataFrame, tracking: DataFrame) -> dict[str, DataFrame]:
    totals, per_file = inspect_store(chunks)
    processed = tracking.select("path").distinct()
    return {
        "totals": totals,
        "top_files": per_file.orderBy(F.desc("chunk_count"), "path").limit(10),
        "processed": processed.orderBy("path").limit(10),
        "processed_rest": processed.agg(F.greatest(_n() - 10, F.lit(0).cast("bigint")).alias("more_files")),
        "anchors": anchor_counts(chunks),
    }


def index_panel(chunks: DataFrame, files: DataFrame, listing: DataFrame) -> dict[str, DataFrame]:
    from chunkloom.operators.indexes import missing_rows

    anchorless = anchorless_summaries(chunks)
    return {
        "anchorless_total": anchorless.agg(_n().alias("anchorless")),
        "anchorless_first": anchorless.orderBy("path", "chunk_index").limit(20),
        "files_first": files.select("path", "chunk_count", "file_type").orderBy("path").limit(5),
        "missing_first": missing_rows(chunks).filter("level = 'missing_files'").orderBy("path", "chunk_index").limit(5),
        "extensions": files_by_extension(listing),
    }


def canned_queries(chunks: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """Nine one-line looks at a store."""
    return {
        "row_count": chunks.agg(_n().alias("n")),
        "distinct_sources": chunks.agg(F.count_distinct("path").alias("n")),
        "length_stats": store_overview(chunks).select("avg_chunk_length", "min_chunk_length", "max_chunk_length"),
        "chunks_per_file": file_chunk_stats(chunks, 10).select("file_path", "chunk_count"),
        "types": chunk_type_stats(chunks).select("chunk_type", "count"),
        "anchors": anchor_stats(chunks).select("total_chunks", "chunks_with_anchors"),
        "extensions": extension_stats(chunks).select("file_extension", "chunk_count"),
        "embedding_size": embedding_stats(vectors).select("avg_embedding_size"),
        "sample": sample_metadata(chunks, 5).select("id", "source", "content_length"),
    }
