"""Chunk stores, tracking tables, index tables and reports on disk.

The chunk store and the tracking table are versioned (``sources.versions``): an incremental
build appends the chunks of changed files and ends the earlier ones, so it writes in proportion
to the change. The other tables are plain Parquet folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chunkloom.functions.text import joined
from chunkloom.sources.versions import VersionedTable

TRACKING = (
    "path string, content_hash string, blob_sha string, commit_sha string, size bigint, "
    "modified_time double, processed_at double, tracking_method string"
)
INDEX_TABLES = [
    "file_level", "file_members", "component_level", "business_level", "ui_level",
    "dependency_level", "api_level", "screen_input_validation_map",
]


# -- plain tables --------------------------------------------------------------------------

def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def table_exists(spark: SparkSession, path: str) -> bool:
    file_system, target = _hadoop(spark, path)
    return file_system.exists(target)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A written table; an absent one is empty when a schema is given."""
    if schema is not None and not table_exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


# -- readers -------------------------------------------------------------------------------

def with_metadata(rows: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Drop stored rows that have no metadata."""
    return rows.filter(F.col(metadata).isNotNull())


def chunk_store(spark: SparkSession, store: str) -> VersionedTable:
    return VersionedTable(spark, store, "project_type", "path", gather=False)


def tracking_table(spark: SparkSession, table: str) -> VersionedTable:
    return VersionedTable(spark, table, "owner", "path")


def load_chunks(spark: SparkSession, store: str) -> DataFrame:
    """All live chunks; rows that name no source carry no metadata and are dropped."""
    return with_metadata(chunk_store(spark, store).read(), "path")


def load_tracking(spark: SparkSession, table: str) -> DataFrame:
    return tracking_table(spark, table).read(f"{TRACKING}, owner string").drop("owner")


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The index tables that exist; missing ones are simply absent."""
    return {
        name: spark.read.parquet(f"{folder}/{name}")
        for name in INDEX_TABLES if table_exists(spark, f"{folder}/{name}")
    }


# -- writers -------------------------------------------------------------------------------

def write_chunks(chunks: DataFrame, store: str, token: str | None = None) -> int:
    """Replace all chunks of the project types present; other project types stay. The new version."""
    return chunk_store(chunks.sparkSession, store).replace(chunks, token)


def replace_sources(store: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Store rows of untouched files plus the new rows of changed ones.

    ``changed(path)`` lists modified, added and deleted files; each loses its old rows.
    """
    kept = store.join(changed.select("path").distinct(), "path", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def merge_chunks(
    spark: SparkSession, store: str, changed: DataFrame, new: DataFrame | None, project_type: str, token: str | None = None
) -> int:
    """Incremental write: the chunks of ``changed(path)`` end, ``new`` ones are added. The store is not read.

    A deleted file is one in ``changed`` without rows in ``new``. With a ``token``, a change that was committed under it
    before is not committed again.
    """
    gone = changed.select(F.lit(project_type).alias("project_type"), "path")
    return chunk_store(spark, store).merge(new, gone, token)


def _tracking_rows(processed: DataFrame) -> DataFrame:
    known = [(c.split()[0], c.split()[1]) for c in TRACKING.split(", ")]
    return processed.select(
        *[(F.col(c) if c in processed.columns else F.lit(None)).cast(t).alias(c) for c, t in known], F.lit("files").alias("owner")
    )


def write_tracking(processed: DataFrame, table: str) -> int:
    """The state of ``processed`` files in place of all earlier ones."""
    return tracking_table(processed.sparkSession, table).replace(_tracking_rows(processed))


def merge_tracking(processed: DataFrame, table: str, deleted: DataFrame | None = None, token: str | None = None) -> int:
    """Upsert: rows of processed files replace or join the old ones; ``deleted(path)`` leave."""
    gone = processed.select("path") if deleted is None else processed.select("path").unionByName(deleted.select("path"))
    return tracking_table(processed.sparkSession, table).merge(
        _tracking_rows(processed), gone.select(F.lit("files").alias("owner"), "path"), token
    )


def relationship_rows(edges: DataFrame) -> DataFrame:
    """One row per file with its distinct dependency tokens, sorted.

    The tokens of a file were cut from its one text, so the list is no larger than the file.
    """
    return edges.select("src", "dep").distinct().groupBy("src").agg(F.sort_array(F.collect_list("dep")).alias("deps"))


def write_relationships(edges: DataFrame, folder: str) -> None:
    relationship_rows(edges).write.mode("overwrite").json(folder)


def sanitize_metadata(df: DataFrame) -> DataFrame:
    """Lists to joined text, structs and maps to JSON text; other non-scalars are dropped."""
    scalar = (T.StringType, T.NumericType, T.BooleanType)
    out: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            out.append(F.array_join(f.name, ", ").alias(f.name))
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            out.append(F.to_json(f.name).alias(f.name))
        elif isinstance(f.dataType, scalar):
            out.append(F.col(f.name))
    clean = df.select(*out)
    if "source" in clean.columns:
        clean = clean.withColumn("source", F.coalesce("source", F.lit("unknown (invalid metadata)")))
    return clean


def write_index(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def index_json(tables: dict[str, DataFrame]) -> DataFrame:
    """The index as JSON lines, ``(level, entry)``: one entry per row, no giant document."""
    lines = [
        t.select(F.lit(name).alias("level"), F.to_json(F.struct(*t.columns)).alias("entry"))
        for name, t in tables.items()
    ]
    out = lines[0]
    for line in lines[1:]:
        out = out.unionByName(line)
    return out


def write_report(results: DataFrame, summary: DataFrame, folder: str) -> None:
    """Evaluation results and their summary as JSON, plus the summary as text lines."""
    results.write.mode("overwrite").json(f"{folder}/results")
    summary.write.mode("overwrite").json(f"{folder}/summary")
    text = F.concat_ws("\n", *[
        F.concat(F.lit(f"{c}: "), F.coalesce(
            F.array_join(c, "; ") if isinstance(summary.schema[c].dataType, T.ArrayType) else F.col(c).cast("string"),
            F.lit("none"),
        ))
        for c in summary.columns
    ])
    summary.select(text.alias("value")).write.mode("overwrite").text(f"{folder}/text")


def export_chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row per chunk with every derived field, ordered by (source, id)."""
    return chunks.select(
        "id", F.col("path").alias("source"), F.col("type").alias("chunk_type"),
        F.length("content").cast("bigint").alias("content_length"),
        F.col("has_semantic_anchors").alias("has_anchors"),
        joined(F.col("class_names")).alias("class_names"),
        joined(F.col("function_names")).alias("function_names"),
        "screen_name",
        joined(F.col("business_logic_indicators")).alias("business_logic"),
        joined(F.col("ui_elements")).alias("ui_elements"),
        joined(F.col("dependencies")).alias("dependencies"),
    ).orderBy("source", "id")
