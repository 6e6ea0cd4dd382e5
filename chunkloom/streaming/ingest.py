"""Incremental ingestion as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkloom.functions import paths
from chunkloom.operators.chunking import cut_files, describe_chunks
from chunkloom.operators.metadata import enrich_chunks
from chunkloom.options import Options
from chunkloom.profiles import Profile
from chunkloom.session import brief_shuffles
from chunkloom.sources import stores
from chunkloom.sources.files import lossy_text, read_text_lossy, scan_files

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, root: str, profile: Profile, project: str = "", files_per_batch: int = 1000) -> DataFrame:
    """New files below ``root`` as a stream of ``(project, path, ext, content, sha256, size, mtime)``.

    Spark's file stream skips names that start with ``_`` or ``.`` and sees no deletes; ``stream_tree`` does.
    """
    glob = "*{" + ",".join(profile.extensions) + "}"
    raw = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(root)
    )
    base = F.lit(root.rstrip("/") if "://" in root or root.startswith("file:") else "file:" + root.rstrip("/"))
    plain = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    relative = paths.relative_path(plain, F.regexp_replace(base, "^file:/+", "file:/"))
    return raw.select(
        F.lit(project).alias("project"), relative.alias("path"), paths.file_ext(relative).alias("ext"),
        F.sha2("content", 256).alias("sha256"), lossy_text(F.col("content")).alias("content"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
    )


def chunk_stream(files: DataFrame, profile: Profile, options: Options = Options()) -> DataFrame:
    """The batch chunk job on a stream: it has no shuffle, so it is a stateless map."""
    return enrich_chunks(describe_chunks(cut_files(files, profile, options), profile), profile, options)


def stream_dedupe(chunks: DataFrame, event_time: str = "mtime", horizon: str = "7 days") -> DataFrame:
    """One chunk per fingerprint within the watermark.

    State is bounded: a copy that comes later than ``horizon`` is kept again, and rows
    behind the watermark are dropped. The batch form has neither limit.
    """
    return chunks.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["fingerprint"])


COMPACT_AFTER = 50


def _merge_files(
    spark: SparkSession, files: DataFrame, deleted: DataFrame | None, store: str, tracking: str, profile: Profile,
    options: Options, compact_after: int,
) -> None:
    """Commits ``files`` and ``deleted(path)`` to the store, then to tracking.

    Tracking is written last, so a change that failed half way is seen again. A commit replaces by path: made twice, with
    whatever the files hold by then, it leaves the store as the later one says.
    """
    chunks = chunk_stream(files, profile, options).withColumn("project_type", F.lit(profile.name))
    gone = files.select("path") if deleted is None else files.select("path").unionByName(deleted.select("path"))
    stores.merge_chunks(spark, store, gone, chunks, profile.name)
    processed = files.select(
        "path", F.col("sha256").alias("content_hash"), "size",
        F.unix_micros("mtime").cast("double").alias("modified_time"),
        F.unix_micros(F.current_timestamp()).cast("double").alias("processed_at"),
        F.lit("content-hash").alias("tracking_method"),
    )
    stores.merge_tracking(processed, tracking, deleted)
    for table in (stores.chunk_store(spark, store), stores.tracking_table(spark, tracking)):
        if len(table.snapshot().commits) > compact_after:
            table.compact()


def stream_merge(
    files: DataFrame, store: str, tracking: str, profile: Profile, checkpoint: str, options: Options = Options(),
    on_batch: Callable[[int], None] | None = None, compact_after: int = COMPACT_AFTER,
) -> StreamingQuery:
    """Merges each micro-batch of files into the store, then into the tracking table.

    A micro-batch writes its own files' chunks and no others; replacing by path makes a repeated one harmless. ``files`` may have a column ``deleted``: true for a path that is no more.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("path").agg(
            F.max_by(F.struct(*[c for c in batch.columns if c != "path"]), "mtime").alias("_f")
        ).select("path", "_f.*").persist()
        try:
            told = "deleted" in latest.columns
            left = latest.filter("deleted IS NOT TRUE").drop("deleted") if told else latest
            deleted = latest.filter("deleted") if told else None
            with brief_shuffles(batch.sparkSession):
                _merge_files(batch.sparkSession, left, deleted, store, tracking, profile, options, compact_after)
        finally:
            latest.unpersist()
        if on_batch is not None:
            on_batch(batch_id)

    return (
        files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def ingest_tree(
    spark: SparkSession, root: str, store: str, tracking: str, profile: Profile, project: str = "", options: Options = Options(),
    keep_dir: Callable[[DataFrame], DataFrame] | None = None, keep_file: Callable[[DataFrame], DataFrame] | None = None,
    compact_after: int = COMPACT_AFTER,
) -> dict[str, int]:
    """One round over a tree: new and changed files (by size and time) go into the store, deleted ones leave it.

    The listing is made in tasks and met with the tracking table by a join, so names that begin with ``_`` or ``.`` count
    and no list of files passes the driver. ``keep_dir`` and ``keep_file`` (listing to listing) hold the ignore rules; a
    file that they begin to refuse is a deleted one. A file that cannot be read keeps its old chunks until it can.
    """
    known = stores.load_tracking(spark, tracking).select("path", F.col("size").alias("_size"), F.col("modified_time").alias("_time"))
    seen: list[DataFrame] = []

    def changed(listing: DataFrame) -> DataFrame:
        kept = listing if keep_file is None else keep_file(listing)
        seen.append(kept.select("path"))
        same = F.col("_size").eqNullSafe(F.col("size")) & F.col("_time").eqNullSafe(F.unix_micros("mtime").cast("double"))
        return kept.join(known, "path", "left").where(~same).drop("_size", "_time")

    raw = scan_files(spark, root, profile.extensions, project, keep_dir, changed).filter("error IS NULL")
    files = read_text_lossy(raw).persist()
    deleted = known.select("path").join(seen[0], "path", "left_anti").persist()
    try:
        counts = {"changed": files.count(), "deleted": deleted.count()}
        if any(counts.values()):
            _merge_files(spark, files, deleted, store, tracking, profile, options, compact_after)
        return counts
    finally:
        files.unpersist()
        deleted.unpersist()


def stream_tree(
    spark: SparkSession, root: str, store: str, tracking: str, profile: Profile, checkpoint: str, every: str = "1 minute",
    on_round: Callable[[dict[str, int]], None] | None = None, **more,
) -> StreamingQuery:
    """``ingest_tree`` again and again, paced by a clock stream; unlike a file stream it sees hidden names, changes and deletes."""
    def round_(_: DataFrame, __: int) -> None:
        counts = ingest_tree(spark, root, store, tracking, profile, **more)
        if on_round is not None:
            on_round(counts)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return clock.writeStream.foreachBatch(round_).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
