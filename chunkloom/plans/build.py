"""Whole jobs: full build, incremental build, answering a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from chunkloom.operators import tracking
from chunkloom.operators.chunking import (
    cut_files, dedupe_chunks, describe_chunks, fingerprint, one_row, recursive_split,
)
from chunkloom.operators.context import best_passages, build_prompts, pack_context
from chunkloom.operators.indexes import build_index
from chunkloom.operators.metadata import enrich_chunks
from chunkloom.operators.questions import analyse_questions
from chunkloom.operators.vectors import topk_search
from chunkloom.options import Options
from chunkloom.profiles import Profile
from chunkloom.session import brief_shuffles, scratch_path, spread
from chunkloom.sources import stores


def build_chunks(
    files: DataFrame, profile: Profile, options: Options = Options(), splitter=recursive_split,
    dedupe: bool = True, tracking_method: str = "content-hash", commit: str | None = None,
) -> DataFrame:
    """``files(path, content)`` to the stored chunk table, duplicates removed."""
    chunks = cut_files(files, profile, options, splitter).withColumn("fingerprint", fingerprint(F.col("content")))
    if dedupe:
        # Copies go before anything else is computed, so the shuffled rows are short.
        chunks = dedupe_chunks(chunks)
    return enrich_chunks(describe_chunks(chunks, profile), profile, options).withColumns({
        "id": F.concat_ws("#", "path", "chunk_index"),
        "project_type": F.lit(profile.name),
        "tracking_method": F.lit(tracking_method),
        "git_commit": F.lit(commit).cast("string"),
    })


def full_build(
    files: DataFrame, profile: Profile, store: str, tracking_table: str | None = None, options: Options = Options(),
    splitter=recursive_split, processed: DataFrame | None = None,
) -> None:
    """Store first, tracking last, so that a failed build is tried again. Tracking knows just these files afterwards.

    ``processed`` are the tracking rows of the files, where they are known already.
    """
    stores.write_chunks(build_chunks(files, profile, options, splitter), store)
    if tracking_table is not None:
        stores.write_tracking(_processed(files) if processed is None else processed, tracking_table)


def _processed(files: DataFrame) -> DataFrame:
    """Tracking rows of files: the hash of the bytes where the reader has taken it, else of the text."""
    known = "sha256" if "sha256" in files.columns else None
    return files.select(
        "path", (F.col(known) if known else F.sha2("content", 256)).alias("content_hash"),
        *[F.col(c) for c in ("size",) if c in files.columns],
        F.unix_micros(F.current_timestamp()).cast("double").alias("processed_at"), F.lit("content-hash").alias("tracking_method"),
    )


def incremental_build(
    spark: SparkSession, store: str, files: DataFrame, new: DataFrame, old: DataFrame, profile: Profile,
    options: Options = Options(), splitter=recursive_split, dedupe: bool = False, tracking_table: str | None = None,
    processed: DataFrame | None = None,
) -> None:
    """Reads only changed files, replaces their chunks, drops chunks of deleted files.

    ``new`` and ``old`` are tracking states ``(path, content_hash)``. Duplicates are removed
    within one run only when asked: a copy kept in an earlier run may have lost its original.
    Tracking, where given, is brought up to date last. ``processed`` are the tracking rows of all files, where they are known already.
    """
    feed = tracking.change_feed(new, old).filter("change <> 'same'").persist()
    try:
        wanted = feed.filter("change <> 'deleted'")
        changed = tracking.only_changed(files, wanted)
        # The store keeps the files that tasks write; few changed files are in few tasks, so their texts are dealt, not the longer chunks.
        chunks = build_chunks(changed.hint("rebalance"), profile, options, splitter, dedupe)
        stores.merge_chunks(spark, store, feed.select("path"), chunks, profile.name)
        if tracking_table is not None:
            told = _processed(changed) if processed is None else tracking.only_changed(processed, wanted)
            stores.merge_tracking(told, tracking_table, feed.filter("change = 'deleted'"))
    finally:
        feed.unpersist()


def run_build(
    spark: SparkSession, files: DataFrame, profile: Profile, store: str, tracking_table: str, index_folder: str | None = None,
    force: bool = False, options: Options = Options(), splitter=recursive_split,
) -> Row:
    """Decides what the state of store and tracking asks for, does it, and returns the decision with what was deleted.

    Nothing stored, nothing tracked or ``force``: everything is built anew. Else the files whose hash differs are built and
    the chunks of deleted ones leave, also if nothing but deletes happened. The index follows the store. Files are hashed once.
    """
    with brief_shuffles(spark):
        return _run_build(spark, files, profile, store, tracking_table, index_folder, force, options, splitter)


def _run_build(
    spark: SparkSession, files: DataFrame, profile: Profile, store: str, tracking_table: str, index_folder: str | None,
    force: bool, options: Options, splitter,
) -> Row:
    chunk_store = stores.chunk_store(spark, store)
    stored = chunk_store.read("path string")
    old = stores.load_tracking(spark, tracking_table).select("path", "content_hash")
    told, folder = _processed(files), scratch_path(spark, "state")
    told.write.option("compression", "zstd").parquet(folder)
    processed = spark.read.schema(told.schema).parquet(folder)
    new = processed.select("path", "content_hash")
    changed = tracking.changed_by_hash(new, old)
    deleted = tracking.deleted_paths(new, old)
    decision = one_row(
        tracking.rebuild_decision(stored, old, changed, force), deleted.agg(F.count(F.lit(1)).alias("n_deleted"))).first()
    if decision.reason in ("forced", "no_database", "no_tracking"):
        full_build(files, profile, store, tracking_table, options, splitter, processed)
    elif decision.rebuild or decision.n_deleted:
        incremental_build(spark, store, files, new, old, profile, options, splitter, tracking_table=tracking_table, processed=processed)
    else:
        return decision
    if index_folder is not None:
        stores.write_index(build_index(stores.load_chunks(spark, store)), index_folder)
    return decision


def answer_batch(
    questions: DataFrame, question_vectors: DataFrame, chunks: DataFrame, profile: Profile, options: Options = Options()
) -> DataFrame:
    """Prompts for a batch of questions.

    ``questions(question_id, question)``, ``question_vectors(query_id, embedding)``,
    ``chunks(vec_id, embedding, ...)`` with the chunk columns; the chunks of a document share its vector.
    """
    analysed = analyse_questions(questions, profile)
    # The search reads its store once per block of questions: it is cut out of the chunks once, and lies over all cores.
    folder = scratch_path(chunks.sparkSession, "documents")
    chunks.select("vec_id", "embedding").dropDuplicates(["vec_id"]).write.parquet(folder)
    documents = spread(chunks.sparkSession.read.schema("vec_id bigint, embedding array<float>").parquet(folder))
    hits = topk_search(question_vectors, documents, options.top_k).join(
        analysed.select("question_id", "question", "intent"), F.col("query_id") == F.col("question_id"))
    rows = best_passages(hits, chunks.drop("embedding"), options.top_k)
    packed = pack_context(rows, options)
    return build_prompts(analysed.join(packed.select("question_id", "context"), "question_id", "left"))
