"""What changed since the last run, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.operators.chunking import one_row
from chunkloom.sources.stores import TRACKING


def file_hash(raw: Column) -> Column:
    """SHA-256 of the bytes, hexadecimal."""
    return F.sha2(raw, 256)


def change_feed(new: DataFrame, old: DataFrame, key: str = "content_hash") -> DataFrame:
    """``(path, change)`` with change in added, modified, deleted, same; one full outer join."""
    n = new.select("path", F.col(key).alias("_new"), F.lit(True).alias("_in_new"))
    o = old.select("path", F.col(key).alias("_old"), F.lit(True).alias("_in_old"))
    change = (
        F.when(F.col("_in_old").isNull(), "added")
        .when(F.col("_in_new").isNull(), "deleted")
        .when(~F.col("_new").eqNullSafe(F.col("_old")), "modified")
        .otherwise("same")
    )
    return n.join(o, "path", "full").select("path", change.alias("change"))


def changed_by_hash(new: DataFrame, old: DataFrame) -> DataFrame:
    """Paths to process: new ones and ones whose hash differs (all, without a prior map)."""
    return change_feed(new, old).filter(F.col("change").isin("added", "modified")).select("path")


def deleted_paths(new: DataFrame, old: DataFrame) -> DataFrame:
    return change_feed(new, old).filter("change = 'deleted'").select("path")


def changed_by_commit(
    manifest: DataFrame, prior: DataFrame, working_tree: DataFrame, current_commit: str, last_commit: str | None
) -> DataFrame:
    """Paths to process in commit mode, no duplicates.

    Without a prior commit all tracked files count. Files changed in the working tree are
    always included, also when the commit did not move.
    """
    if last_commit is None:
        return manifest.select("path").distinct()
    edited = working_tree.select("path")
    if last_commit == current_commit:
        return edited.distinct()
    differs = change_feed(manifest, prior, "blob_sha").filter(F.col("change").isin("added", "modified"))
    return differs.select("path").union(edited).distinct()


def tracking_status(manifest: DataFrame, tracking: DataFrame) -> DataFrame:
    """One row: the tracking method and either the latest commit or the number of files."""
    tracked = manifest.agg(F.count(F.lit(1)).alias("manifest_files"))
    prior = tracking.agg(
        F.count(F.lit(1)).alias("files"), F.max_by("commit_sha", "processed_at").alias("last_commit")
    )
    by_commit = F.col("manifest_files") > 0
    return one_row(tracked, prior).select(
        F.when(by_commit, "git").otherwise("content-hash").alias("tracking_method"),
        F.when(by_commit, F.col("last_commit")).alias("current_commit"),
        F.when(~by_commit, F.col("files")).alias("file_count"),
    )


def rebuild_decision(store: DataFrame, tracking: DataFrame, changed: DataFrame, force: bool = False) -> DataFrame:
    """One row ``(rebuild, reason, n_files)``; the file list is ``changed`` itself.

    The list is not collected into the row: it may hold every file of the corpus.
    """
    counts = one_row(
        store.limit(1).agg(F.count(F.lit(1)).alias("stored")),
        tracking.limit(1).agg(F.count(F.lit(1)).alias("tracked")),
        changed.agg(F.count(F.lit(1)).alias("changed")),
    )
    reason = (
        F.when(F.lit(force), "forced")
        .when(F.col("stored") == 0, "no_database")
        .when(F.col("tracked") == 0, "no_tracking")
        .when(F.col("changed") > 0, "files_changed")
        .otherwise("no_changes")
    )
    return counts.select(
        (reason != "no_changes").alias("rebuild"), reason.alias("reason"),
        F.when(reason == "files_changed", F.col("changed")).when(reason == "no_changes", F.lit(0))
        .cast("bigint").alias("n_files"),
    )


def tracking_merge(old: DataFrame, processed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Upsert: rows of processed files replace or join the old ones; deleted files leave."""
    columns = [c.split()[0] for c in TRACKING.split(", ") if c.split()[0] in old.columns]
    values = [c for c in columns if c != "path"]
    n = processed.select("path", F.struct(*[F.col(c) if c in processed.columns else F.lit(None).alias(c) for c in values]).alias("_new"))
    o = old.select("path", F.struct(*values).alias("_old"))
    merged = o.join(n, "path", "full")
    if deleted is not None:
        merged = merged.join(deleted.select("path").distinct(), "path", "left_anti")
    pick = F.col("_new").isNotNull()
    return merged.select(
        "path", *[F.when(pick, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in values]
    )


def only_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The files an incremental build has to read."""
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def processed_files(tracking: DataFrame) -> DataFrame:
    return tracking.select("path").distinct().orderBy("path")
