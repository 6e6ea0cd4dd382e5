"""Which files are left out, and what kind of project a tree is."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chunkloom.functions import paths
from chunkloom.functions.globs import matches_rule
from chunkloom.functions.text import strip
from chunkloom.profiles import Profile, ignore_table, indicator_table

OUTPUT_MARKER = "chunkloom-out"    # anything with this text in its path is our own output


def rules_of_texts(texts: DataFrame) -> DataFrame:
    """``(dir, content)`` of ignore files to ``(dir, rules)``, one row per file.

    Blank lines and lines that start with ``#`` are no rules.
    """
    lines = F.filter(F.split("content", "\r?\n", -1), lambda l: (strip(l) != "") & ~F.startswith(l, F.lit("#")))
    return texts.select("dir", F.transform(lines, strip).alias("rules"))


def gather_ignore_rules(texts: DataFrame, profile: Profile, marker: str = OUTPUT_MARKER) -> DataFrame:
    """All distinct ``(dir, rule)``: ignore files, profile rules, our own output."""
    own = [marker, f"{marker}_*", f"**/{marker}", f"**/{marker}_*"]
    spark = texts.sparkSession
    return (
        rules_of_texts(texts).select("dir", F.explode("rules").alias("rule"))
        .unionByName(ignore_table(spark, profile))
        .unionByName(spark.createDataFrame([("", r) for r in own], "dir string, rule string"))
        .distinct()
    )


def _ignored_paths(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``path`` of candidates that a rule of a directory above them matches.

    Rules of one directory arrive as one array (they come from one small file), so the
    equi-join on the directory adds one row per path and ancestor, not one per rule.
    """
    above = candidates.select("path", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    local = F.when(F.col("dir") == "", F.col("path")).otherwise(
        F.substring(F.col("path"), F.length("dir") + 2, F.length("path"))
    )
    return (
        above.join(rules, "dir")
        .filter(F.exists("rules", lambda rule: matches_rule(local, rule)))
        .select("path").distinct()
    )


def ignore_filter(
    files: DataFrame,
    ignore_texts: DataFrame | None,
    profile: Profile,
    marker: str = OUTPUT_MARKER,
    prune_dirs: bool = True,
) -> DataFrame:
    """Files that no rule matches.

    ``ignore_texts(dir, content)`` holds the ignore files. With ``prune_dirs`` a matched
    directory also takes everything below it, as a walk that never enters it would.
    """
    spark = files.sparkSession
    kept = files.filter(~F.contains("path", F.lit(marker)))
    # Profile rules are a fixed short list, tested on the row without a join.
    for rule in profile.ignore:
        kept = kept.filter(~matches_rule(F.col("path"), F.lit(rule)))
    if ignore_texts is not None:
        rules = rules_of_texts(ignore_texts)
        kept = kept.join(_ignored_paths(kept.select("path"), rules), "path", "left_anti")
    if not prune_dirs:
        return kept

    folders = (
        kept.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).filter("path <> ''").distinct()
    )
    by_profile = folders.filter(
        F.exists(F.lit(list(profile.ignore)) if profile.ignore else F.array().cast("array<string>"),
                 lambda rule: matches_rule(F.col("path"), rule))
    )
    closed = by_profile
    if ignore_texts is not None:
        closed = closed.unionByName(_ignored_paths(folders, rules_of_texts(ignore_texts))).distinct()
    closed = closed.select(F.col("path").alias("dir"))
    below = (
        kept.select("path", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
        .join(closed, "dir", "left_semi").select("path").distinct()
    )
    return kept.join(below, "path", "left_anti")


def detect_project_type(listing: DataFrame, indicators: DataFrame | None = None) -> DataFrame:
    """``listing(project, path)`` to ``(project, project_type)``.

    An indicator may be a file or a directory. The first profile in declared order with an
    indicator present wins; without any the type is ``unknown``.
    """
    indicators = indicators if indicators is not None else indicator_table(listing.sparkSession)
    present = listing.select(
        "project", F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("indicator")
    ).distinct()
    hits = present.join(F.broadcast(indicators), "indicator").groupBy("project").agg(
        F.min_by("project_type", "ord").alias("project_type")
    )
    return (
        listing.select("project").distinct().join(hits, "project", "left")
        .select("project", F.coalesce("project_type", F.lit("unknown")).alias("project_type"))
    )
