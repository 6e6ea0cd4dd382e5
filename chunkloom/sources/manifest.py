"""Tracked-file dumps: one ``mode sha stage<TAB>path`` line per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.functions.text import strip, words_of


def parse_manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, blob_sha); lines of another shape are dropped."""
    parts = F.split(F.col(column), "\t", -1)
    head = words_of(F.get(parts, F.lit(0)))
    return (
        lines.filter((strip(F.col(column)) != "") & (F.size(parts) == 2) & (F.size(head) >= 2))
        .select(F.get(parts, F.lit(1)).alias("path"), F.get(head, F.lit(1)).alias("blob_sha"))
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))
