"""Session logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: the layout of a log line, ``[LEVEL] time file:line message``.
LOG_LINE = r"^\[(\w+)\] (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:[,.]\d+)?) ([^\s:]+):(\d+) (.*)$"


def parse_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds level, ts, file, line and message; lines of another shape are dropped."""
    line = F.col(column)

    def part(group: int):
        return F.regexp_extract(line, LOG_LINE, group)

    return lines.filter(line.rlike(LOG_LINE)).withColumns({
        "level": part(1),
        "ts": F.to_timestamp(F.replace(part(2), F.lit(","), F.lit("."))),
        "file": part(3),
        "line": part(4).cast("int"),
        "message": part(5),
    }).drop(column)


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.log`` files below a folder, with the name of the file each line came from."""
    lines = (
        spark.read.option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").text(folder)
        .select("value", F.col("_metadata.file_name").alias("log_file"))
    )
    return parse_logs(lines)
