"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefixes.

Each distinct (host, path) is expanded into expressions `suffix of the host + prefix of the path`. The expressions meet
the rules in an equi-join on the first hex digits of their SHA-256; the full digest confirms a hit, and the longest
rule wins. Path prefixes are cut only at lengths that rules have. All of it is DataFrame expressions.

Defined cases: a null url, or one without `://`, has an empty host and path and fits no rule; equal rules count once;
of rules of equal length the one with the longer host wins, then block before allow; repeated rows keep their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREFIX_DIGITS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))
    )


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict``. ``rules``: host, path, verdict.

    Spark sends the rules to the executors only where it knows them to be small; a large list is shuffled
    by hash prefix, and each distinct (host, path) goes there once, so a busy host costs one row.
    """
    rows = df.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    expression = F.concat("host", "path")
    known = rules.select("host", "path", "verdict").na.fill("", ["host", "path"]).distinct().select(
        F.sha2(expression, 256).alias("digest"), expression.alias("rule"), F.length("host").alias("host_chars"),
        F.length("path").alias("path_chars"), F.col("verdict").alias("rule_verdict"),
    ).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    # Lengths of rule paths: at most as many as the longest path has characters.
    lengths = [r[0] for r in known.select("path_chars").distinct().orderBy("path_chars").collect()]
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    expanded = (
        rows.select("host", "path").where("host != ''").distinct()
        .select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("suffix"), cuts.alias("cuts"))
        .select("host", "path", "suffix", F.explode("cuts").alias("cut"))
        .select(
            "host", "path", F.length("suffix").alias("suffix_chars"), F.col("cut"),
            F.sha2(F.concat("suffix", F.substring(F.col("path"), F.lit(1), F.col("cut"))), 256).alias("full"),
        )
        .withColumn("prefix", F.substring("full", 1, PREFIX_DIGITS))
    )
    # The digest is of suffix and path run together; equal lengths make the parts equal as well.
    hits = expanded.join(known, "prefix").where("full = digest AND cut = path_chars AND suffix_chars = host_chars")
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(
            F.length("rule").alias("chars"), "host_chars", (F.col("rule_verdict") == "block").alias("blocks"),
            "rule", "rule_verdict",
        )).alias("best")
    )
    return rows.join(best, ["host", "path"], "left").select(
        *[c for c in rows.columns], F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(otherwise)).alias("verdict"),
    )
