"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash. A bucket heavier than the byte limit is split on one more
bit, and only such buckets are, until every shard fits. Weights are summed over 8 bits at a time: one aggregation
finds every split of those levels, and only rows below a still too heavy entry go on to the next 8 bits. The hash has
two words of 56 bits: one of the keys, then one of the whole row, so that a key with a third of all rows is split too.

Defined cases: a null key is a key of its own; a null text has no bytes; a row heavier than the limit, or equal rows
that no bit tells apart, stay in one shard marked ``oversized``; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.llm.common import written

WORD_BITS = 56
STEP_BITS = 8


def _word(*columns: Column) -> Column:
    """The first 56 bits of a SHA-256 over the columns, each with its length in front."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (x.cast("string") for x in columns)]
    return F.conv(F.substring(F.sha2(F.concat(*parts), 256), 1, WORD_BITS // 4), 16, 10).cast("bigint")


def _bits(depth: int) -> Column:
    """The leading ``depth`` bits of the two words as a text of 0 and 1."""
    def leading(word: str, n: int) -> Column:
        return F.lpad(F.bin(F.shiftright(word, WORD_BITS - n)), n, "0")
    if depth <= WORD_BITS:
        return leading("word_0", depth)
    return F.concat(leading("word_0", WORD_BITS), leading("word_1", depth - WORD_BITS))


def assign_shards(df: DataFrame, keys: list[str], limit: int, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``n_bytes``, ``shard`` (leading bits), ``shard_depth``, ``shard_bytes``, ``oversized``."""
    made = ["n_bytes", "shard", "shard_depth", "shard_bytes", "oversized"]
    others = [c for c in df.columns if c != text and c not in made]
    rows = written(
        df.select(
            *others, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
            _word(*[F.col(k) for k in keys]).alias("word_0"), _word(*[F.col(c) for c in df.columns]).alias("word_1"),
        ), "shard-rows",
    )
    left, start, leaves = rows, 0, []
    while True:
        entry = _bits(start + STEP_BITS)
        # One row per directory entry of these 8 levels, combined on the map side.
        sums = left.groupBy(entry.alias("entry")).agg(F.sum("n_bytes").alias("n_bytes"))
        nodes = (
            sums.select(F.explode(F.sequence(F.lit(start), F.lit(start + STEP_BITS))).alias("depth"), "entry", "n_bytes")
            .groupBy("depth", F.substring(F.col("entry"), F.lit(1), F.col("depth")).alias("node"))
            .agg(F.sum("n_bytes").alias("shard_bytes"))
        )
        directory = written(
            nodes.withColumn("splits", (F.col("shard_bytes") > limit) & (F.lit(start + STEP_BITS) < 2 * WORD_BITS)), "shard-nodes"
        ) if start + STEP_BITS < 2 * WORD_BITS else written(
            nodes.withColumn("splits", (F.col("shard_bytes") > limit) & (F.col("depth") < 2 * WORD_BITS)), "shard-nodes"
        )
        parents = directory.where("splits").select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
        # A leaf fits and hangs below a node that does not; the root of this step is known not to fit, but for the first.
        candidates = directory.where("NOT splits").withColumn(
            "parent", F.substring(F.col("node"), F.lit(1), F.col("depth") - 1)
        )
        found = candidates.join(parents, ["depth", "parent"], "left_semi")
        if start == 0:
            found = found.unionByName(candidates.where("depth = 0"))
        leaves.append((start, found.select("node", "depth", "shard_bytes")))
        heavy = directory.where(F.col("splits") & (F.col("depth") == start + STEP_BITS)).select(F.col("node").alias("heavy"))
        start += STEP_BITS
        if start >= 2 * WORD_BITS or heavy.isEmpty():
            break
        left = written(left.withColumn("heavy", _bits(start)).join(heavy, "heavy", "left_semi").drop("heavy"), "shard-left")
    return _place(rows, leaves, limit, others)


def _place(rows: DataFrame, leaves: list[tuple[int, DataFrame]], limit: int, others: list[str]) -> DataFrame:
    """Each row's leaf: leaves are spread over the directory entries of their step, rows look their entry up."""
    placed = []
    for start, found in leaves:
        top = start + STEP_BITS
        # A leaf of depth d fills 2^(top - d) entries; at most 256 per subtree.
        missing = F.lit(top) - F.col("depth")
        entries = found.select(
            "*", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), missing).cast("int") - 1)).alias("tail"), missing.alias("missing")
        ).select(
            F.concat("node", F.when(F.col("missing") > 0, F.lpad(F.bin("tail"), F.col("missing"), F.lit("0"))).otherwise("")).alias("entry"),
            F.col("node").alias("shard"), F.col("depth").alias("shard_depth"), "shard_bytes",
        )
        placed.append(rows.withColumn("entry", _bits(top)).join(entries, "entry"))
    return reduce(DataFrame.unionByName, placed).select(
        *others, "n_bytes", "shard", F.col("shard_depth").cast("bigint").alias("shard_depth"), "shard_bytes",
        (F.col("shard_bytes") > limit).alias("oversized"),
    )


def write_shards(df: DataFrame, placed: DataFrame, keys: list[str], path: str) -> None:
    """The rows of ``df`` as one folder per shard; ``keys`` tell rows of ``df`` and ``placed`` apart."""
    shard = placed.select(*keys, "shard")
    df.join(shard, keys).repartition("shard").write.partitionBy("shard").parquet(path)
