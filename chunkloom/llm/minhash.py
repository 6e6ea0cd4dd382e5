"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets form a class, whose smallest id stands for it. Signatures of the classes are cut into
bands. Classes that share a band value are candidates: each with the leader (smallest id) of the bucket first, and in
buckets that are not yet one component afterwards, members of different components with each other. Candidates
compare their signatures batch by batch; a pair is pruned once the posterior probability that its similarity reaches
the limit falls below the miss probability. What is left is confirmed on full shingle sets.

Rows per band are chosen so that a pair at the limit shares no band with a probability below ``BAND_MISS``.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; rows with a null
id take no part and stay with a null component; rows with one id count as one document; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb

from pyspark.sql import DataFrame, functions as F

from chunkloom.llm.common import dropped, written
from chunkloom.llm.graph import joined_components, star_components
from chunkloom.llm.hashing import shingles

HASHES = 150
BATCH = 25
BAND_MISS = 1e-7
MISS = 1e-9
# Buckets of three and more members, as (key, leader) rows, are shipped to the executors up to this number.
BROADCAST_ROWS = 500_000
# Members of a cluster that one task holds of each of its two chunks.
CHUNK = 1000

_SIGNATURE = "id bigint, n_shingles bigint, set_key binary, bands array<bigint>, signature binary"


def band_rows(limit: float, hashes: int = HASHES, miss: float = BAND_MISS) -> int:
    """The most rows per band with which a pair of similarity ``limit`` is missed by all bands rarely enough."""
    return max(r for r in range(1, hashes + 1) if r == 1 or (1 - limit ** r) ** (hashes // r) <= miss)


@lru_cache(maxsize=8)
def least_matches(limit: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> tuple[int, ...]:
    """After each batch of n hashes, the fewest matches m with P(similarity >= limit | m of n) >= miss.

    With an even prior the posterior is a Beta(m + 1, n - m + 1); its upper tail is P(Binomial(n + 1, limit) <= m).
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * limit ** m * (1 - limit) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def signatures(df: DataFrame, size: int, limit: float, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Set size, key of the whole set, band keys and signature (16 bits a hash) of every row that has an id."""
    rows = band_rows(limit)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        made = np.random.Generator(np.random.PCG64(97))
        times = made.integers(0, 1 << 64, HASHES, dtype="uint64") | np.uint64(1)
        plus = made.integers(0, 1 << 64, HASHES, dtype="uint64")
        count = HASHES // rows
        turns = made.integers(0, 1 << 64, (count, rows), dtype="uint64") | np.uint64(1)
        for batch in batches:
            sets = shingles(batch.column("text"), size)
            least = np.zeros((len(sets), HASHES), "uint64")
            for i, one in enumerate(sets):
                if len(one):
                    least[i] = reduce(np.minimum, (
                        (times[:, None] * one[None, a:a + 512] + plus[:, None]).min(axis=1) for a in range(0, len(one), 512)
                    ))
            # Each band gets its own multipliers, so equal values in different bands do not meet.
            cut = least[:, :count * rows].reshape(len(sets), count, rows)
            bands = ((cut ^ (cut >> np.uint64(29))) * turns).sum(axis=2, dtype="uint64")
            bands ^= bands >> np.uint64(32)
            short = ((least >> np.uint64(16)) & np.uint64(0xFFFF)).astype("uint16")
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([b if len(s) else [] for b, s in zip(bands.view("int64"), sets)], pa.list_(pa.int64())),
                pa.array([s.tobytes() for s in short], pa.binary()),
            ], names=["id", "n_shingles", "set_key", "bands", "signature"])

    return df.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, _SIGNATURE)


def likely(pairs: DataFrame, signed: DataFrame, limit: float) -> DataFrame:
    """Of ``pairs`` (a, b) those that no batch of their signatures prunes."""
    least = least_matches(limit)

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "uint16").reshape(-1, HASHES) for c in ("sa", "sb")
            )
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, "int64")
            for step, fewest in enumerate(least):
                part = slice(step * BATCH, (step + 1) * BATCH)
                matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
                keep = matches >= fewest
                alive, matches = alive[keep], matches[keep]
                if not len(alive):
                    break
            if len(alive):
                yield batch.select(["a", "b"]).take(alive)

    one = signed.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    two = signed.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _full_sets(size: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = shingles(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([s.view("int64") for s in sets], pa.list_(pa.int64()))], names=["id", "full"]
            )
    return run


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of ``pairs`` those with 100 * intersection >= percent * union of the full sets. ``texts``: id, text."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    sets = texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(_full_sets(size), "id bigint, full array<bigint>")
    sets = written(sets.dropDuplicates(["id"]), "shingle-sets")
    both = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("full").alias("fa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("full").alias("fb")), "b")
        .withColumn("common", F.size(F.array_intersect("fa", "fb")))
    )
    out = written(both.where(100 * F.col("common") >= percent * (F.size("fa") + F.size("fb") - F.col("common"))).select("a", "b"), "links")
    dropped(sets)
    return out


def _links_across(open_members: DataFrame, heads: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between labels of different components among ``open_members`` (band, id, label), enough to join what belongs together.

    Members that share bands form clusters. A cluster is dealt into chunks, and every two chunks meet in one task, which
    compares signatures and full sets and gives links only, never the pairs it looked at.
    """
    hubs = open_members.groupBy("band").agg(F.min("id").alias("a"))
    clusters = star_components(open_members.join(hubs, "band").select("a", F.col("id").alias("b")))
    members = open_members.select("id", "label").distinct().join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")
    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")).withColumnRenamed("component", "cluster")
    dealt = written(members.join(sizes, "cluster").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int")), "dealt-members")
    sets = texts.join(dealt.select("id"), "id", "left_semi").select("id", "text").mapInArrow(_full_sets(size), "id bigint, full array<bigint>").dropDuplicates(["id"])
    whole = written(dealt.join(heads.select("id", "signature"), "id").join(sets, "id"), "open-sets")
    twice = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "cluster", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "id", "label", "chunk", "signature", "full"
    )
    least = least_matches(percent / 100)

    def link(rows):
        import numpy as np
        import pyarrow as pa

        named, chunks = (rows.column(c).to_numpy() for c in ("label", "chunk"))
        labels = named.copy()
        signed = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "uint16").reshape(-1, HASHES)
        full = [s.values.to_numpy() for s in rows.column("full")]
        counts = np.array([len(s) for s in full])
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        left, right = np.flatnonzero(chunks == low), np.flatnonzero(chunks == high)
        found: list[tuple[int, int]] = []
        for x in left.tolist():
            some = right if low != high else right[right > x]
            some = some[(labels[some] != labels[x]) & (100 * np.minimum(counts[some], counts[x]) >= percent * np.maximum(counts[some], counts[x]))]
            matches = np.zeros(len(some), "int64")
            for step, fewest in enumerate(least):
                part = slice(step * BATCH, (step + 1) * BATCH)
                matches = matches + (signed[some, part] == signed[x, part]).sum(axis=1)
                some, matches = some[matches >= fewest], matches[matches >= fewest]
                if not len(some):
                    break
            for y in some.tolist():
                if labels[y] == labels[x]:
                    continue
                common = len(np.intersect1d(full[x], full[y], assume_unique=True))
                if 100 * common >= percent * (counts[x] + counts[y] - common):
                    found.append((named[x], named[y]))
                    labels[labels == labels[y]] = labels[x]
        return pa.Table.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    out = written(twice.groupBy("cluster", "low", "high").applyInArrow(link, "a bigint, b bigint").distinct(), "links-across")
    dropped(dealt, whole)
    return out


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links), ``kept``."""
    limit = percent / 100
    base = df.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    signed = written(signatures(base, size, limit, "id"), "signatures")
    classes = written(
        signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "set-classes"
    )
    heads = written(
        signed.join(classes.select(F.col("first").alias("id")), "id", "left_semi").where("n_shingles > 0").dropDuplicates(["id"]), "set-heads"
    )
    texts = base.where("id IS NOT NULL")
    banded = heads.select("id", F.explode("bands").alias("band"))
    buckets = written(
        banded.groupBy("band").agg(F.min("id").alias("leader"), F.max("id").alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1"), "band-buckets"
    )
    large = buckets.where("n > 2").select("band", "leader")
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    members = written(banded.join(large, "band"), "band-members")
    stars = (
        buckets.where("n = 2").select(F.col("leader").alias("a"), F.col("other").alias("b"))
        .unionByName(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))).distinct()
    )
    candidates = written(likely(stars, heads, limit), "likely-pairs")
    # Leaders are the smallest ids of their buckets: a < b, and b has at most one leader per band.
    labels = star_components(confirmed(candidates, texts, size, percent))
    dropped(buckets, candidates)
    # Buckets that are not one component yet: what differs is compared directly. Leaders have met everyone.
    labelled = written(
        members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"), "labelled-members"
    )
    dropped(members)
    mixed = labelled.where("id <> leader").groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    open_members = written(labelled.where("id <> leader").join(mixed, "band", "left_semi").select("band", "id", "label"), "open-members")
    if not open_members.isEmpty():
        labels = joined_components(labels, _links_across(open_members, heads, texts, size, percent))
    dropped(labelled, open_members, heads)
    named = classes.join(labels.withColumnRenamed("node", "first"), "first", "left").select(
        "set_key", F.coalesce("component", "first").alias("component")
    ).join(classes.select("set_key", "n", "first"), "set_key").where("n > 1 OR component <> first").select("set_key", "component")
    rows = signed.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key"))
    found = rows.join(named, "set_key", "left").select(
        F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id")
    )
    nameless = base.where("id IS NULL").select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id")
    )
    return found.unionByName(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
