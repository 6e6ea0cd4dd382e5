"""Embedding, exact and approximate nearest neighbours, dimension checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    IDF, BucketedRandomProjectionLSH, HashingTF, Normalizer, RegexTokenizer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkloom.session import scratch_path
from chunkloom.sources.stores import read_table as read_written

HITS = "query_id bigint, vec_id bigint, distance double"


# -- embedding -------------------------------------------------------------------------------

def _model_stages(column: str, dims: int) -> list:
    return [
        RegexTokenizer(inputCol=column, outputCol="_words", pattern=r"\W+", minTokenLength=1),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]


def text_model(texts: DataFrame, column: str = "content", dims: int = 256):
    """Fits term hashing with inverse document frequencies; the model has ``dims`` weights."""
    return Pipeline(stages=_model_stages(column, dims)).fit(texts)


def embed_texts(texts: DataFrame, model) -> DataFrame:
    """Adds ``embedding``, a unit-length vector per text, with a fitted ``text_model``."""
    scratch = ["_words", "_tf", "_tfidf", "_unit"]
    return model.transform(texts).withColumn("embedding", vector_to_array("_unit", "float32")).drop(*scratch)


def embed_with(function: Callable[[list[str]], list[list[float]]], text: Column) -> Column:
    """Hook for a user's own model: ``function`` gets a batch of texts, returns their vectors."""
    @F.pandas_udf("array<float>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.asarray(v, dtype="float32") for v in function(batch.tolist())])

    return apply(text)


def write_text_index(chunks: DataFrame, folder: str, dims: int = 256) -> None:
    """Fits one text model on the chunks and keeps it with their vectors, so that questions are embedded as the store was.

    ``chunks(id, content)``; a chunk without words gets a vector of zeros. The model is written first: an index without
    vectors is empty, one without a model cannot be. Texts are made and cut into words once: weights and vectors come from
    their written counts.
    """
    spark = chunks.sparkSession
    texts = chunks.select("id", F.coalesce("content", F.lit("")).alias("content"))
    words, hashed, weights, unit = _model_stages("content", dims)
    counts = hashed.transform(words.transform(texts)).select(F.monotonically_increasing_id().alias("vec_id"), "id", "_tf")
    path = scratch_path(spark, "term-counts")
    counts.write.parquet(path)
    counted = spark.read.schema(counts.schema).parquet(path)
    fitted = weights.fit(counted)
    PipelineModel([words, hashed, fitted, unit]).write().overwrite().save(f"{folder}/model")
    embedded = unit.transform(fitted.transform(counted)).withColumn("embedding", vector_to_array("_unit", "float32"))
    embedded.select("vec_id", "id", "embedding").write.mode("overwrite").parquet(f"{folder}/vectors")


def text_search(questions: DataFrame, folder: str, k: int, within: float = np.inf) -> DataFrame:
    """``query_id, id, distance, rank``: the k nearest chunks of a text index per ``questions(query_id, content)``.

    All hits up to the distance ``within`` are there; farther ones need not be.
    """
    spark = questions.sparkSession
    model = PipelineModel.load(f"{folder}/model")
    store = spark.read.schema("vec_id bigint, id string, embedding array<float>").parquet(f"{folder}/vectors")
    asked = embed_texts(questions.select("query_id", F.coalesce("content", F.lit("")).alias("content")), model)
    return topk_search(asked, store, k, within=within).join(store.select("vec_id", "id"), "vec_id").select("query_id", "id", "distance", "rank")


def check_dimensions(vectors: DataFrame) -> DataFrame:
    """``(dimension, n, matches)``: vectors per length against the most frequent length."""
    counts = vectors.groupBy(F.size("embedding").cast("bigint").alias("dimension")).agg(F.count(F.lit(1)).alias("n"))
    # One row per distinct length: a handful.
    usual = F.max_by("dimension", F.struct(F.col("n"), -F.col("dimension"))).over(Window.partitionBy())
    return counts.select("dimension", "n", (F.col("dimension") == usual).alias("matches"))


# -- exact search ----------------------------------------------------------------------------

def _nearest(ids: np.ndarray, points: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k nearest points per query by squared L2, ties by id: (query row, point id, distance).

    Candidates come from one matrix product; their distances are then summed term by term,
    so the order does not depend on how the points were batched.
    """
    rough = (points ** 2).sum(axis=1)[None, :] - 2.0 * (queries @ points.T)
    slack = 1e-9 * (1.0 + np.abs(rough).max(axis=1, initial=0.0))
    rows, picked, distances = [], [], []
    for q in range(len(queries)):
        if len(ids) > k:
            limit = np.partition(rough[q], k - 1)[k - 1]
            near = np.flatnonzero(rough[q] <= limit + slack[q])
        else:
            near = np.arange(len(ids))
        exact = np.zeros(len(near))
        difference = points[near] - queries[q]
        for d in range(points.shape[1]):
            exact += difference[:, d] ** 2
        best = np.lexsort((ids[near], exact))[:k]
        rows.append(np.full(len(best), q))
        picked.append(ids[near][best])
        distances.append(exact[best])
    return np.concatenate(rows), np.concatenate(picked), np.concatenate(distances)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64") if len(column) else np.empty((0, 0))


def _keep_best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


# Store vectors that centres are taken from, centres, bytes of one block of queries, queries compared at a time.
SAMPLE_ROWS = 4096
CENTRES = 32
BLOCK_BYTES = 32 << 20
QUERY_ROWS = 2048


def topk_search(
    queries: DataFrame, store: DataFrame, k: int, block_bytes: int = BLOCK_BYTES, within: float = np.inf
) -> DataFrame:
    """Exact k nearest store vectors per query: ``query_id, vec_id, distance, rank``.

    ``queries(query_id, embedding)``, ``store(vec_id, embedding)``; squared L2, ties by id. Vectors are compared with
    vectors of their own length; null ones with none. The store is scanned where it lies, once per block of queries of
    at most ``block_bytes``; a task parts what it reads by the nearest of a few centres, and a query skips a part when
    the triangle inequality shows that nothing in it can be among its k nearest. Tasks answer with k rows per query.
    Who needs only hits up to the distance ``within`` says so: farther ones may then be missing, nearer ones never are.
    """
    hits = _search(queries, store, k, block_bytes, within).where("query_id IS NOT NULL")
    return _keep_best(hits, k)


def search_pruning(queries: DataFrame, store: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row: how many times a query met a part of the store (``pairs``), and how many of them were ``skipped`` unread."""
    met = _search(queries, store, k, block_bytes).where("query_id IS NULL")
    return met.agg(F.coalesce(F.sum("vec_id"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("distance").cast("bigint"), F.lit(0)).alias("skipped"))


def _search(queries: DataFrame, store: DataFrame, k: int, block_bytes: int, within: float = np.inf) -> DataFrame:
    """Hits of all blocks, and per task one row without a query id that counts parts met and skipped."""
    spark = store.sparkSession
    folder = scratch_path(spark, "search")
    asked = queries.where("embedding IS NOT NULL").select("query_id", "embedding", F.size("embedding").alias("dims"))
    lengths = asked.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()     # distinct lengths: a handful
    for length in lengths:
        own = store.where(F.size("embedding") == length.dims).select("vec_id", "embedding")
        sample = np.array([r.embedding for r in own.limit(SAMPLE_ROWS).collect()], dtype="float64")
        centres = sample[:: max(1, len(sample) // CENTRES)][:CENTRES]
        known = spark.sparkContext.broadcast((sample, centres))
        blocks = max(1, -(-length.n * (8 * length.dims + 24) // block_bytes))
        dealt = f"{folder}-queries-{length.dims}"
        (
            asked.where(F.col("dims") == length.dims)
            .mapInPandas(_bounded(known, k, within), "query_id bigint, embedding array<float>, bound double")
            .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
            .write.partitionBy("block").parquet(dealt)
        )
        for block in range(blocks):
            # At most a block of queries is on the driver at a time; the blocks are even, since they are dealt by hash.
            part = spark.read.schema("query_id bigint, embedding array<float>, bound double, block int").parquet(dealt).where(F.col("block") == block)
            rows = part.select("query_id", "embedding", "bound").collect()
            if rows:
                shipped = spark.sparkContext.broadcast((
                    np.array([r.query_id for r in rows], dtype="int64"), np.array([r.embedding for r in rows], dtype="float64"),
                    np.array([r.bound for r in rows], dtype="float64"),
                ))
                own.mapInPandas(_scan(shipped, known, k), HITS).write.mode("append").parquet(folder)
                shipped.unpersist()
        known.unpersist()
    return read_written(spark, folder, HITS)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, by a matrix product: rough in the last digits."""
    return np.maximum((a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _bounded(known, k: int, within: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Queries with an upper bound of the distances they need: their k-th within a sample of the store, and ``within``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample, _ = known.value
        for batch in batches:
            bounds = np.full(len(batch), np.inf)
            if len(sample) >= k:
                points = _matrix(batch["embedding"])
                for a in range(0, len(batch), QUERY_ROWS):
                    near = _distances(points[a:a + QUERY_ROWS], sample)
                    bounds[a:a + QUERY_ROWS] = np.partition(near, k - 1, axis=1)[:, k - 1]
            yield pd.DataFrame({"query_id": batch["query_id"], "embedding": batch["embedding"], "bound": np.minimum(bounds, within)})
    return run


def _slack(bound: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Squared bounds with room for rounding; ``scale`` is the size of the squares that went into a product."""
    return bound + 1e-9 * (1.0 + scale + np.where(np.isfinite(bound), bound, 0.0))


class _Best:
    """The k best hits so far of some queries, ties by id; hits are gathered and ranked many at a time."""

    def __init__(self, bounds: np.ndarray, k: int):
        self.k, self.bounds = k, bounds.copy()
        self.held = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
        self.waiting = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> None:
        self.held.append((rows, ids, distances))
        self.waiting += len(rows)
        if self.waiting >= self.k * len(self.bounds):
            self.hits()

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.waiting:
            rows, ids, distances = (np.concatenate(p) for p in zip(*self.held, strict=True))
            order = np.lexsort((ids, distances, rows))
            rows, ids, distances = rows[order], ids[order], distances[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)      # less where the hits of the same query begin
            last = place == self.k - 1
            self.bounds[rows[last]] = np.minimum(self.bounds[rows[last]], distances[last])
            keep = place < self.k
            self.held, self.waiting = [(rows[keep], ids[keep], distances[keep])], 0
        return self.held[0]


# Largest size of a component whose products stay finite in single precision.
SINGLE_MAX = 1e15


class _Side:
    """Some vectors with what every product with them needs: squares, the largest component, and a copy in single precision."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.squares = (points ** 2).sum(axis=1)
        self.largest = np.abs(points).max(initial=0.0)
        self.single = points.astype(np.float32) if self.largest < SINGLE_MAX else None

    def some(self, rows: np.ndarray) -> _Side:
        side = object.__new__(_Side)
        side.points, side.squares, side.largest = self.points[rows], self.squares[rows], self.largest
        side.single = None if self.single is None else self.single[rows]
        return side


def _close(queries: _Side | np.ndarray, part: _Side | np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, part row) whose squared distance may be within the query's limit, by one matrix product.

    A pair is within it if the product less half the square of the vector is at least half of the square of the query less the
    limit. Single precision decides; what it may be wrong by is added to the limit, so no pair is lost and few come too many.
    """
    queries, part = (side if isinstance(side, _Side) else _Side(side) for side in (queries, part))
    own, theirs = queries.squares, part.squares
    exact = queries.single is None or part.single is None
    kind = np.float64 if exact else np.float32
    room = 4.0 * (queries.points.shape[1] + 8) * np.finfo(kind).eps
    most = limits - own + room * (own + theirs.max(initial=0.0) + np.where(np.isfinite(limits), limits, 0.0))
    product = queries.points @ part.points.T if exact else queries.single @ part.single.T
    product -= (0.5 * theirs).astype(kind)
    near = np.flatnonzero(product >= (-0.5 * most).astype(kind)[:, None])
    return np.divmod(near, max(1, len(theirs)))


# Pairs whose terms are summed at a time; they stay near the processor.
PAIR_ROWS = 1024


def _exact(queries: np.ndarray, part: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of pairs (query row, part row), summed term by term: the same sum however the store is read."""
    exact = np.zeros(len(q))
    for a in range(0, len(q), PAIR_ROWS):
        b = slice(a, a + PAIR_ROWS)
        for term in np.ascontiguousarray((part[v[b]] - queries[q[b]]).T) ** 2:
            exact[b] += term
    return exact


def _scan(shipped, known, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One block of queries against a task's part of the store."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, queries, bounds = shipped.value
        _, centres = known.value
        starts = range(0, len(queries), QUERY_ROWS)
        sides = [_Side(queries[a:a + QUERY_ROWS]) for a in starts]
        best, pairs, skipped = [_Best(bounds[a:a + QUERY_ROWS], k) for a in starts], 0, 0
        for batch in batches:
            if not len(batch):
                continue
            ids, points = batch["vec_id"].to_numpy(), _matrix(batch["embedding"])
            nearest = _distances(points, centres).argmin(axis=1)
            for centre in np.unique(nearest):
                own = np.flatnonzero(nearest == centre)
                part = points[own]
                middle = part.mean(axis=0, keepdims=True)
                radius = np.sqrt(((part - middle) ** 2).sum(axis=1).max())
                theirs, middle_square = _Side(part), (middle ** 2).sum()
                for side, found in zip(sides, best, strict=True):
                    # Nothing in the part is nearer than the way to its middle less its radius.
                    way = np.maximum(side.squares + middle_square - 2.0 * (side.points @ middle[0]), 0.0)
                    least = np.maximum(np.sqrt(way) - radius, 0.0) ** 2
                    scale = side.squares + middle_square + radius ** 2
                    open_ = np.flatnonzero(least <= _slack(found.bounds, scale))
                    pairs += len(least)
                    skipped += len(least) - len(open_)
                    if not len(open_):
                        continue
                    asked = side if len(open_) == len(least) else side.some(open_)
                    # Queries without a bound yet take a few vectors first, so that no more than these are ranked.
                    free = open_[~np.isfinite(found.bounds[open_])]
                    if len(free) and len(part) > k:
                        rough = _distances(side.points[free], part)
                        limit = np.partition(rough, k - 1, axis=1)[:, k - 1]
                        found.bounds[free] = _slack(limit, side.squares[free] + theirs.squares.max())
                    q, v = _close(asked, theirs, _slack(found.bounds[open_], asked.squares + theirs.squares.max()))
                    found.add(open_[q], ids[own[v]], _exact(asked.points, part, q, v))
        rows, near, distances = (np.concatenate(p) for p in zip(*[(a + f.hits()[0], *f.hits()[1:]) for a, f in zip(starts, best, strict=True)], strict=True))
        yield pd.DataFrame({
            "query_id": pd.array([*query_ids[rows].tolist(), None], dtype="Int64"),
            "vec_id": [*near.tolist(), pairs], "distance": [*distances.tolist(), float(skipped)],
        })
    return run


def _meet(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """One block of queries against one block of vectors."""
    def run(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "distance": "float64"})
        row, vec, distance = _nearest(s["vec_id"].to_numpy(), _matrix(s["embedding"]), _matrix(q["embedding"]), k)
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[row], "vec_id": vec, "distance": distance})

    return run


# -- approximate search ----------------------------------------------------------------------

def lsh_search(
    queries: DataFrame, store: DataFrame, k: int, bucket_length: float = 1.0, tables: int = 4,
    seed: int = 7, block_rows: int = 4096,
) -> DataFrame:
    """Approximate search: candidates share a random-projection bucket with the query; the
    exact squared distance ranks them.

    A bucket may hold a third of the store, so both sides of a bucket are dealt to blocks
    sized by the bucket's counts, and blocks answer with k rows per query.
    """
    lsh = BucketedRandomProjectionLSH(
        inputCol="_v", outputCol="_h", bucketLength=bucket_length, numHashTables=tables, seed=seed)
    vectors = store.select("vec_id", "embedding", array_to_vector("embedding").alias("_v"))
    model = lsh.fit(vectors.limit(1))    # only the dimension is learnt

    def bucketed(df: DataFrame, id_: str) -> DataFrame:
        return (
            model.transform(df).select(id_, "embedding", F.posexplode("_h").alias("table", "hash"))
            .select(id_, "embedding", F.concat_ws(":", "table", vector_to_array("hash")[0].cast("bigint")).alias("bucket"))
        )

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = F.ceil(F.count(F.lit(1)) / block_rows)
        return df.groupBy("bucket").agg(n.cast("bigint").alias(name))

    def dealt(df: DataFrame, id_: str, sizes: DataFrame, mine: str, other: str) -> DataFrame:
        return df.join(sizes, "bucket").select(
            id_, "embedding", "bucket", F.pmod(F.xxhash64(id_), F.col(f"n_{mine}")).alias(mine),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n_{other}") - 1)).alias(other),
        )

    q = bucketed(queries.select("query_id", "embedding", array_to_vector("embedding").alias("_v")), "query_id")
    s = bucketed(vectors, "vec_id")
    sizes = blocks(q, "n_qb").join(blocks(s, "n_sb"), "bucket")
    group = ["bucket", "qb", "sb"]
    near = (
        dealt(q, "query_id", sizes, "qb", "sb").groupBy(*group)
        .cogroup(dealt(s, "vec_id", sizes, "sb", "qb").groupBy(*group))
        .applyInPandas(_meet(k), HITS).distinct()
    )
    return _keep_best(near, k)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of exact hits that the approximate search also returned."""
    found = exact.select("query_id", "vec_id").join(
        approximate.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return found.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
