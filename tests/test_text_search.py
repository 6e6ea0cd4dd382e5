"""A text index with its model, and stages that search only for what is open."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from chunkloom.operators import questions as q, vectors as v


def test_text_search_against_brute_force(spark, tmp_path):
    words = "red fox blue sky green tree old stone road house".split()
    texts = [" ".join(words[(i * j) % 10] for j in range(1, 6)) for i in range(40)] + [None, "", "red fox"]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "id string, content string")
    folder = str(tmp_path / "index")
    v.write_text_index(chunks, folder, dims=64)
    asked = spark.createDataFrame([(1, "the red fox"), (2, "stone road"), (3, None)], "query_id bigint, content string")
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in v.text_search(asked, folder, 4).collect()}
    model = PipelineModel.load(f"{folder}/model")
    store = {r.vec_id: (r.id, np.array(r.embedding, dtype="float64")) for r in spark.read.parquet(f"{folder}/vectors").collect()}
    for r in v.embed_texts(asked.select("query_id", F.coalesce("content", F.lit("")).alias("content")), model).collect():
        point = np.array(r.embedding, dtype="float64")
        best = sorted((float(((e - point) ** 2).sum()), n) for n, (_, e) in store.items())[:4]
        for rank, (distance, n) in enumerate(best, 1):
            id_, found = got[r.query_id, rank]
            assert id_ == store[n][0] and abs(found - distance) < 1e-9
    assert len(got) == 12


def test_stages_ask_only_for_what_is_open(spark):
    questions = spark.createDataFrame(
        [(1, "a", "x", "y"), (2, "no", "a", "y"), (3, "no", "no", "a"), (4, "no", "no", "no"), (5, None, " ", "a")],
        "question_id bigint, one string, two string, three string")
    asked = []

    def search(df):
        asked.append(sorted((r.query_id, r.content) for r in df.collect()))
        return df.select("query_id", "content", F.when(F.col("content") == "a", 0.1).otherwise(0.9).alias("distance"))

    wordings = [F.col(c) for c in ("one", "two", "three")]
    got = q.staged_search(questions, wordings, search, F.col("distance") < 0.5)
    assert sorted((r.query_id, r.stage) for r in got.collect()) == [(1, 1), (2, 2), (3, 3), (5, 3)]
    assert asked == [[(1, "a"), (2, "no"), (3, "no"), (4, "no")], [(2, "a"), (3, "no"), (4, "no")], [(3, "a"), (4, "no"), (5, "a")]]
    none = q.staged_search(questions.limit(0), wordings, search, F.col("distance") < 0.5)
    assert none.count() == 0 and "stage" in none.columns


def test_an_index_makes_its_texts_once(spark, tmp_path):
    """Each text is made once, however many passes the model and the vectors need."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        made.add(1)
        return f"red fox {n}"

    chunks = spark.range(20).repartition(1).select(F.concat(F.lit("c"), "id").alias("id"), text("id").alias("content"))
    v.write_text_index(chunks, str(tmp_path / "index"), dims=32)
    assert spark.read.parquet(str(tmp_path / "index/vectors")).count() == 20 and made.value == 20


def test_search_within_a_distance_keeps_all_nearer_hits(spark):
    made = np.random.default_rng(3)
    store = spark.createDataFrame([(n, made.normal(size=6).tolist()) for n in range(300)], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(n, made.normal(size=6).tolist()) for n in range(40)], "query_id bigint, embedding array<double>")
    for within in (0.0, 1.5, 4.0):
        got = {tuple(r) for r in v.topk_search(asked, store, 5, within=within).where(F.col("distance") < within).collect()}
        assert got == {tuple(r) for r in v.topk_search(asked, store, 5).collect() if r.distance < within}
