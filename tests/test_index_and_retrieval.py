"""Closure, dependency scopes, search, packing, and the streams' batch forms."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from chunkloom.operators import context, evaluation, indexes, questions as q, vectors as v
from chunkloom.operators.graph import impact_closure
from chunkloom.options import Options
from chunkloom.profiles import PROFILES
from chunkloom.streaming import monitor


def test_closure_with_cycle_and_hot_node(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "c"), ("e", "d"), ("a", "e"), ("x", "y")]
    edges += [(f"h{i}", "hub") for i in range(500)]
    df = spark.createDataFrame(edges, "src string, dep string")
    seeds = spark.createDataFrame([("a",), ("y",), ("hub",), ("none",)], "seed string")
    got = {}
    for r in impact_closure(df, seeds).collect():
        got.setdefault(r.seed, set()).add(r.impacted)
    assert got == {"a": {"a", "b", "c", "d", "e"}, "y": {"x"}, "hub": {f"h{i}" for i in range(500)}}


def test_dependency_scope_equals_substring_search(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abAB./é") for _ in range(n))
    deps = sorted({word(rng.randint(1, 6)) for _ in range(300)})
    paths = sorted({word(rng.randint(5, 15)) for _ in range(40)})
    got = {r.dep: r.scope for r in indexes.classify_dependencies(
        spark.createDataFrame([(d,) for d in deps], "dep string"), spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {d: "internal" if any(d.lower() in p.lower() for p in paths) else "external" for d in deps}


def vectors(spark, matrix, name):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"{name} bigint, embedding array<float>")


def test_search_equals_brute_force_in_both_forms(spark):
    rng = np.random.default_rng(0)
    store = rng.normal(size=(300, 8)).astype("float32")
    store[50:60] = store[10]                      # exact copies: ties go by id
    asked = np.vstack([store[10], rng.normal(size=(20, 8)).astype("float32")])
    s, a = vectors(spark, store, "vec_id"), vectors(spark, asked, "query_id")
    distance = ((asked[:, None, :].astype("float64") - store[None].astype("float64")) ** 2).sum(axis=2)
    want = {(i, int(j), n + 1) for i in range(len(asked)) for n, j in enumerate(np.lexsort((np.arange(300), distance[i]))[:7])}
    for size in (v.BLOCK_BYTES, 500):                   # one block of queries, and many
        hits = v.topk_search(a, s, 7, block_bytes=size)
        assert {(r.query_id, r.vec_id, r["rank"]) for r in hits.collect()} == want
    exact = v.topk_search(a, s, 7)
    near = v.lsh_search(a, s, 7, bucket_length=3.0, tables=8, block_rows=64)
    assert v.recall(exact, near).first().recall > 0.8


def test_search_skips_parts_that_are_too_far(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 6)) * 50
    store = (middles[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6))).astype("float32")
    asked = (middles[rng.integers(0, 12, 40)] + rng.normal(size=(40, 6))).astype("float32")
    s, a = vectors(spark, store, "vec_id"), vectors(spark, asked, "query_id")
    distance = ((asked[:, None, :].astype("float64") - store[None].astype("float64")) ** 2).sum(axis=2)
    want = {(i, int(j)) for i in range(40) for j in np.lexsort((np.arange(900), distance[i]))[:5]}
    assert {(r.query_id, r.vec_id) for r in v.topk_search(a, s, 5).collect()} == want
    met = v.search_pruning(a, s, 5).first()
    assert met.pairs > 0 and met.skipped > 0.5 * met.pairs


def test_search_of_mixed_lengths_nulls_and_few_vectors(spark):
    s = spark.createDataFrame(
        [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0]), (4, None), (5, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    a = spark.createDataFrame([(7, [0.0, 0.0]), (8, [5.0]), (9, None), (10, [1.0, 2.0, 3.0])], "query_id bigint, embedding array<float>")
    got = sorted((r.query_id, r.vec_id, r.distance, r["rank"]) for r in v.topk_search(a, s, 3).collect())
    assert got == [(7, 1, 0.0, 1), (7, 2, 25.0, 3), (7, 5, 0.0, 2), (8, 3, 16.0, 1)]
    assert v.topk_search(a.limit(0), s, 3).count() == 0 and v.topk_search(a, s.limit(0), 3).count() == 0


def test_best_passages_look_at_every_chunk(spark):
    hits = spark.createDataFrame(
        [(1, "Where is the red fox", 10, 1), (1, "Where is the red fox", 20, 2), (2, "nothing here", 20, 1), (3, None, 10, 1)],
        "question_id long, question string, vec_id long, rank long")
    texts = {10: ["the start", "a red fox is the thing", "red", "the red", "fox red the", None], 20: ["x", "the RED fox"]}
    chunks = spark.createDataFrame(
        [(d, f"{d}#{i}", i, t) for d, some in texts.items() for i, t in enumerate(some)], "vec_id long, id string, chunk_index int, content string")
    got = context.best_passages(hits, chunks, 4, per_document=3)
    rows = sorted((r.question_id, r["rank"], r.id, r.terms) for r in got.collect())
    # Of document 10 three chunks at most; equal ones by nearness, then by place.
    assert [r for r in rows if r[0] == 1] == [(1, 1, "10#1", 4), (1, 2, "10#4", 3), (1, 3, "20#1", 3), (1, 4, "10#3", 2)]
    assert [r[2] for r in rows if r[0] == 2] == ["20#0", "20#1"]
    assert {"question", "content", "vec_id", "terms"} <= set(got.columns)
    assert context.best_passages(hits.limit(0), chunks, 4).count() == 0


def test_words_inside_equals_substring_search(spark):
    rows = [("the the fox\u00a0\u3000é", "é thefox"), ("", "x"), (" \t ", "x"), ("a", None), (None, "a"), (None, None), ("\U0001f600 b\x85c", "\U0001f600c")]
    df = spark.createDataFrame(rows * 3, "q string, t string").repartition(2)
    got = {(r.q, r.t): r.n for r in df.select("q", "t", context.words_inside(F.col("q"), F.col("t")).alias("n")).collect()}
    assert got == {
        (q, t): None if q is None else sum(w in (t or "") for w in set(re.split("[\t\u0085\u00a0\u3000 ]+", q)) - {""}) for q, t in rows}


def test_intents(spark):
    cases = {
        "What is the main purpose?": ("overview", 0.95), "show the overall structure": ("overview", 0.9),
        "is the field required?": ("validation", 0.8), "navigate from a to the b screen": ("ui_flow", 0.8),
        "what if we refactor": ("impact_analysis", 0.8), "hello": ("technical", 0.5), "unauthorised": ("technical", 0.5),
    }
    df = spark.createDataFrame([(k,) for k in cases], "question string")
    got = {r.question: (r.i.intent, r.i.confidence) for r in df.select("question", q.classify_intent(F.col("question")).alias("i")).collect()}
    assert got == cases
    row = spark.createDataFrame([("What if MainActivity.kt and Foo break 2024 things?",)], "question string").select(
        q.file_mentions(F.col("question"), PROFILES["android"]).alias("m"), q.key_terms(F.col("question")).alias("t")).first()
    assert row.m == ["Foo", "MainActivity", "MainActivity.kt", "What"] and row.t == ["what", "mainactivity", "break", "things"]


def hits(spark, rows):
    schema = ("question_id bigint, question string, intent string, rank bigint, path string, chunk_index int, content string, type string, "
              "chunk_hierarchy string, screen_name string, component_name string, class_names array<string>, function_names array<string>, "
              "ui_elements array<string>, business_logic_indicators array<string>, validation_rules array<string>, semantic_score double")
    return spark.createDataFrame(rows, schema)


def test_pack_context_budget(spark):
    def row(rank, words, anchored, score):
        return (1, "q", "technical", rank, f"f{rank}", 0, " ".join(["w"] * words), "class", None, None, None,
                ["A"] if anchored else None, None, None, None, None, score)

    data = hits(spark, [row(1, 50, True, 1.0), row(2, 60, True, 3.0), row(3, 70, False, 9.0), row(4, 80, True, 2.0)])
    packed = context.packed_hits(data, Options(context_words=100)).orderBy("position").collect()
    assert [r.path for r in packed] == ["f2", "f4", "f1", "f3"]            # anchored first, by score
    assert [r.taken for r in packed] == [True, True, False, False]           # 64 <= 80, then 148 > 80
    text = context.pack_context(data, Options(context_words=100)).first()
    assert "[Context window limit: 148 tokens]" in text.context and "Found 3 chunks" in text.context and "avg score: 2.0" in text.context
    weak = hits(spark, [row(1, 5, False, 1.0), row(2, 5, False, 2.5)])
    only = context.pack_context(weak).first()
    assert only.n_chunks == 1 and "f2" in only.context and "No context blocks" in only.context


def test_screen_map_keeps_fields_without_rules(spark):
    df = spark.createDataFrame(
        [("S", ["a", "b"], ["r1"]), ("S", ["a", "c"], None), (None, ["z"], ["r"])],
        "screen_name string, input_fields array<string>, validation_rules array<string>")
    got = {(r.field, r.rule) for r in indexes.screen_input_map(df).collect()}
    assert got == {("a", "r1"), ("b", "r1"), ("c", None)}


def test_answer_scores(spark):
    df = spark.createDataFrame(
        [("x" * 60 + "-", "overview", 0.9, "r", 3, 4), ("", None, None, None, 0, 4)],
        "answer string, intent string, confidence double, rewritten_query string, n_sources bigint, expected_rating int")
    a, b = evaluation.satisfaction(evaluation.answer_quality(df)).collect()
    assert (round(a.relevance_score, 2), a.completeness_score, a.clarity_score, a.source_utilization, a.metadata_completeness, a.satisfaction) == (3.05, 8.0, 8.0, 6.0, 10.0, 7)
    assert (b.relevance_score, b.completeness_score, b.clarity_score, b.satisfaction) == (0.0, 2.0, 4.0, 1)


def test_sessions_equal_builtin(spark, sf):
    from chunkloom.plans.bridges import log_events

    events = log_events(spark, sf)
    key = lambda df: sorted((r.session, r.session_start, r.session_end, r.n_events) for r in df.collect())
    assert key(monitor.session_activity_batch(events)) == key(monitor.session_activity(events))


def test_timeouts_equal_join(spark, sf):
    from chunkloom.plans.bridges import log_events

    e = log_events(spark, sf).withColumnRenamed("event_id", "build_id")
    s, f = e.filter("level = 'SIGNUP'"), e.filter("level = 'PURCHASE'")
    ids = lambda df: sorted(r.build_id for r in df.collect())
    assert ids(monitor.build_timeouts_batch(s, f)) == ids(monitor.build_timeouts(s, f))


def test_single_precision_loses_no_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    for shift, scale in ((0.0, 1.0), (1000.0, 1e-3), (0.0, 1e18)):
        queries, part = (shift + scale * rng.normal(size=(n, 16)).astype("float32").astype("float64") for n in (40, 60))
        squared = ((queries[:, None, :] - part[None, :, :]) ** 2).sum(axis=2)
        limits = np.sort(squared, axis=1)[:, 4]
        found = set(zip(*map(np.ndarray.tolist, v._close(queries, part, limits)), strict=True))
        assert found >= set(zip(*map(np.ndarray.tolist, np.nonzero(squared <= limits[:, None])), strict=True))
        assert shift or len(found) < 6 * len(queries)


def test_best_ranks_hits_in_any_order():
    import numpy as np

    best = v._Best(np.full(2, np.inf), 2)
    for rows, ids, distances in (([0, 1, 0], [5, 6, 7], [3.0, 1.0, 2.0]), ([0, 0], [4, 9], [2.0, 8.0]), ([1], [1], [1.0])):
        best.add(np.array(rows), np.array(ids), np.array(distances))
    assert [x.tolist() for x in best.hits()] == [[0, 0, 1, 1], [4, 7, 1, 6], [2.0, 2.0, 1.0, 1.0]]
    assert best.bounds.tolist() == [2.0, 1.0]
