"""Retrieval and answer quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.functions.text import contains_any, let, preview, tag_array, words_of
from chunkloom.operators.metadata import has_value
from chunkloom.profiles import ANCHORS

# What a run's figures suggest, as codes.
ADVICE = {"quality": "low_satisfaction", "failures": "failures", "rate": "low_success_rate"}


def matching_terms(query: Column, content: Column) -> Column:
    """Lower-cased words of the query that occur in the content, in query order."""
    return let(F.lower(content), lambda low: F.filter(words_of(F.lower(query)), lambda t: F.contains(low, t)))


def is_relevant(query: Column, content: Column) -> Column:
    return let(F.lower(content), lambda low: F.exists(words_of(F.lower(query)), lambda t: F.contains(low, t)))


def query_relevance(hits: DataFrame) -> DataFrame:
    """Per hit: key fields, preview, terms found, anchors present."""
    types = dict(hits.dtypes)
    anchors = tag_array([(a, has_value(F.col(a), types[a])) for a in ANCHORS])
    return hits.select(
        "question_id", "rank", F.coalesce("path", F.lit("Unknown source")).alias("source"), "type", "chunk_index",
        preview(F.col("content"), 500).alias("content_preview"),
        F.length("content").cast("bigint").alias("content_length"),
        matching_terms(F.col("question"), F.col("content")).alias("matching_terms"),
        anchors.alias("anchors"),
    )


def query_metrics(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: hits, distinct sources, relevant hits, rate; a query without hits counts as 0."""
    relevant = is_relevant(F.col("question"), F.col("content"))
    found = hits.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("retrieved"), F.count_distinct("path").alias("unique_sources"),
        F.count_if(relevant).alias("relevant_docs"),
    )
    zero = F.lit(0).cast("bigint")
    out = queries.join(found, "question_id", "left").select(
        *queries.columns, *[F.coalesce(c, zero).alias(c) for c in ("retrieved", "unique_sources", "relevant_docs")]
    )
    return out.withColumn(
        "relevance_rate",
        F.when(F.col("retrieved") > 0, F.col("relevant_docs").cast("double") / F.col("retrieved")).otherwise(0.0),
    )


def relevance_band(rate: Column) -> Column:
    return F.when(rate > 0.7, "high").when(rate > 0.5, "moderate").otherwise("low")


def suite_metrics(metrics: DataFrame, by: str = "suite") -> DataFrame:
    """Per suite: averages over the queries without an error, success count, band."""
    ok = F.col("error").isNull() if "error" in metrics.columns else F.lit(True)
    out = metrics.groupBy(by).agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(ok).alias("successful"),
        F.round(F.avg(F.when(ok, F.col("retrieved"))), 6).alias("avg_retrieved"),
        F.round(F.avg(F.when(ok, F.col("relevance_rate"))), 6).alias("avg_relevance"),
    )
    return out.withColumn("band", relevance_band(F.col("avg_relevance")))


def compare_queries(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """``pairs(pair_id, left_id, right_id)``: common and own sources, relevance, verdict."""
    relevant = is_relevant(F.col("question"), F.col("content"))
    per_query = hits.groupBy("question_id").agg(
        F.collect_set("path").alias("sources"),     # at most k sources
        F.avg(F.when(relevant, 1.0).otherwise(0.0)).alias("rate"),
    )

    def side(id_: str, name: str) -> DataFrame:
        return per_query.select(
            F.col("question_id").alias(id_), F.col("sources").alias(f"{name}_sources"), F.col("rate").alias(f"{name}_rate"))

    both = pairs.join(side("left_id", "l"), "left_id").join(side("right_id", "r"), "right_id")
    gap = F.abs(F.col("l_rate") - F.col("r_rate"))
    return both.select(
        "pair_id",
        F.size(F.array_intersect("l_sources", "r_sources")).cast("bigint").alias("common"),
        F.size(F.array_except("l_sources", "r_sources")).cast("bigint").alias("only_left"),
        F.size(F.array_except("r_sources", "l_sources")).cast("bigint").alias("only_right"),
        F.round("l_rate", 6).alias("left_relevance"), F.round("r_rate", 6).alias("right_relevance"),
        F.when(gap < 0.1, "similar").when(F.col("l_rate") > F.col("r_rate"), "left").otherwise("right").alias("better"),
    )


def multi_query_results(hits: DataFrame, per_query: int = 5) -> DataFrame:
    return hits.filter(F.col("rank") <= per_query).select(
        "question_id", "rank", F.coalesce("path", F.lit("Unknown")).alias("source"),
        preview(F.col("content"), 200).alias("content"), F.round("distance", 6).alias("score"),
    )


def retrieval_health(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per probe: hit count, source of the top hit, which anchors it has."""
    types = dict(hits.dtypes)
    anchors = tag_array([(a, has_value(F.col(a), types[a])) for a in ("class_names", "function_names", "screen_name", "component_name")])
    found = hits.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.min_by("path", "rank").alias("top_source"),
        F.min_by(preview(F.col("content"), 200), F.col("rank")).alias("top_preview"),
        F.min_by(F.array_join(anchors, ","), F.col("rank")).alias("top_anchors"),
    )
    return queries.join(found, "question_id", "left").withColumn(
        "hits", F.coalesce("hits", F.lit(0).cast("bigint"))
    ).withColumn("healthy", F.col("hits") > 0)


def retrieval_patterns(hits: DataFrame, k: int = 3) -> DataFrame:
    return hits.filter(F.col("rank") <= k).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("results"), F.count_distinct("path").alias("unique_files"))


# -- answers ---------------------------------------------------------------------------------

SCORES = ["relevance_score", "completeness_score", "clarity_score", "source_utilization", "metadata_completeness"]


def answer_quality(turns: DataFrame) -> DataFrame:
    """Five heuristic scores per ``(answer, intent, confidence, rewritten_query, n_sources)``."""
    answer = F.coalesce("answer", F.lit(""))
    size = F.length(answer)
    has_intent = F.coalesce(F.col("intent") != "", F.lit(False))
    has_confidence = F.coalesce(F.col("confidence") > 0, F.lit(False))
    has_rewrite = F.coalesce(F.col("rewritten_query") != "", F.lit(False))
    fields = sum((F.when(c, 1.0).otherwise(0.0) for c in (has_intent, has_confidence, has_rewrite)), F.lit(0.0))
    return turns.withColumns({
        "relevance_score": F.when(size > 50, F.least(F.lit(10.0), size / 20.0)).otherwise(0.0),
        "completeness_score": F.when(has_intent & has_confidence, 8.0).when(has_intent | has_confidence, 5.0).otherwise(2.0),
        "clarity_score": F.when(contains_any(answer, ["•", "-", "\n"]), 8.0).when(size > 100, 6.0).otherwise(4.0),
        "source_utilization": F.least(F.lit(10.0), F.col("n_sources") * 2.0),
        "metadata_completeness": fields / 3.0 * 10.0,
    })


def satisfaction(scored: DataFrame) -> DataFrame:
    """``satisfaction`` from the mean score against ``expected_rating``; below it costs a fifth."""
    mean = reduce(lambda a, b: a + b, [F.col(s) for s in SCORES]) / float(len(SCORES))
    rating = F.when(mean >= F.col("expected_rating"), F.least(F.lit(10), F.floor(mean).cast("int"))).otherwise(
        F.greatest(F.lit(1), F.floor(mean * 0.8).cast("int")))
    return scored.withColumn("satisfaction", rating)


def run_summary(results: DataFrame) -> DataFrame:
    """One row over ``results(status, satisfaction)``: totals, rates, advice."""
    ok = F.col("status") == "success"
    totals = results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("satisfaction"))), F.lit(0.0)), 2).alias("average_satisfaction"),
    )
    rate = F.when(F.col("total") > 0, F.col("passed").cast("double") * 100.0 / F.col("total")).otherwise(0.0)
    return totals.withColumn("failed", F.col("total") - F.col("passed")).withColumn(
        "success_rate", F.round(rate, 2)
    ).withColumn("advice", tag_array([
        (ADVICE["quality"], F.col("average_satisfaction") < 4),
        (ADVICE["failures"], F.col("failed") > 0),
        (ADVICE["rate"], F.col("success_rate") < 80),
    ]))
