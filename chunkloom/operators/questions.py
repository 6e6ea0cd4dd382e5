"""Questions: intent, hints, search terms, mentions, impact."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkloom.functions.text import contains_any
from chunkloom.operators.graph import SharedClosure, product, shared_closure
from chunkloom.profiles import Profile
from chunkloom.session import scratch_path

# ---------------------------------------------------------------------------------------
# Intent phrases, hint words, impact words, overview search terms.
PURPOSE_PHRASES = [
    "what does this project do|project purpose|main purpose|what is this|project description|project overview",
    "what is the main|main activity|MainActivity|application purpose|app does what",
]
INTENT_PHRASES = {
    "overview": "overview|structure|architecture|summary|top level|entry point|project files|high level|all files"
                "|main flow|overall",
    "validation": "validate|input field|required|constraint|rules|check for|form field|input rule|not null|input error",
    "ui_flow": "navigation|screen flow|routing|ui flow|navigate|fragment flow|activity flow|page flow"
               "|screen transitions|which screen|from.*to.*screen|user journey",
    "business_logic": "business logic|process|calculation|rule engine|invoicing|business process|workflow"
                      "|authorization|permission|role check|policy|auth",
    "impact_analysis": "impact|what if|affect|break|consequence|dependency|dependencies|refactor|change in|modifying",
}
HINT_PATTERNS = [r'"(\w+)"', r"'(\w+)'", r"(\w+Field|\w+Input|[A-Z][a-zA-Z0-9]+Screen)"]
UI_HINTS = ["navigate", "screen", "fragment", "activity", "route"]
IMPACT_WORDS = [
    "impact", "what if", "break", "affect", "change", "modify", "remove", "delete", "consequences", "dependencies",
]
OVERVIEW_TERMS = [
    "main activity", "MainActivity", "application", "app purpose", "project structure",
    "manifest", "build.gradle", "README", "documentation",
]
# ---------------------------------------------------------------------------------------


def _mentions(text: Column, phrases: str) -> Column:
    return text.rlike(rf"(?idU)\b(?:{phrases})\b")


def classify_intent(question: Column) -> Column:
    """``struct(intent, confidence)``: purpose questions first, then the intents in order."""
    def answer(intent: str, confidence: float) -> Column:
        return F.struct(F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"))

    case = F.when(_mentions(question, "|".join(PURPOSE_PHRASES)), answer("overview", 0.95))
    for intent, phrases in INTENT_PHRASES.items():
        case = case.when(_mentions(question, phrases), answer(intent, 0.9 if intent == "overview" else 0.8))
    return case.otherwise(answer("technical", 0.5))


def query_hints(question: Column, intent: Column, profile: Profile) -> Column:
    """Anchor terms by intent, in order of appearance; empty for other intents."""
    any_of = "(?U)" + "|".join(HINT_PATTERNS)
    groups = [F.regexp_extract_all(question, F.lit(any_of), F.lit(g)) for g in (1, 2, 3)]
    named = F.transform(
        F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]),
        lambda m: F.concat(m["g0"], m["g1"], m["g2"]),
    )
    none = F.array().cast("array<string>")
    return (
        F.when(intent.isin("validation", "business_logic"), named)
        .when(intent == "overview", F.array(*[F.lit(k) for k in profile.keywords]) if profile.keywords else none)
        .when(intent == "ui_flow", F.array(*[F.lit(k) for k in UI_HINTS]))
        .otherwise(none)
    )


def expand_query(question: Column, intent: Column) -> Column:
    """Search text: overview questions gain fixed terms, others stay as they are."""
    return F.when(
        intent == "overview", F.concat_ws(" ", question, F.lit(", ".join(OVERVIEW_TERMS)))
    ).otherwise(question)


def key_terms(question: Column) -> Column:
    """Lower-cased words of more than three characters that are no numbers."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 3) & ~w.rlike(r"(?U)^\d+$"))


def file_mentions(question: Column, profile: Profile) -> Column:
    """Distinct capitalised identifiers and file names with a profile extension, sorted."""
    found = [F.regexp_extract_all(question, F.lit(r"(?U)\b[A-Z][a-zA-Z0-9_]*[a-zA-Z0-9]\b"), F.lit(0))]
    for extension in profile.extensions:
        found.append(F.regexp_extract_all(question, F.lit(rf"(?iU)\b\w+{re.escape(extension)}\b"), F.lit(0)))
    return F.sort_array(F.array_distinct(F.concat(*found)))


def is_impact_question(question: Column) -> Column:
    return contains_any(F.lower(question), IMPACT_WORDS)


def analyse_questions(questions: DataFrame, profile: Profile) -> DataFrame:
    """``questions(question_id, question)`` with every derived column of this module."""
    q = F.col("question")
    return (
        questions.withColumn("_i", classify_intent(q)).select("*", "_i.*").drop("_i")
        .withColumn("hints", query_hints(q, F.col("intent"), profile))
        .withColumn("search_text", expand_query(q, F.col("intent")))
        .withColumn("key_terms", key_terms(q))
        .withColumn("mentions", file_mentions(q, profile))
        .withColumn("asks_impact", (F.col("intent") == "impact_analysis") | is_impact_question(q))
    )


def impact_sets(analysed: DataFrame, edges: DataFrame) -> SharedClosure:
    """What each question about impact names, as a closure with ``question_id`` for ``seed``: shared nodes once, the rest as rows.

    The closure runs once per distinct mention, over all questions together.
    """
    folder = scratch_path(edges.sparkSession, "mentions")
    analysed.filter("asks_impact").select("question_id", F.explode("mentions").alias("seed")).distinct().write.parquet(folder)
    mentions = edges.sparkSession.read.parquet(folder)
    closure = shared_closure(edges, mentions.select("seed"))
    mentions.join(closure.sharing, "seed").select("question_id").distinct().write.parquet(f"{folder}-sharing")
    sharing = edges.sparkSession.read.schema(mentions.select("question_id").schema).parquet(f"{folder}-sharing")
    rest = mentions.join(closure.rest, "seed").select("question_id", "impacted").distinct()
    # A question may share the common nodes by one mention and reach some of them by another.
    own = rest.join(sharing, "question_id", "left_anti")
    more = rest.join(sharing, "question_id", "left_semi").join(closure.common, "impacted", "left_anti").select("question_id", "impacted")
    return SharedClosure(closure.common, sharing, own.unionByName(more))


def impact_for_questions(analysed: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ``(question_id, impacted)`` for questions that ask about impact."""
    sets = impact_sets(analysed, edges)
    return sets.rest.unionByName(product(sets.sharing, sets.common))


def impact_summary(sets: SharedClosure) -> DataFrame:
    """``(question_id, n_impacted, summary)``; the shared nodes are counted once for all questions."""
    shared = sets.sharing.crossJoin(sets.common.agg(F.count(F.lit(1)).alias("n_impacted"))).where("n_impacted > 0")
    counts = sets.rest.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_impacted")).unionByName(shared)
    return counts.groupBy("question_id").agg(F.sum("n_impacted").alias("n_impacted")).withColumn(
        "summary", F.concat(F.lit("Components impacted: "), F.col("n_impacted")))


def search_with_fallback(stages: list[DataFrame]) -> DataFrame:
    """Hits of the first stage that found anything, per question.

    ``stages`` are hit tables ``(query_id, vec_id, distance, rank)`` of the rewritten text,
    the original text and the key terms. A question has at most k hits per stage, so the
    window per question is small, and each search is evaluated once.
    """
    all_hits = stages[0].withColumn("stage", F.lit(1))
    for n, hits in enumerate(stages[1:], start=2):
        all_hits = all_hits.unionByName(hits.withColumn("stage", F.lit(n)))
    first = F.min("stage").over(Window.partitionBy("query_id"))
    return all_hits.withColumn("_first", first).filter("stage = _first").drop("_first")


def staged_search(
    questions: DataFrame, texts: list[Column], search: Callable[[DataFrame], DataFrame], accept: Column, key: str = "question_id"
) -> DataFrame:
    """Hits ``(query_id, stage, ...)`` of the first of several wordings of a question that finds anything.

    ``texts`` are the wordings, best first (as rewritten, as asked, its key terms); ``search`` takes ``(query_id, content)``
    and gives hits, of which ``accept`` says which count. A stage searches only for questions that all earlier ones left
    open, and not at all once none is; a wording that is null or blank leaves its question open. Each stage is written to
    the shared folder, which is read by the next one and by the result.
    """
    spark = questions.sparkSession
    folder = scratch_path(spark, "stages")
    stages, hits = 0, None
    left = questions
    for number, text in enumerate(texts, 1):
        asked = left.select(F.col(key).alias("query_id"), text.alias("content")).where(F.trim("content") != "")
        if asked.isEmpty():
            continue
        found = search(asked).where(accept)
        path = f"{folder}-{stages}"
        found.write.parquet(path)
        here = spark.read.schema(found.schema).parquet(path)
        part = here.withColumn("stage", F.lit(number).cast("bigint"))
        hits = part if hits is None else hits.unionByName(part)
        left = left.join(here.select(F.col("query_id").alias(key)).distinct(), key, "left_anti")
        stages += 1
    if hits is None:
        empty = spark.createDataFrame([], "query_id bigint, content string")
        return search(empty).withColumn("stage", F.lit(0).cast("bigint")).limit(0)
    return hits
