"""Queries over questions, retrieval, context and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkloom.operators import context as c, evaluation as e, questions as q, vectors as v
from chunkloom.operators.diagnostics import distance_histogram
from chunkloom.operators.indexes import (
    business_level, file_level, level_for_intent, screen_input_map, ui_level,
)
from chunkloom.options import Options
from chunkloom.plans import bridges, oracle as o
from chunkloom.plans.bridges import PROSE, WEB
from chunkloom.plans.build import answer_batch
from chunkloom.plans.registry import flat, query
from chunkloom.profiles import INDEX_LEVELS
from chunkloom.session import scratch_path

K = 10
OPTIONS = Options(top_k=K, context_words=1000)
L, R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
W = o.WORD


def _says(phrases: str) -> str:
    return f"regexp_matches(question, {o.lit('(?i)' + L + '(?:' + phrases + ')' + R)})"


INTENT = (
    f"CASE WHEN {_says('|'.join(q.PURPOSE_PHRASES))} THEN 'overview' "
    + " ".join(f"WHEN {_says(p)} THEN '{i}'" for i, p in q.INTENT_PHRASES.items()) + " ELSE 'technical' END"
)
CONFIDENCE = (
    f"CASE WHEN {_says('|'.join(q.PURPOSE_PHRASES))} THEN 0.95 WHEN intent = 'overview' THEN 0.9 "
    "WHEN intent = 'technical' THEN 0.5 ELSE 0.8 END::DOUBLE"
)
ASKED = f"{o.questions_cte()}, asked0 AS (SELECT *, {INTENT} AS intent FROM questions), asked AS (SELECT *, {CONFIDENCE} AS confidence FROM asked0)"
SEARCH = f"CASE WHEN intent = 'overview' THEN question || ' ' || {o.lit(', '.join(q.OVERVIEW_TERMS))} ELSE question END"
USERS = "SELECT DISTINCT conv_id FROM conversations WHERE role = 'user'"
ITEMS = "SELECT item_id FROM benchmark"
DOC = r"regexp_extract(path, '/(\d+)\.', 1)::BIGINT"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def _passages(questions: str, more: str, k: int) -> str:
    """One row per question and hit: the best chunks of the nearest documents; vector n belongs to document n."""
    return f"""near AS (SELECT question_id, question, {more}, hits.distance, hits.rank AS near, chunks.*,
      len(list_filter(list_distinct({_words('lower(question)')}), lambda t: contains(lower(content), t))) AS terms
    FROM {questions} JOIN chunks ON {DOC} = vec_id),
  own AS (SELECT *, row_number() OVER (PARTITION BY question_id, path ORDER BY terms DESC, chunk_index) AS place FROM near),
  rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY terms DESC, near, chunk_index, {DOC}) AS rank
    FROM own WHERE place <= 3) WHERE rank <= {k})"""


ROWS = f"""{ASKED}, {o.topk_cte(USERS, K)},
  {_passages('asked JOIN hits ON conv_id = query_id', 'intent', K)}"""
# The same over a store that holds only the vectors of documents with chunks.
STORED_ROWS = f"""{ASKED}, {o.topk_cte(USERS, K, stored=f"SELECT {DOC} FROM chunks")},
  {_passages('asked JOIN hits ON conv_id = query_id', 'intent', K)}"""
PROBES = f"""probes AS (SELECT item_id AS question_id, text AS question, lower(substr(text, 1, 1)) AS suite FROM benchmark),
  {o.topk_cte(ITEMS, 5)},
  {_passages('probes JOIN hits ON question_id = query_id', 'suite', 5)}"""


def on_rows(select: str) -> str:
    return f"WITH {o.chunks(PROSE, o.PROSE_FILES)}, {ROWS} {select}"


def on_probes(select: str) -> str:
    return f"WITH {o.chunks(PROSE, o.PROSE_FILES)}, {PROBES} {select}"


def asked(spark, sf):
    return q.analyse_questions(bridges.questions(spark, sf), WEB)


def rows(spark, sf):
    hits = v.topk_search(bridges.question_vectors(spark, sf), bridges.vectors(spark, sf), K)
    people = asked(spark, sf).select("question_id", "conv_id", "question", "intent")
    return c.best_passages(people.join(hits, F.col("conv_id") == F.col("query_id")), bridges.prose_chunks_of(spark, sf, hits, deal=True), K)


def probes(spark, sf):
    return bridges.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"),
        F.lower(F.substring("text", 1, 1)).alias("suite"))


def probe_rows(spark, sf):
    hits = v.topk_search(bridges.probe_vectors(spark, sf), bridges.vectors(spark, sf), 5)
    return c.best_passages(probes(spark, sf).join(hits, F.col("question_id") == F.col("query_id")), bridges.prose_chunks_of(spark, sf, hits, deal=True), 5)


# -- questions -------------------------------------------------------------------------------

@query("classify_intent", f"WITH {ASKED} SELECT question_id, intent, confidence FROM asked")
def classify_intent(spark, sf):
    return asked(spark, sf).select("question_id", "intent", "confidence")


_LEVELS = " ".join(f"WHEN '{i}' THEN '{lvl}'" for i, lvl in INDEX_LEVELS.items())


@query("question_levels", f"WITH {ASKED} SELECT question_id, intent, CASE intent {_LEVELS} END AS level FROM asked")
def question_levels(spark, sf):
    """Index level per question, by its intent."""
    return level_for_intent(asked(spark, sf).select("question_id", "intent")).select("question_id", "intent", "level")


_GROUPS = [rf'"({W}+)"', rf"'({W}+)'", rf"({W}+Field|{W}+Input|[A-Z][a-zA-Z0-9]+Screen)"]
_HINTS = (
    f"list_transform(list_zip(" + ", ".join(f"regexp_extract_all(question, {o.lit('|'.join(_GROUPS))}, {n})" for n in (1, 2, 3))
    + "), lambda z: concat(z[1], z[2], z[3]))"
)


@query("query_hints", f"""WITH {ASKED} SELECT question_id, {o.joined(f"CASE WHEN intent IN ('validation', 'business_logic') THEN {_HINTS} "
  f"WHEN intent = 'overview' THEN ['web', 'frontend', 'react', 'vue', 'angular'] WHEN intent = 'ui_flow' THEN ['navigate', 'screen', 'fragment', 'activity', 'route'] ELSE [] END")} AS hints FROM asked""")
def query_hints(spark, sf):
    return flat(asked(spark, sf), "question_id", "hints")


@query("expand_query", f"WITH {ASKED} SELECT question_id, {SEARCH} AS search_text FROM asked")
def expand_query(spark, sf):
    return asked(spark, sf).select("question_id", "search_text")


@query("key_terms", f"""WITH {ASKED} SELECT question_id, {o.joined(f"list_filter(regexp_extract_all(lower(question), '{W}+'), lambda t: length(t) > 3 AND NOT regexp_matches(t, '^[0-9]+$'))")} AS key_terms FROM asked""")
def key_terms(spark, sf):
    return flat(asked(spark, sf), "question_id", "key_terms")


_NAMES = f"list_filter(regexp_extract_all(question, '{W}+'), lambda t: regexp_matches(t, '^[A-Z][a-zA-Z0-9_]*[a-zA-Z0-9]$'))"
_FILES = ", ".join(f"regexp_extract_all(question, {o.lit('(?i)(' + W + '+' + chr(92) + x + ')' + R)}, 1)" for x in WEB.extensions)
MENTIONS = o.sorted_set(f"list_concat({_NAMES}, {_FILES})")


@query("file_mentions", f"WITH {ASKED} SELECT question_id, {o.joined(MENTIONS)} AS mentions FROM asked")
def file_mentions(spark, sf):
    return flat(asked(spark, sf), "question_id", "mentions")


ASKS = f"(intent = 'impact_analysis' OR {o.any_word('lower(question)', q.IMPACT_WORDS)})"


@query("impact_questions", f"WITH {ASKED} SELECT question_id, {ASKS} AS asks_impact FROM asked")
def impact_questions(spark, sf):
    return asked(spark, sf).select("question_id", "asks_impact")


_EDGE = "([A-Z][a-z]+) +([a-z]+)"


def _word_edges(spark, sf):
    """Every capitalised word of a text depends on the word after it."""
    docs = bridges.table(spark, sf, "documents")
    pairs = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_EDGE), F.lit(0)))).alias("pair")).distinct()
    return pairs.select(
        F.regexp_extract("pair", _EDGE, 1).alias("src"), F.initcap(F.regexp_extract("pair", _EDGE, 2)).alias("dep")).distinct()


_IMPACT = f"""pairs AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_EDGE}')) AS pair FROM documents),
  edges AS (SELECT DISTINCT regexp_extract(pair, '{_EDGE}', 1) AS src,
    upper(substr(regexp_extract(pair, '{_EDGE}', 2), 1, 1)) || substr(regexp_extract(pair, '{_EDGE}', 2), 2) AS dep FROM pairs),
  mentions AS (SELECT question_id, unnest({MENTIONS}) AS seed FROM asked WHERE {ASKS}),
  c AS (SELECT seed, e.src AS impacted FROM (SELECT DISTINCT seed FROM mentions) JOIN edges e ON e.dep = seed
    UNION SELECT c.seed, e.src FROM c JOIN edges e ON e.dep = c.impacted)"""


@query("impact_for_questions", f"WITH RECURSIVE {ASKED}, {_IMPACT} SELECT DISTINCT question_id, impacted FROM mentions JOIN c USING (seed)")
def impact_for_questions(spark, sf):
    return q.impact_for_questions(asked(spark, sf), _word_edges(spark, sf))


@query("impact_summary", f"""WITH RECURSIVE {ASKED}, {_IMPACT} SELECT question_id, count(DISTINCT impacted) AS n_impacted,
  'Components impacted: ' || count(DISTINCT impacted) AS summary FROM mentions JOIN c USING (seed) GROUP BY question_id""")
def impact_summary(spark, sf):
    return q.impact_summary(q.impact_sets(asked(spark, sf), _word_edges(spark, sf)))


# -- vectors -----------------------------------------------------------------------------------

@query("embed_texts")
def embed_texts(spark, sf):
    """Hashed and weighted term vectors of all documents."""
    files = bridges.prose_files(spark, sf)
    model = v.text_model(files, "content", 64)
    out = v.embed_texts(files, model)
    return out.select("path", F.size("embedding").cast("bigint").alias("dimension"),
                      F.round(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x * x), 3).alias("norm"))


@query("embed_user_model", f"SELECT path, length(content)::DOUBLE AS n_chars, (length(content) - length(replace(content, {o.NL}, '')))::DOUBLE AS n_lines FROM ({o.PROSE_FILES})")
def embed_user_model(spark, sf):
    """A user's own embedding function: here two counts as a vector."""
    def model(texts):
        return [[float(len(t)), float(t.count("\n"))] for t in texts]

    vec = bridges.prose_files(spark, sf).withColumn("e", v.embed_with(model, F.col("content")))
    return vec.select("path", F.col("e")[0].cast("double").alias("n_chars"), F.col("e")[1].cast("double").alias("n_lines"))


_TOPK = "SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM hits"


def _rounded(hits):
    return hits.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query("topk_search", f"WITH {o.topk_cte(ITEMS, K)} {_TOPK}")
def topk_search(spark, sf):
    return _rounded(v.topk_search(bridges.probe_vectors(spark, sf), bridges.vectors(spark, sf), K))


@query("topk_search_blocks", f"WITH {o.topk_cte(USERS, 15)} {_TOPK}")
def topk_search_blocks(spark, sf):
    """The same search in the form for many queries."""
    found = v.topk_search(bridges.question_vectors(spark, sf), bridges.vectors(spark, sf), 15, block_bytes=1 << 18)
    return _rounded(found)


@query("lsh_search")
def lsh_search(spark, sf):
    return _rounded(v.lsh_search(bridges.probe_vectors(spark, sf), bridges.vectors(spark, sf), K, bucket_length=0.6, tables=6))


@query("search_with_fallback", f"""WITH {o.topk_cte(USERS, K)},
  s AS (SELECT *, 1 AS stage FROM hits WHERE distance < 0.5 UNION ALL SELECT *, 2 FROM hits WHERE distance < 1.0 UNION ALL SELECT *, 3 FROM hits),
  f AS (SELECT query_id, min(stage) AS stage FROM s GROUP BY 1)
  SELECT query_id, stage::BIGINT AS stage, vec_id, rank FROM s JOIN f USING (query_id, stage)""")
def search_with_fallback(spark, sf):
    """Three searches that get less strict; the first with any hit answers."""
    found = v.topk_search(bridges.question_vectors(spark, sf), bridges.vectors(spark, sf), K)
    stages = [found.filter("distance < 0.5"), found.filter("distance < 1.0"), found]
    return flat(q.search_with_fallback(stages), "query_id", "stage", "vec_id", "rank")


@query("staged_search")
def staged_search(spark, sf):
    """Questions against a text index of all chunks: as rewritten, as asked, by their key terms; each asks what is still open."""
    folder = scratch_path(spark, "text-index")
    v.write_text_index(bridges.prose_chunks(spark, sf), folder)
    # A question that was not rewritten has been asked as it is: the same text would find nothing again.
    as_asked = F.when(F.col("question") != F.col("search_text"), F.col("question"))
    wordings = [F.col("search_text"), as_asked, F.array_join("key_terms", " ")]
    found = q.staged_search(
        asked(spark, sf), wordings, lambda questions: v.text_search(questions, folder, K, within=0.6), F.col("distance") < 0.6)
    return found.select(F.col("query_id").alias("question_id"), "stage", "id", "rank", F.round("distance", 6).alias("distance"))


@query("check_dimensions", """WITH d AS (SELECT len(embedding) AS dimension FROM embeddings UNION ALL SELECT length(event_type) FROM events),
  c AS (SELECT dimension, count(*) AS n FROM d GROUP BY 1)
  SELECT dimension, n, dimension = (SELECT dimension FROM c ORDER BY n DESC, dimension LIMIT 1) AS matches FROM c""")
def check_dimensions(spark, sf):
    """Vectors of the store next to vectors of other lengths, one per event."""
    other = bridges.table(spark, sf, "events").select(F.array_repeat(F.lit(0.0).cast("float"), F.length("event_type")).alias("embedding"))
    return v.check_dimensions(bridges.vectors(spark, sf).select("embedding").unionByName(other))


@query("distance_histogram", f"WITH {o.topk_cte(ITEMS, K)} SELECT round(distance, 2) AS distance, count(*) AS count FROM hits GROUP BY 1")
def distances(spark, sf):
    return distance_histogram(v.topk_search(bridges.probe_vectors(spark, sf), bridges.vectors(spark, sf), K))


# -- context -------------------------------------------------------------------------------------

SCORE = f"""(coalesce(list_sum(list_transform({_words('lower(question)')}, lambda t: CASE WHEN contains(lower(content), t) THEN 1.0 ELSE 0 END
    + CASE WHEN contains(lower(path), t) THEN 0.5 ELSE 0 END)), 0) + CASE
  WHEN intent = 'overview' AND {o.any_word('lower(path)', list(PROSE.priority_words))} THEN 5
  WHEN intent = 'business_logic' THEN len(business_logic_indicators) * 2 + CASE WHEN len(validation_rules) > 0 THEN 3 ELSE 0 END
  WHEN intent = 'ui_flow' THEN len(ui_elements) * 2 ELSE 0 END)::DOUBLE"""


@query("rerank", on_rows(f"""SELECT question_id, path, round(score, 6) AS score, new_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS new_rank FROM (SELECT *, {SCORE} AS score FROM rows)) WHERE new_rank <= 5"""))
def rerank(spark, sf):
    return c.rerank(rows(spark, sf), PROSE).select("question_id", "path", F.round("score", 6).alias("score"), "new_rank")


RANKED = """ranked2 AS (SELECT *, has_semantic_anchors AS anchored,
    coalesce(semantic_score, 0) + CASE WHEN has_semantic_anchors THEN 10 ELSE 0 END AS sort_score FROM rows),
  positions AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY anchored DESC, sort_score DESC, rank) AS position,
    count(*) FILTER (anchored) OVER (PARTITION BY question_id) AS n_anchored FROM ranked2)"""
FORM = f"""{o.NL} || '### 📄 ' || path || coalesce(' [' || screen_name || ']', '') || ' (' || coalesce(chunk_hierarchy, type) || ')'
  || {o.NL} || {o.NL} || {o.strip('content')} || {o.NL}"""
PACKED = f"""{RANKED},
  texts AS (SELECT *, {FORM} AS text, anchored OR (n_anchored = 0 AND semantic_score > 2.0) AS usable FROM positions),
  counted AS (SELECT *, CASE WHEN usable THEN len({_words('text')}) ELSE 0 END AS words FROM texts),
  budget AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY question_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before FROM counted),
  packed AS (SELECT *, words_before <= 800 AS within, usable AND words_before <= 800 AS taken FROM budget)"""


@query("rank_by_anchor", on_rows("").rstrip() + f", {RANKED} SELECT question_id, path, position, sort_score::DOUBLE AS sort_score FROM positions")
def rank_by_anchor(spark, sf):
    return c.rank_by_anchor(rows(spark, sf)).select("question_id", "path", "position", "sort_score")


@query("packed_hits", on_rows("").rstrip() + f", {PACKED} SELECT question_id, path, position, words, words_before::BIGINT AS words_before, taken FROM packed")
def packed_hits(spark, sf):
    return flat(c.packed_hits(rows(spark, sf), OPTIONS), "question_id", "path", "position", "words", "words_before", "taken")


CONTEXT = f"""contexts AS (SELECT question_id, count(*) FILTER (taken) AS n_chunks, coalesce(sum(words) FILTER (taken), 0)::BIGINT AS n_words, max(n_anchored) AS n_anchored,
  concat_ws({o.NL}, {o.NL} || '## 🔍 Retrieved Code Chunks (Similarity)' || {o.NL}, nullif(string_agg(text, {o.NL} ORDER BY position) FILTER (taken), ''),
    CASE WHEN bool_or(NOT within) THEN '...[Context window limit: ' || coalesce(sum(words) FILTER (taken), 0)::BIGINT || ' tokens]...' END,
    CASE WHEN max(n_anchored) > 0 THEN {o.NL} || '✅ Found ' || max(n_anchored) || ' chunks with strong semantic anchors (avg score: '
      || printf('%.1f', round_even(avg(coalesce(semantic_score, 0)) FILTER (anchored), 1)) || ')' || {o.NL}
    ELSE {o.NL} || '⚠️ No context blocks with strong semantic anchors found. Results may be less relevant.' || {o.NL} END) AS context
  FROM packed GROUP BY question_id)"""


@query("pack_context", on_rows("").rstrip() + f", {PACKED}, {CONTEXT} SELECT * FROM contexts")
def pack_context(spark, sf):
    return c.pack_context(rows(spark, sf), OPTIONS)


@query("format_chunk", o.prose(f"SELECT id, {FORM} AS text FROM chunks"))
def format_chunk(spark, sf):
    return bridges.prose_chunks(spark, sf).select("id", c.format_chunk().alias("text"))


def _prompt_sql() -> str:
    def filled(form: str) -> str:
        before, rest = form.split("{context}")
        middle, after = rest.split("{question}")
        return f"{o.lit(before)} || context || {o.lit(middle)} || search_text || {o.lit(after)}"
    return (f"CASE WHEN coalesce(context, '') = '' THEN search_text WHEN intent = 'overview' THEN {filled(c.OVERVIEW_PROMPT)} "
            f"ELSE {filled(c.CONTEXT_PROMPT)} END")


@query("build_prompts", on_rows("").rstrip() + f""", {PACKED}, {CONTEXT},
  p AS (SELECT question_id, intent, context, {SEARCH} AS search_text FROM asked LEFT JOIN contexts USING (question_id))
  SELECT question_id, {_prompt_sql()} AS prompt FROM p""")
def build_prompts(spark, sf):
    packed = c.pack_context(rows(spark, sf), OPTIONS)
    every = asked(spark, sf).join(packed.select("question_id", "context"), "question_id", "left")
    return c.build_prompts(every).select("question_id", "prompt")


@query("answer_batch", f"""WITH {o.chunks(PROSE, o.PROSE_FILES)}, {STORED_ROWS}, {PACKED}, {CONTEXT},
  p AS (SELECT question_id, intent, context, {SEARCH} AS search_text FROM asked LEFT JOIN contexts USING (question_id)),
  q AS (SELECT question_id, intent, {_prompt_sql()} AS prompt FROM p)
  SELECT question_id, intent, prompt, CASE WHEN length(prompt) > 200 THEN substr(prompt, 1, 200) || '...' ELSE prompt END AS prompt_preview FROM q""")
def answer(spark, sf):
    """The whole question batch: intent, search, context, prompt. Vector n asks for question n."""
    asked_ = bridges.questions(spark, sf).select("question_id", "question")
    vecs = bridges.vectors(spark, sf).withColumnRenamed("vec_id", "query_id")
    numbered = asked_.join(bridges.questions(spark, sf).select("question_id", F.col("conv_id").alias("query_id")), "question_id")
    stored = bridges.vectors(spark, sf)
    store = bridges.prose_chunks_of(spark, sf, stored).join(stored, "vec_id")
    per_question = numbered.join(vecs, "query_id").select(F.col("question_id").alias("query_id"), "embedding")
    return answer_batch(asked_, per_question, store, PROSE, OPTIONS).select("question_id", "intent", "prompt", "prompt_preview")


@query("context_overview", o.prose(f"""SELECT path, '▶️ ' || path || ':' || {o.NL} || arg_min({o.preview('content', 300)}, chunk_index) || {o.NL} || {o.NL} AS text
  FROM chunks GROUP BY path ORDER BY path LIMIT 3"""))
def context_overview(spark, sf):
    return c.context_overview(file_level(bridges.prose_chunks(spark, sf)))


@query("context_ui_flow", o.prose(f"""SELECT path, chunk_index, '• ' || path || ': ' || {o.preview('content', 200)} || {o.NL} AS text FROM chunks
  WHERE {o.any_word('lower(content)', PROSE.navigation_words)} ORDER BY path, chunk_index LIMIT 5"""))
def context_ui_flow(spark, sf):
    return flat(c.context_ui_flow(ui_level(bridges.prose_chunks(spark, sf), PROSE.navigation_words)))


_BIZ = f"CASE WHEN length(content) >= 200 THEN substr(content, 1, 200) || '...' ELSE content END"


@query("context_business", o.prose(f"""SELECT index_key, path, chunk_index, rule, '• (' || index_key || ') ' || path || ':' || {o.NL} || preview || {o.NL} AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY index_key ORDER BY path, chunk_index, coalesce(rule, '')) AS r FROM (
    SELECT 'business_processes' AS index_key, path, chunk_index, NULL AS rule, {_BIZ} AS preview FROM chunks WHERE list_contains(business_logic_indicators, 'validation_logic')
    UNION ALL SELECT 'calculations', path, chunk_index, NULL, {_BIZ} FROM chunks WHERE list_contains(business_logic_indicators, 'calculation')
    UNION ALL SELECT 'validation_rules', path, chunk_index, unnest(validation_rules), '' FROM chunks)) WHERE r <= 2"""))
def context_business(spark, sf):
    return flat(c.context_business(business_level(bridges.prose_chunks(spark, sf))))


_ASKED_PAIRS = f"""said AS (SELECT conv_id * 1000 + turn AS question_id, string_split(coalesce(text, ''), ' ') AS w FROM conversations),
  pairs AS (SELECT DISTINCT question_id, 'check the field ' || w[i + 1] || ' in ' || w[i] || 'Screen' AS question
    FROM (SELECT question_id, w, unnest(range(1, len(w))) AS i FROM said)),
  named AS (SELECT question_id, regexp_extract(question, '(?:field|input|of)\\s+["'']?({W}+)["'']?', 1) AS field,
    regexp_extract(question, 'in\\s+([A-Z]{W}*Screen)', 1) AS screen_name FROM pairs)"""


@query("context_validation", o.prose("").rstrip() + f""", {_ASKED_PAIRS},
  m AS (SELECT screen, field, string_agg(DISTINCT rule, ', ' ORDER BY rule) AS rules FROM (
      SELECT screen_name || 'Screen' AS screen, field, unnest(CASE WHEN len(validation_rules) = 0 THEN [NULL] ELSE validation_rules END) AS rule
      FROM (SELECT screen_name, validation_rules, unnest(input_fields) AS field FROM chunks WHERE screen_name IS NOT NULL)) GROUP BY ALL)
  SELECT question_id, named.field, screen_name, CASE WHEN m.screen IS NULL THEN NULL
    WHEN rules IS NULL THEN '## ✅ Validation Rules' || {o.NL} || '• `' || m.field || '` in `' || m.screen || '` has no explicit validation rules.' || {o.NL} || {o.NL}
    ELSE '## ✅ Validation Rules' || {o.NL} || '• `' || m.field || '` in `' || m.screen || '` is validated by: ' || rules || {o.NL} || {o.NL} END AS text
  FROM named LEFT JOIN m ON m.screen = screen_name AND m.field = named.field""")
def context_validation(spark, sf):
    """Questions that name a field and a screen, one for every two neighbouring words of every turn."""
    said = bridges.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.split(F.coalesce("text", F.lit("")), " ", -1).alias("w"))
    pairs = said.select("question_id", F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("screen"), F.slice("w", F.lit(2), F.size("w")).alias("field"))).alias("p")).select(
        "question_id", F.concat(F.lit("check the field "), "p.field", F.lit(" in "), "p.screen", F.lit("Screen")).alias("question")).distinct()
    screens = screen_input_map(bridges.prose_chunks(spark, sf)).withColumn("screen_name", F.concat("screen_name", F.lit("Screen")))
    return c.context_validation(pairs, screens)


@query("turn_history", on_rows("").rstrip() + f""", s AS (SELECT question_id, list(path ORDER BY rank) AS sources FROM rows GROUP BY 1),
  last AS (SELECT conv_id, max(turn) AS t FROM asked GROUP BY 1)
  SELECT conv_id, turn, turn = t AS expanded, 'Q: ' || question || ' [' || CASE intent WHEN 'overview' THEN 'Overview' WHEN 'validation' THEN 'Validation' WHEN 'ui_flow' THEN 'Ui Flow'
      WHEN 'business_logic' THEN 'Business Logic' WHEN 'impact_analysis' THEN 'Impact Analysis' ELSE 'Technical' END || ']' AS title,
    printf('%.1f%%', confidence * 100) AS confidence, CASE WHEN intent = 'overview' THEN {SEARCH} END AS enhanced_query, {o.joined('sources[1:5]')} AS sources
  FROM asked JOIN last USING (conv_id) LEFT JOIN s USING (question_id)""")
def turn_history(spark, sf):
    sources = rows(spark, sf).groupBy("question_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("sources"))
    turns = asked(spark, sf).join(sources, "question_id", "left")
    return flat(c.turn_history(turns))


# -- evaluation --------------------------------------------------------------------------------

TERMS = f"list_filter({_words('lower(question)')}, lambda t: contains(lower(content), t))"
RELEVANT = f"(len({TERMS}) > 0)"


@query("query_relevance", on_probes(f"""SELECT question_id, rank, path AS source, type, chunk_index, {o.preview('content', 500)} AS content_preview,
  length(content) AS content_length, {o.joined(TERMS)} AS matching_terms,
  {o.joined(o.tags([('screen_name', 'screen_name IS NOT NULL'), ('class_names', 'len(class_names) > 0'), ('function_names', 'len(function_names) > 0'), ('component_name', 'component_name IS NOT NULL')]))} AS anchors FROM rows"""))
def query_relevance(spark, sf):
    return flat(e.query_relevance(probe_rows(spark, sf)))


METRICS = f"""m AS (SELECT question_id, any_value(suite) AS suite, count(path) AS retrieved, count(DISTINCT path) AS unique_sources,
  count(*) FILTER (path IS NOT NULL AND relevant) AS relevant_docs FROM (SELECT p.question_id, p.suite, r.path, r.relevant FROM probes p
    LEFT JOIN (SELECT question_id, path, {RELEVANT} AS relevant FROM rows) r USING (question_id)) GROUP BY question_id),
  rates AS (SELECT *, CASE WHEN retrieved > 0 THEN relevant_docs::DOUBLE / retrieved ELSE 0 END AS relevance_rate FROM m)"""


@query("query_metrics", on_probes("").rstrip() + f", {METRICS} SELECT question_id, retrieved, unique_sources, relevant_docs, round(relevance_rate, 6) AS relevance_rate FROM rates")
def query_metrics(spark, sf):
    return e.query_metrics(probes(spark, sf), probe_rows(spark, sf)).select(
        "question_id", "retrieved", "unique_sources", "relevant_docs", F.round("relevance_rate", 6).alias("relevance_rate"))


@query("suite_metrics", on_probes("").rstrip() + f""", {METRICS} SELECT suite, count(*) AS queries, count(*) AS successful, round(avg(retrieved), 6) AS avg_retrieved,
  round(avg(relevance_rate), 6) AS avg_relevance, CASE WHEN avg(relevance_rate) > 0.7 THEN 'high' WHEN avg(relevance_rate) > 0.5 THEN 'moderate' ELSE 'low' END AS band FROM rates GROUP BY suite""")
def suite_metrics(spark, sf):
    return e.suite_metrics(e.query_metrics(probes(spark, sf), probe_rows(spark, sf)))


@query("compare_queries", on_probes("").rstrip() + f""", s AS (SELECT question_id, list_distinct(list(path)) AS sources, avg(CASE WHEN {RELEVANT} THEN 1.0 ELSE 0 END) AS rate FROM rows GROUP BY 1)
  SELECT a.question_id AS pair_id, len(list_intersect(a.sources, b.sources)) AS common, len(a.sources) - len(list_intersect(a.sources, b.sources)) AS only_left,
    len(b.sources) - len(list_intersect(a.sources, b.sources)) AS only_right, round(a.rate, 6) AS left_relevance, round(b.rate, 6) AS right_relevance,
    CASE WHEN abs(a.rate - b.rate) < 0.1 THEN 'similar' WHEN a.rate > b.rate THEN 'left' ELSE 'right' END AS better
  FROM s a JOIN s b ON b.question_id = a.question_id + 1""")
def compare_queries(spark, sf):
    """Every probe against the next one."""
    pairs = probes(spark, sf).select(F.col("question_id").alias("pair_id"), F.col("question_id").alias("left_id"), (F.col("question_id") + 1).alias("right_id"))
    return e.compare_queries(pairs, probe_rows(spark, sf))


@query("multi_query_results", on_probes(f"SELECT question_id, rank, path AS source, {o.preview('content', 200)} AS content, round(distance, 6) AS score FROM rows WHERE rank <= 5"))
def multi_query_results(spark, sf):
    return e.multi_query_results(probe_rows(spark, sf))


@query("retrieval_health", on_probes(f"""SELECT question_id, count(r.rank) AS hits, arg_min(r.path, r.rank) AS top_source, arg_min(r.a, r.rank) AS top_anchors, count(r.rank) > 0 AS healthy
  FROM probes LEFT JOIN (SELECT question_id, rank, path, array_to_string({o.tags([('class_names', 'len(class_names) > 0'), ('function_names', 'len(function_names) > 0'), ('screen_name', 'screen_name IS NOT NULL'), ('component_name', 'component_name IS NOT NULL')])}, ',') AS a FROM rows) r USING (question_id) GROUP BY question_id"""))
def retrieval_health(spark, sf):
    return e.retrieval_health(probes(spark, sf), probe_rows(spark, sf)).select("question_id", "hits", "top_source", "top_anchors", "healthy")


@query("retrieval_patterns", on_probes("SELECT question_id, count(*) AS results, count(DISTINCT path) AS unique_files FROM rows WHERE rank <= 3 GROUP BY 1"))
def retrieval_patterns(spark, sf):
    return e.retrieval_patterns(probe_rows(spark, sf))


ANSWERS = f"""n AS (SELECT question_id, count(*) AS n_sources FROM rows GROUP BY 1),
  answers AS (SELECT a.question_id, intent, confidence, {SEARCH} AS rewritten_query, coalesce(b.text, '') AS answer, b.text IS NOT NULL AS answered, coalesce(n_sources, 0) AS n_sources
    FROM asked a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' LEFT JOIN n USING (question_id)),
  quality AS (SELECT *, CASE WHEN length(answer) > 50 THEN least(10.0, length(answer) / 20.0) ELSE 0 END::DOUBLE AS relevance_score, 8.0::DOUBLE AS completeness_score,
    CASE WHEN contains(answer, '•') OR contains(answer, '-') OR contains(answer, {o.NL}) THEN 8 WHEN length(answer) > 100 THEN 6 ELSE 4 END::DOUBLE AS clarity_score,
    least(10, n_sources * 2)::DOUBLE AS source_utilization, 10.0::DOUBLE AS metadata_completeness FROM answers),
  mean AS (SELECT *, (relevance_score + completeness_score + clarity_score + source_utilization + metadata_completeness) / 5.0 AS m FROM quality),
  rated AS (SELECT *, CASE WHEN m >= 7 THEN least(10, floor(m)) ELSE greatest(1, floor(m * 0.8)) END::BIGINT AS satisfaction FROM mean)"""


def _scored(spark, sf):
    counts = rows(spark, sf).groupBy("question_id").agg(F.count(F.lit(1)).alias("n_sources"))
    replies = bridges.table(spark, sf, "conversations").filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    turns = (
        asked(spark, sf).withColumnRenamed("search_text", "rewritten_query")
        .join(replies, ["conv_id", "turn"], "left").join(counts, "question_id", "left")
        .withColumn("n_sources", F.coalesce("n_sources", F.lit(0).cast("bigint")))
        .withColumn("status", F.when(F.col("answer").isNotNull(), "success").otherwise("failed"))
        .withColumn("expected_rating", F.lit(7))
    )
    return e.satisfaction(e.answer_quality(turns))


@query("answer_quality", on_rows("").rstrip() + f", {ANSWERS} SELECT question_id, {', '.join(f'round({s}, 6) AS {s}' for s in e.SCORES)} FROM quality")
def answer_quality(spark, sf):
    return _scored(spark, sf).select("question_id", *[F.round(s, 6).alias(s) for s in e.SCORES])


@query("satisfaction", on_rows("").rstrip() + f", {ANSWERS} SELECT question_id, satisfaction FROM rated")
def satisfaction(spark, sf):
    return flat(_scored(spark, sf), "question_id", "satisfaction")


@query("run_summary", on_rows("").rstrip() + f""", {ANSWERS}, t AS (SELECT count(*) AS total, count(*) FILTER (answered) AS passed, round(avg(satisfaction) FILTER (answered), 2) AS average_satisfaction FROM rated)
  SELECT total, passed, average_satisfaction, total - passed AS failed, round(passed * 100.0::DOUBLE / total, 2) AS success_rate,
    {o.joined(o.tags([(e.ADVICE['quality'], 'average_satisfaction < 4'), (e.ADVICE['failures'], 'total > passed'), (e.ADVICE['rate'], 'round(passed * 100.0::DOUBLE / total, 2) < 80')]))} AS advice FROM t""")
def run_summary(spark, sf):
    return flat(e.run_summary(_scored(spark, sf)))
