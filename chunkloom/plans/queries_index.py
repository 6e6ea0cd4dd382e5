"""Queries over the index levels and the dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkloom.operators import indexes
from chunkloom.operators.graph import impact_closure, impact_of_all
from chunkloom.plans import bridges, oracle as o
from chunkloom.plans.registry import flat, query
from chunkloom.profiles import BUSINESS_KEYS

SHOWN = o.preview("content", 200)
_FIRST = "arg_min(CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END, chunk_index)"
FILE_LEVEL = f"""SELECT path, count(*) AS chunk_count, arg_min(file_type, chunk_index) AS file_type,
  {_FIRST} AS first_chunk_preview FROM chunks GROUP BY path"""
_KINDS = [("function", "function_names"), ("class", "class_names"), ("dependency", "dependencies"),
          ("indicator", "business_logic_indicators"), ("ui_element", "ui_elements")]


@query("file_level", o.all_code(FILE_LEVEL))
def file_level(spark, sf):
    return indexes.file_level(bridges.all_code_chunks(spark, sf))


@query("file_members", o.all_code(" UNION ALL ".join(
    [f"SELECT DISTINCT path, '{k}' AS kind, unnest({c}) AS value FROM chunks" for k, c in _KINDS]
    + ["SELECT DISTINCT path, 'chunk_type' AS kind, type AS value FROM chunks"])))
def file_members(spark, sf):
    return indexes.file_members(bridges.all_code_chunks(spark, sf))


@query("component_level", o.all_code("""SELECT 'classes' AS kind, unnest(class_names) AS name, path, chunk_index FROM chunks WHERE type = 'class'
  UNION ALL SELECT 'functions', unnest(function_names), path, chunk_index FROM chunks WHERE type = 'function'"""))
def component_level(spark, sf):
    return flat(indexes.component_level(bridges.all_code_chunks(spark, sf)))


@query("module_level", o.prose("""SELECT 'modules' AS kind, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS name, path, chunk_index
  FROM chunks WHERE NOT has_semantic_anchors"""))
def module_level(spark, sf):
    """Chunks of type module are listed under the name of their file."""
    chunks = bridges.prose_chunks(spark, sf).filter("not has_semantic_anchors").withColumn("type", F.lit("module"))
    return flat(indexes.component_level(chunks))


_KEYS = " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in BUSINESS_KEYS.items())


@query("business_level", o.all_code(f"""SELECT CASE tag {_KEYS} END AS index_key, path, chunk_index,
    CASE WHEN length(content) >= 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview, NULL AS rule
  FROM (SELECT *, unnest(business_logic_indicators) AS tag FROM chunks)
  UNION ALL SELECT 'validation_rules', path, chunk_index, NULL, unnest(validation_rules) FROM chunks"""))
def business_level(spark, sf):
    return flat(indexes.business_level(bridges.all_code_chunks(spark, sf)))


@query("ui_level", o.prose(f"""SELECT 'ui_component' AS kind, unnest(ui_elements) AS name, path, chunk_index, NULL AS preview FROM chunks
  UNION ALL SELECT 'screen', screen_name, path, chunk_index, {SHOWN} FROM chunks WHERE screen_name IS NOT NULL
  UNION ALL SELECT 'navigation_flow', NULL, path, chunk_index, {SHOWN} FROM chunks
    WHERE {o.any_word('lower(content)', bridges.PROSE.navigation_words)}"""))
def ui_level(spark, sf):
    return flat(indexes.ui_level(bridges.prose_chunks(spark, sf), bridges.PROSE.navigation_words))


@query("relationship_edges", o.all_code("SELECT DISTINCT path AS src, unnest(dependencies) AS dep FROM chunks"))
def relationship_edges(spark, sf):
    return indexes.relationship_edges(bridges.all_code_chunks(spark, sf))


@query("dependency_level", o.all_code("""SELECT src, dep, CASE WHEN EXISTS (SELECT 1 FROM paths WHERE contains(p, lower(dep)))
    THEN 'internal' ELSE 'external' END AS scope
  FROM (SELECT DISTINCT path AS src, unnest(dependencies) AS dep FROM chunks),
    (SELECT 1) AS one""".replace("FROM paths", "FROM (SELECT DISTINCT lower(path) AS p FROM chunks)").replace(
        ",\n    (SELECT 1) AS one", "")))
def dependency_level(spark, sf):
    return indexes.dependency_level(bridges.all_code_chunks(spark, sf))


_LINKS = """links AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') || '.html' AS src,
  unnest(regexp_extract_all(html, 'href="/?([^"]*)"', 1)) AS dep FROM pages)"""


@query("page_dependencies", f"""WITH {_LINKS}, p AS (SELECT DISTINCT lower(src) AS p FROM links)
  SELECT dep, CASE WHEN EXISTS (SELECT 1 FROM p WHERE contains(p, lower(dep))) THEN 'internal' ELSE 'external' END AS scope
  FROM (SELECT DISTINCT dep FROM links WHERE dep <> '')""")
def page_dependencies(spark, sf):
    """Link targets of the pages, internal when they occur inside any address."""
    pages = bridges.table(spark, sf, "pages").select(
        F.concat(F.regexp_replace("url", "^https?://", ""), F.lit(".html")).alias("path"),
        F.explode(F.regexp_extract_all("html", F.lit('href="/?([^"]*)"'), F.lit(1))).alias("dep"))
    return indexes.classify_dependencies(pages, pages.select("path"))


@query("api_level", f"""WITH files AS ({o.WEB_FILES}), t AS (SELECT path, content,
    list_sort(list_distinct(regexp_extract_all(content, 'href="([^"]*)"', 1))) AS api,
    list_sort(list_distinct(regexp_extract_all(content, 'track\\((\\d+)\\)', 1))) AS db FROM files)
  SELECT 'endpoint' AS kind, unnest(api) AS name, path, 0::BIGINT AS chunk_index, {SHOWN} AS preview FROM t
  UNION ALL SELECT 'database_operation', unnest(db), path, 0, {SHOWN} FROM t""")
def api_level(spark, sf):
    """Links stand in for endpoints and tracking calls for database operations."""
    c = F.col("content")
    chunks = bridges.web_files(spark, sf).select(
        "path", "content", F.lit(0).alias("chunk_index"),
        F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit('href="([^"]*)"'), F.lit(1)))).alias("api_endpoints"),
        F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(r"track\((\d+)\)"), F.lit(1)))).alias("db_operations"))
    return flat(indexes.api_level(chunks))


@query("input_map", o.all_code("""SELECT DISTINCT screen_name, field, rule FROM (
    SELECT screen_name, unnest(input_fields) AS field, validation_rules FROM chunks WHERE screen_name IS NOT NULL),
    LATERAL (SELECT unnest(validation_rules) AS rule)
  UNION SELECT screen_name, field, NULL FROM (SELECT screen_name, unnest(input_fields) AS field, validation_rules FROM chunks WHERE screen_name IS NOT NULL)
    GROUP BY screen_name, field HAVING max(len(validation_rules)) = 0"""))
def input_map(spark, sf):
    return indexes.screen_input_map(bridges.all_code_chunks(spark, sf))


_MISSING = {
    "missing_files": "coalesce(path, '') = ''",
    "missing_components": "len(class_names) = 0 AND len(function_names) = 0",
    "missing_business": "len(business_logic_indicators) = 0",
    "missing_ui": "len(ui_elements) = 0 AND screen_name IS NULL",
    "missing_deps": "len(dependencies) = 0",
    "missing_apis": "true",
}


@query("missing_stats", o.all_code(
    "SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _MISSING.items()) + " FROM chunks"))
def missing_stats(spark, sf):
    return indexes.missing_stats(bridges.all_code_chunks(spark, sf))


@query("missing_rows", o.all_code(" UNION ALL ".join(
    f"SELECT '{n}' AS level, path, chunk_index FROM chunks WHERE {c}" for n, c in _MISSING.items())))
def missing_rows(spark, sf):
    return flat(indexes.missing_rows(bridges.all_code_chunks(spark, sf)))


@query("level_for_intent", f"SELECT event_id, CASE event_type WHEN 'click' THEN 'ui_level' WHEN 'view' THEN 'file_level' WHEN 'error' THEN 'api_level' END AS level FROM events")
def level_for_intent(spark, sf):
    intents = F.when(F.col("event_type") == "click", "ui_flow").when(F.col("event_type") == "view", "overview").when(
        F.col("event_type") == "error", "api").otherwise("unheard_of")
    asked = bridges.table(spark, sf, "events").select("event_id", intents.alias("intent"))
    return indexes.level_for_intent(asked).select("event_id", "level")


@query("anchor_quality", o.all_code("""SELECT count(*) AS files, count(*) AS files_with_chunks, 100.0::DOUBLE AS anchor_quality, 'good' AS band
  FROM (SELECT DISTINCT path FROM chunks)"""))
def anchor_quality(spark, sf):
    return indexes.anchor_quality(indexes.file_level(bridges.all_code_chunks(spark, sf)))


@query("impact_closure", """WITH RECURSIVE c(seed, impacted) AS (
    SELECT s.seed, p_partkey FROM part, (VALUES (1::BIGINT), (5), (77)) AS s(seed) WHERE p_partkey // 2 = s.seed AND p_partkey <> s.seed
    UNION SELECT c.seed, p.p_partkey FROM c JOIN part p ON p.p_partkey // 2 = c.impacted AND p.p_partkey <> c.impacted)
  SELECT seed, impacted FROM c""")
def closure(spark, sf):
    """All parts that transitively hang below three seeds."""
    seeds = spark.createDataFrame([(1,), (5,), (77,)], "seed bigint")
    return impact_closure(bridges.part_edges(spark, sf), seeds)


_FIRST = "^([A-Za-z]+) +([A-Za-z]+)"


@query("word_closure", f"""WITH RECURSIVE lines AS (SELECT DISTINCT regexp_extract(line, '{_FIRST}', 0) AS pair
    FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '{_FIRST}')),
  edges AS (SELECT DISTINCT lower(regexp_extract(pair, '{_FIRST}', 1)) AS src, lower(regexp_extract(pair, '{_FIRST}', 2)) AS dep FROM lines),
  nodes AS (SELECT src AS node FROM edges UNION SELECT dep FROM edges),
  c AS (SELECT dep AS seed, src AS impacted FROM edges
    UNION SELECT c.seed, e.src FROM c JOIN edges e ON e.dep = c.impacted),
  mutual AS (SELECT c.seed AS node, c.impacted AS other FROM c JOIN c r ON r.seed = c.impacted AND r.impacted = c.seed UNION SELECT node, node FROM nodes),
  m AS (SELECT node, min(other) AS component, count(*) AS n_members FROM mutual GROUP BY node),
  n AS (SELECT seed AS node, count(*) AS n_impacted FROM c GROUP BY seed)
  SELECT node, component, n_members, coalesce(n_impacted, 0) AS n_impacted FROM m LEFT JOIN n USING (node)""")
def word_closure(spark, sf):
    """Cyclic graph over whole texts: the first word of every line depends on its second; all nodes at once."""
    docs = bridges.table(spark, sf, "documents")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(_FIRST))
    pairs = lines.select(F.regexp_extract("line", _FIRST, 0).alias("pair")).distinct()
    edges = pairs.select(
        F.lower(F.regexp_extract("pair", _FIRST, 1)).alias("src"), F.lower(F.regexp_extract("pair", _FIRST, 2)).alias("dep")).distinct()
    return impact_of_all(edges)


@query("resolved_edges", f"""WITH {o.chunks(bridges.CODE_PROFILES['de'], o.code_files('de'))},
  files2 AS (SELECT DISTINCT path, regexp_extract(path, '([^/]*)_[^/]*$', 1) AS m FROM chunks),
  e AS (SELECT DISTINCT path AS src, lower(unnest(dependencies)) AS dep FROM chunks)
  SELECT DISTINCT src, path AS dep FROM e JOIN files2 ON m = dep""")
def resolved_edges(spark, sf):
    """Import tokens of the javascript files resolved to files by module name."""
    chunks = bridges.code_chunks(spark, sf, "de")
    edges = indexes.relationship_edges(chunks).select("src", F.lower("dep").alias("dep"))
    named = chunks.select("path").distinct().select(F.regexp_replace("path", "_[^/]*$", ".js").alias("path"), F.col("path").alias("real"))
    resolved = indexes.resolve_edges(edges, named.select("path").distinct())
    return resolved.join(named, resolved["dep"] == named["path"]).select("src", F.col("real").alias("dep")).distinct()
