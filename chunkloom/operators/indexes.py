"""Index levels as tables.

Postings stay long (one row per name and chunk) instead of being gathered into nested
lists: a widget or a dependency may occur in a third of all chunks, and no single task or
row should have to hold them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkloom.functions import paths
from chunkloom.functions.text import contains_any, head, preview
from chunkloom.profiles import NAVIGATION_WORDS, business_key_table, level_table
from chunkloom.session import cut_lineage

_MEMBERS = {
    "function": "function_names",
    "class": "class_names",
    "dependency": "dependencies",
    "indicator": "business_logic_indicators",
    "ui_element": "ui_elements",
    "api_endpoint": "api_endpoints",
}


def _items(chunks: DataFrame, column: str) -> Column:
    """The list column, empty when the chunks do not carry it."""
    if column in chunks.columns:
        return F.coalesce(F.col(column), F.array().cast("array<string>"))
    return F.array().cast("array<string>")


# -- file level ------------------------------------------------------------------------------

def file_level(chunks: DataFrame) -> DataFrame:
    """Per file: chunk count, file type of its first chunk, preview of its first non-empty one."""
    order = F.struct("chunk_index")
    return chunks.groupBy("path").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.min_by("file_type", order).alias("file_type"),
        F.coalesce(
            F.min_by(preview(F.col("content"), 300), F.when(F.col("content") != "", F.col("chunk_index"))), F.lit("")
        ).alias("first_chunk_preview"),
    )


def file_members(chunks: DataFrame) -> DataFrame:
    """Distinct ``(path, kind, value)``: chunk types, functions, classes, dependencies, ..."""
    def members(kind: str, column: str) -> Column:
        return F.transform(_items(chunks, column), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    kinds = [members(kind, column) for kind, column in _MEMBERS.items()]
    kinds.append(F.array(F.struct(
        F.lit("chunk_type").alias("kind"), F.coalesce("type", F.lit("unknown")).alias("value")
    )))
    return chunks.select("path", F.explode(F.concat(*kinds)).alias("m")).select("path", "m.*").distinct()


# -- component level -------------------------------------------------------------------------

def component_level(chunks: DataFrame) -> DataFrame:
    """``(kind, name, path, chunk_index)`` by chunk type: a class chunk lists its classes, a
    function chunk its functions, an interface chunk its interfaces, a module its file."""
    def entries(kind: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    module = F.array_compact(F.array(paths.module_name(F.col("path"))))
    none = F.array().cast("array<struct<kind:string,name:string>>")
    rows = (
        F.when(F.col("type") == "class", entries("classes", _items(chunks, "class_names")))
        .when(F.col("type") == "function", entries("functions", _items(chunks, "function_names")))
        .when(F.col("type") == "interface", entries("interfaces", _items(chunks, "interface_names")))
        .when(F.col("type") == "module", entries("modules", module))
        .otherwise(none)
    )
    return chunks.select("path", "chunk_index", F.explode(rows).alias("e")).select("e.*", "path", "chunk_index")


# -- business level --------------------------------------------------------------------------

def business_level(chunks: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``(index_key, path, chunk_index, preview, rule)``: a row per indicator and per rule."""
    keys = keys if keys is not None else business_key_table(chunks.sparkSession)
    text = head(F.col("content"), 200)
    # This level marks 200 characters as cut even when nothing was cut.
    shown = F.when(F.length(text) >= 200, F.concat(text, F.lit("..."))).otherwise(text)
    def entry(indicator: Column, text: Column, rule: Column, ruled: bool) -> Column:
        return F.struct(indicator.alias("indicator"), text.alias("preview"), rule.alias("rule"), F.lit(ruled).alias("ruled"))

    none = F.lit(None).cast("string")
    # Indicators and rules leave in one pass over the chunks.
    entries = F.concat(
        F.transform(_items(chunks, "business_logic_indicators"), lambda i: entry(i, shown, none, False)),
        F.transform(_items(chunks, "validation_rules"), lambda r: entry(none, none, r, True)),
    )
    rows = chunks.select("path", "chunk_index", F.explode(entries).alias("e")).select("path", "chunk_index", "e.*")
    return (
        rows.join(F.broadcast(keys), "indicator", "left").where(F.col("ruled") | F.col("index_key").isNotNull())
        .select(
            F.when(F.col("ruled"), "validation_rules").otherwise(F.col("index_key")).alias("index_key"),
            "path", "chunk_index", "preview", "rule",
        )
    )


# -- user-interface level --------------------------------------------------------------------

def ui_level(chunks: DataFrame, navigation_words: list[str] = NAVIGATION_WORDS) -> DataFrame:
    """``(kind, name, path, chunk_index, preview)`` for components, screens, navigation flows."""
    shown = preview(F.col("content"), 200)

    def entry(kind: str, name: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), text.alias("preview"))

    no_text = F.lit(None).cast("string")
    navigates = contains_any(F.lower(F.col("content")), navigation_words)
    rows = F.concat(
        F.transform(_items(chunks, "ui_elements"), lambda e: entry("ui_component", e, no_text)),
        F.array_compact(F.array(
            F.when(F.col("screen_name").isNotNull(), entry("screen", F.col("screen_name"), shown)),
            F.when(navigates, entry("navigation_flow", no_text, shown)),
        )),
    )
    return chunks.select("path", "chunk_index", F.explode(rows).alias("e")).select(
        "e.kind", "e.name", "path", "chunk_index", "e.preview"
    )


# -- dependency level ------------------------------------------------------------------------

def relationship_edges(chunks: DataFrame) -> DataFrame:
    """Distinct ``(src, dep)``: the dependencies of a file over all its chunks."""
    return chunks.select(F.col("path").alias("src"), F.explode(_items(chunks, "dependencies")).alias("dep")).distinct()


def classify_dependencies(deps: DataFrame, files: DataFrame) -> DataFrame:
    """``(dep, scope)``: internal when the token occurs inside any indexed path, any case.

    Substring containment as equi-joins: every position of a path offers the key of its
    first one, two or three characters; keys of known tokens say which lengths to cut
    there; the distinct cuts meet the tokens on equality. Cuts are made distinct on the
    map side, so shared path prefixes are not a hot key, and no path meets a token that
    does not occur in it.
    """
    tokens = deps.select("dep").distinct().filter("dep <> ''").withColumn("low", F.lower("dep"))
    keys = (
        tokens.select(F.substring("low", 1, 3).alias("key"), F.length("low").alias("n")).distinct()
        .groupBy("key").agg(F.collect_list("n").alias("lengths"))   # lengths of one token each, few
    )
    low = F.lower(F.col("path"))
    heads = (
        files.select(low.alias("p")).distinct()
        .select("p", F.explode(F.sequence(F.lit(1), F.length("p"))).alias("at"))
        .select("p", "at", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("w"))
        .filter("at + w - 1 <= length(p)")
        .withColumn("key", F.substring(F.col("p"), F.col("at"), F.col("w")))
    )
    cuts = (
        heads.join(keys, "key")
        .select("p", "at", F.explode("lengths").alias("n"))
        .filter("at + n - 1 <= length(p)")
        .select(F.substring(F.col("p"), F.col("at"), F.col("n")).alias("low")).distinct()
        .withColumn("found", F.lit(True))
    )
    return tokens.join(cuts, "low", "left").select(
        "dep", F.when(F.col("found"), "internal").otherwise("external").alias("scope")
    )


def dependency_level(chunks: DataFrame) -> DataFrame:
    """``(src, dep, scope)``: the import graph with every token marked internal or external.

    Edges and paths are used three times; they are cut from the chunks once and checkpointed.
    """
    pairs = cut_lineage(
        chunks.select(F.col("path").alias("src"), F.explode_outer(_items(chunks, "dependencies")).alias("dep")).distinct()
    )
    edges = pairs.filter("dep is not null")
    scopes = classify_dependencies(edges, pairs.select(F.col("src").alias("path")))
    return edges.join(scopes, "dep").select("src", "dep", "scope")


def resolve_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Token edges to file edges: a token names the files whose module name it equals."""
    modules = files.select(F.col("path").alias("dep_path"), paths.module_name(F.col("path")).alias("dep"))
    return edges.join(modules, "dep").select("src", F.col("dep_path").alias("dep")).distinct()


# -- api level, screen map -------------------------------------------------------------------

def api_level(chunks: DataFrame) -> DataFrame:
    """``(kind, name, path, chunk_index, preview)`` per endpoint and per database operation."""
    def entries(kind: str, column: str) -> Column:
        return F.transform(_items(chunks, column), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("name")))

    rows = F.concat(entries("endpoint", "api_endpoints"), entries("database_operation", "db_operations"))
    return chunks.select(
        "path", "chunk_index", preview(F.col("content"), 200).alias("preview"), F.explode(rows).alias("e")
    ).select("e.*", "path", "chunk_index", "preview")


def screen_input_map(chunks: DataFrame) -> DataFrame:
    """Distinct ``(screen_name, field, rule)``; a field without any rule has one null-rule row."""
    pairs = (
        chunks.filter("screen_name is not null")
        .select("screen_name", F.explode(_items(chunks, "input_fields")).alias("field"),
                _items(chunks, "validation_rules").alias("rules"))
        .select("screen_name", "field", F.explode_outer("rules").alias("rule"))
        .distinct()
    )
    # Distinct pairs: a field has at most one row per rule tag, so the window is tiny.
    n_rules = F.count("rule").over(Window.partitionBy("screen_name", "field"))
    return pairs.withColumn("_n", n_rules).filter("rule is not null or _n = 0").drop("_n")


# -- quality of the index --------------------------------------------------------------------

def _missing_conditions(chunks: DataFrame) -> dict[str, Column]:
    def empty(*columns: str) -> Column:
        parts = []
        for c in columns:
            if c not in chunks.columns:
                parts.append(F.lit(True))
            elif dict(chunks.dtypes)[c].startswith("array<"):
                parts.append(F.coalesce(F.size(c) <= 0, F.lit(True)))
            else:
                parts.append(F.coalesce(F.col(c) == "", F.lit(True)))
        return reduce(lambda a, b: a & b, parts)

    return {
        "missing_files": empty("path"),
        "missing_components": empty("class_names", "function_names"),
        "missing_business": empty("business_logic_indicators"),
        "missing_ui": empty("ui_elements", "screen_name"),
        "missing_deps": empty("dependencies"),
        "missing_apis": empty("api_endpoints", "db_operations"),
    }


def missing_stats(chunks: DataFrame) -> DataFrame:
    """One row: per level, the number of chunks without its key field."""
    return chunks.agg(*[F.count_if(c).alias(n) for n, c in _missing_conditions(chunks).items()])


def missing_rows(chunks: DataFrame) -> DataFrame:
    """``(level, path, chunk_index)`` of every chunk that lacks the key field of a level."""
    levels = [F.when(c, F.lit(n)) for n, c in _missing_conditions(chunks).items()]
    return chunks.select(F.explode(F.array_compact(F.array(*levels))).alias("level"), "path", "chunk_index")


def level_for_intent(questions: DataFrame) -> DataFrame:
    """Adds ``level``, the index level that serves the intent; null for an unknown intent."""
    return questions.join(F.broadcast(level_table(questions.sparkSession)), "intent", "left")


def index_level_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(level, entries, present)`` for every level."""
    counts = [
        t.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(name).alias("level"), "entries")
        for name, t in tables.items()
    ]
    out = reduce(lambda a, b: a.unionByName(b), counts)
    return out.select("level", "entries", (F.col("entries") > 0).alias("present"))


def anchor_quality(files: DataFrame) -> DataFrame:
    """Share of indexed files that have chunks, with its band."""
    share = F.avg(F.when(F.col("chunk_count") > 0, 1.0).otherwise(0.0)) * 100
    stats = files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("chunk_count") > 0).alias("files_with_chunks"),
        F.round(share, 2).alias("anchor_quality"),
    )
    band = F.when(F.col("anchor_quality") > 80, "good").when(F.col("anchor_quality") > 60, "fair").otherwise("poor")
    return stats.withColumn("band", band)


def build_index(chunks: DataFrame, navigation_words: list[str] = NAVIGATION_WORDS) -> dict[str, DataFrame]:
    """All index tables of a chunk table."""
    return {
        "file_level": file_level(chunks),
        "file_members": file_members(chunks),
        "component_level": component_level(chunks),
        "business_level": business_level(chunks),
        "ui_level": ui_level(chunks, navigation_words),
        "dependency_level": dependency_level(chunks),
        "api_level": api_level(chunks),
        "screen_input_validation_map": screen_input_map(chunks),
    }
