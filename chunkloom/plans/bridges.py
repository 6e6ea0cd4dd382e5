"""The given tables seen as the inputs of the operators.

``documents`` are files of prose, and, rewritten line by line, files of source code;
``pages`` are web files; ``conversations`` hold the questions; ``embeddings`` are chunk
vectors; ``events`` are log lines and build events; ``part`` carries a dependency tree.
"""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chunkloom.operators.chunking import cut_files, describe_chunks
from chunkloom.operators.metadata import enrich_chunks
from chunkloom.profiles import PROFILES, Profile
from chunkloom.session import spread

# A profile of prose: the same rules as for code, with words that occur in prose.
PROSE = Profile(
    name="prose",
    extensions=(".en", ".fr", ".de", ".es"),
    ignore=("*7.de", "src3/"),
    chunk_types={
        "class": [r"^\s*(?:The|Le|La|Der|Die|Los)\s+\w+"],
        "function": [r"^\s*(?:And|Et|Und|Of|De|In|En|To|For)\s+\w+"],
        "module": [r"^\s*(?:Copyright|Licensed|Permission)"],
        "paragraph": [r"^\s*[A-Z]\w*"],
    },
    screens=(r"([A-Z][a-z]*tion)", r"([A-Z][a-z]*ment)"),
    components=(r"of the (\w+)", r"de la (\w+)"),
    priority_words=("src1", "src4"),
    keywords=("prose", "text"),
    function_patterns={"en": [r" of (\w+)", r" in (\w+)"], "fr es": [r" de (\w+)"], "de": [r" der (\w+)"]},
    class_patterns={"en": [r" the (\w+)"], "fr": [r" les (\w+)"], "es": [r" los (\w+)"], "de": [r" die (\w+)"]},
    input_patterns={"en": [r" that (\w+)"], "fr": [r" que (\w+)"], "de": [r" mit (\w+)"]},
    validation_patterns={
        "email_format_check": r"\w@\w", "regex_match": r"\d{3}\.\d", "length_check": r"token\s*=", "custom_validator": r"[Nn]icht",
    },
    indicator_words={
        "calculation": ["ingon", "heit", "tionan"], "validation_logic": ["token", "esand"],
        "workflow": ["onre", "setError"], "authorization": ["thethe", "entre"],
    },
    ui_elements=["Stone", "Keit", "Mentai", "Tionth", "Rent"],
    navigation_words=["thenre", "auxen", "keitsch"],
    unicode_classes=False,
)

# Line rewrites that turn prose into code: (pattern, replacement with {1} and {2}).
CODE_RULES = {
    "en": ("kt", "android", [
        (r"(?m)^([A-D][a-z]+) ([a-z]+)", "@{1}\nclass {1} : {2}"),
        (r"(?m)^([E-H][a-z]+) ([a-z]+)", "private fun {2}({1}) TextField(value = {2})"),
        (r"(?m)^([I-N][a-z]+) ([a-z]+)", "import {2}.{1}"),
        (r"(?m)^([O-S][a-z]+) ([a-z]+)", "public static {1} {2}( .isEmpty() setError({1}Screen)"),
    ]),
    "fr": ("py", "python", [
        (r"(?m)^([A-D][a-z]+) ([a-z]+)", "@{2}\nclass {1}:"),
        (r"(?m)^([E-H][a-z]+) ([a-z]+)", "def {2}({1}):"),
        (r"(?m)^([I-N][a-z]+) ([a-z]+)", "import {2}.{1}"),
        (r"(?m)^([O-S][a-z]+) ([a-z]+)", "from {2} import {1}"),
    ]),
    "de": ("js", "javascript", [
        (r"(?m)^([A-D][a-z]+) ([a-z]+)", "export default class {1}Page {2}"),
        (r"(?m)^([E-H][a-z]+) ([a-z]+)", "const {2} = ({1},\n {2}) =>"),
        (r"(?m)^([I-N][a-z]+) ([a-z]+)", "import {1} from '{2}'"),
        (r"(?m)^([O-S][a-z]+) ([a-z]+)", "const {2} = require(\"{1}\") length > 3"),
        (r"(?m)^([T-W][a-z]+) ([a-z]+)", "type {1} = {2}"),
    ]),
    "es": ("java", "java", [
        (r"(?m)^([A-D][a-z]+) ([a-z]+)", "public class {1}Activity {2}"),
        (r"(?m)^([E-H][a-z]+) ([a-z]+)", "public static void {2}({1} x) config"),
        (r"(?m)^([I-N][a-z]+) ([a-z]+)", "import {2}.{1};"),
        (r"(?m)^([O-S][a-z]+) ([a-z]+)", "package {2}.{1};"),
    ]),
}
CODE_PROFILES = {
    lang: replace(PROFILES[profile], unicode_classes=False) for lang, (_, profile, _) in CODE_RULES.items()
}
WEB = replace(PROFILES["web"], unicode_classes=False)

QUESTION_FORMS = [
    "What is the main purpose of this project?",
    "Which rules validate the \"userName\" field of email in LoginScreen?",
    "How does the navigation from home to the settings screen work?",
    "Explain the business logic behind 'totalPrice' and AmountInput.",
    "What if I remove The and Of from MainActivity.kt?",
    "Show the overall structure.",
    "Where is the cache cleared?",
    "Which files change when index.html or package.json breaks?",
]


# The functions below return lazy DataFrames; the caches only save building the same plan
# again within a session.

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """Columns of a table whose rows are long texts, spread over the cores before the
    text work starts when the table came in few splits."""
    return spread(table(spark, sf_dir, name).select(*columns))


def prose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(doc_id, path, content)`` with paths like ``src3/17.en``."""
    path = F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang")
    docs = texts(spark, sf_dir, "documents", ["doc_id", "source", "lang", "text"])
    return docs.select("doc_id", path.alias("path"), F.col("text").alias("content"))


@lru_cache(maxsize=16)
def prose_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched chunks of the prose files, copies included."""
    return chunks_of(prose_files(spark, sf_dir))


def chunks_of(files: DataFrame) -> DataFrame:
    return with_id(enrich_chunks(describe_chunks(cut_files(files, PROSE), PROSE), PROSE))


def prose_chunks_of(spark: SparkSession, sf_dir: str, documents: DataFrame, deal: bool = False) -> DataFrame:
    """The prose chunks of ``documents(vec_id)`` only, which is joined to the files before they are cut.

    With ``deal`` the documents asked for, which may lie together in a few files of the table, are dealt anew before the text work.
    """
    ids = documents.select(F.col("vec_id").alias("doc_id")).distinct()
    files = prose_files(spark, sf_dir).join(ids, "doc_id", "left_semi")
    return chunks_of(files.repartition(F.xxhash64("doc_id")) if deal else files).withColumn("vec_id", F.col("doc_id"))


def with_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("id", F.concat_ws("#", "path", "chunk_index"))


def code_text(text: Column, lang: str) -> Column:
    _, _, rules = CODE_RULES[lang]
    code = F.replace(text, F.lit(". "), F.lit(".\n"))
    for pattern, form in rules:
        code = F.regexp_replace(code, pattern, form.replace("{1}", "$1").replace("{2}", "$2"))
    return code


def code_files(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """Documents of one language as source files, named by their first word."""
    ext = CODE_RULES[lang][0]
    word = F.lower(F.regexp_extract("text", "^([A-Za-z]*)", 1))
    path = F.concat("source", F.lit("/"), word, F.lit("_"), "doc_id", F.lit(f".{ext}"))
    docs = texts(spark, sf_dir, "documents", ["doc_id", "source", "lang", "text"])
    return docs.filter(F.col("lang") == lang).select(
        path.alias("path"), code_text(F.col("text"), lang).alias("content"))


@lru_cache(maxsize=16)
def code_chunks(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    profile = CODE_PROFILES[lang]
    cut = cut_files(code_files(spark, sf_dir, lang), profile)
    return with_id(enrich_chunks(describe_chunks(cut, profile), profile))


@lru_cache(maxsize=16)
def all_code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, *rest = [code_chunks(spark, sf_dir, lang) for lang in CODE_RULES]
    for chunks in rest:
        first = first.unionByName(chunks)
    return first


def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files; the address without its scheme is the path, a tag ends a line."""
    path = F.concat(F.regexp_replace("url", "^https?://", ""), F.lit(".html"))
    return texts(spark, sf_dir, "pages", ["url", "html"]).select(path.alias("path"), F.replace("html", F.lit(">"), F.lit(">\n")).alias("content"))


@lru_cache(maxsize=16)
def web_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_files(web_files(spark, sf_dir), WEB)
    return with_id(enrich_chunks(describe_chunks(cut, WEB), WEB))


@lru_cache(maxsize=16)
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions; the form of the question follows from the turn."""
    forms = F.array(*[F.lit(f) for f in QUESTION_FORMS])
    form = F.get(forms, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(QUESTION_FORMS))).cast("int"))
    turns = texts(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return turns.filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "conv_id", "turn",
        F.concat_ws(" ", form, F.col("text")).alias("question"),
    )


def probe_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, embedding)``: the benchmark items, with the vector of the same number."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(vectors(spark, sf_dir).withColumnRenamed("vec_id", "query_id"), "query_id")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, embedding)`` per conversation, with the vector of the same number."""
    convs = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("query_id")).distinct()
    return convs.join(vectors(spark, sf_dir).withColumnRenamed("vec_id", "query_id"), "query_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "embeddings", ["vec_id", "embedding"])


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"),
        F.upper("event_type").alias("level"), "value",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(new, old) tracking states. Only labelled documents were known before; those of low
    quality had another text then, and toxic ones are gone now."""
    files = prose_files(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    new = files.filter("coalesce(toxic, 0) = 0").select(
        "path", F.sha2("content", 256).alias("content_hash"), F.length("content").cast("bigint").alias("size"))
    before = F.when(F.col("quality") == 0, F.concat("content", F.lit("~"))).otherwise(F.col("content"))
    old = files.filter("quality is not null").select(
        "path", F.sha2(before, 256).alias("content_hash"), F.length(before).cast("bigint").alias("size"))
    return new, old


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part n depends on part n div 2."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("src"), F.floor(key / 2).cast("bigint").alias("dep")).filter("src <> dep")
