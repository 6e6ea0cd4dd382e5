"""A corpus of documents made ready for training, stage by stage.

Each stage takes what its predecessor kept, as a Parquet table in the shared folder. All but the last return the
columns of ``documents``: rejected documents go, texts lose repeated lines, one document of each group of near copies
stays, documents that hold a benchmark item go, and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.llm import decontaminate, lines, minhash, pieces, quality
from chunkloom.llm.common import ready, table, written

_OWN = ("doc_id", "text")


def _plain(docs: DataFrame) -> DataFrame:
    """Other columns under names that no operator uses, so that none is replaced."""
    return docs.select(*_OWN, *[F.col(c).alias(f"__doc_{c}") for c in docs.columns if c not in _OWN])


def _named(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(c if c in _OWN else f"__doc_{c}").alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and every further rule keep."""
    ready(spark)
    return _named(quality.judge(_plain(docs)).where("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand elsewhere before; documents that lose all their words go."""
    ready(spark)
    left = lines.dedup_lines(_plain(docs)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = _named(left, docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to four fifths, the one with the smallest id."""
    ready(spark)
    gone = minhash.near_duplicates(docs, size=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(written(gone, "near-copies"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.find_items(_plain(docs), table(spark, sf_dir, "benchmark"))
    return _named(found.where(F.size("hits") == 0), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text with the end id, and whether they decode to the text."""
    import public_tokenizers

    ready(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode(docs.select("doc_id", "text"), model, decoded="decoded").select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("sentencepiece", sentencepiece),
]

# SimHash groups of lines and merges by score are not expressible in SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
