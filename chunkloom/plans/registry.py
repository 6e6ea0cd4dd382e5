"""Registry of runnable queries. Each has a Spark job and, where SQL can say it, a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chunkloom.functions.text import joined
from chunkloom.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: function(prepare(spark), sf_dir)
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """The columns with lists in stored form and small integers widened, for comparison."""
    types = dict(df.dtypes)

    def one(name: str) -> Column:
        if types[name].startswith("array<"):
            return joined(F.col(name)).alias(name)
        if types[name] in ("int", "smallint", "tinyint"):
            return F.col(name).cast("bigint").alias(name)
        return F.col(name)

    return df.select(*[one(c) for c in columns or df.columns])
