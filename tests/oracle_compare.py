"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


KINDS = {
    "bigint": "int", "int": "int", "string": "str", "boolean": "bool", "double": "float",
    "timestamp_ntz": "time", "timestamp": "time",
    "BIGINT": "int", "INTEGER": "int", "HUGEINT": "huge", "VARCHAR": "str", "BOOLEAN": "bool", "DOUBLE": "float",
    "TIMESTAMP": "time", '"NULL"': "null", "NULL": "null",
}


def compare(spark_df, relation) -> list[str]:
    problems = []
    columns = sorted(spark_df.columns)
    theirs = sorted(relation.columns)
    if columns != theirs:
        return [f"columns {columns} != {theirs}"]
    kinds = {c: KINDS.get(t, t) for c, t in spark_df.dtypes}
    other = {c: KINDS.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    for c in columns:
        if kinds[c] != other[c] and other[c] != "null":
            problems.append(f"type of {c}: {kinds[c]} != {other[c]}")
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in spark_df.collect())
    at = [relation.columns.index(c) for c in columns]
    yours = Counter(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    if mine != yours:
        a, b = list((mine - yours).elements()), list((yours - mine).elements())
        problems.append(f"rows {sum(mine.values())} vs {sum(yours.values())}; only spark {len(a)} e.g. {a[:2]}; only sql {len(b)} e.g. {b[:2]}")
    elif not mine:
        problems.append("empty on both sides")
    return problems


def main(names: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    sys.path.insert(0, "/root/repo")
    from chunkloom.plans import catalog
    from chunkloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    oracles = catalog.oracle_sql()
    for name, function in catalog.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = function(spark, sf_dir)
            if name not in oracles:
                n = df.count()
                print(f"rows {name}: {n} rows, {time.time() - started:.1f}s", flush=True)
                continue
            relation = con.sql(oracles[name])
            problems = compare(df, relation)
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        bad += bool(problems)
        took = time.time() - started
        print(f"{'FAIL' if problems else 'ok'} {name} {took:.1f}s" + "".join(f"\n   {p[:900]}" for p in problems), flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
