"""All registered queries and their checks."""

from __future__ import annotations

from chunkloom.plans import (  # noqa: F401
    queries_chunks, queries_index, queries_monitor, queries_reports, queries_retrieval, queries_sources,
)
from chunkloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
