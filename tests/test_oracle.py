"""A cross-section of the registered queries against their SQL at the smallest scale.

``python tests/oracle_compare.py`` runs all of them at the next scale.
"""

import pytest

from chunkloom.plans import catalog
from oracle_compare import compare, duck

SAMPLE = [
    "chunk_segments", "chunk_overlap", "chunk_dedupe", "build_stats", "chunk_metadata_prose", "chunk_metadata_js",
    "chunk_properties_web", "length_histogram", "duplicate_content", "anchor_counts", "file_export_stats", "change_feed",
    "tracking_merge", "ignore_filter", "file_members", "business_level", "dependency_level", "impact_closure",
    "topk_search", "topk_search_blocks", "classify_intent", "rerank", "pack_context", "suite_metrics", "log_tail", "build_timeouts",
    "stream_merge", "load_tracking", "incremental_build", "word_closure", "answer_batch", "context_validation", "full_report", "index_panel",
]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, sf, con, name):
    problems = compare(catalog.queries()[name](spark, sf), con.sql(catalog.oracle_sql()[name]))
    assert [p for p in problems if p != "empty on both sides"] == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
