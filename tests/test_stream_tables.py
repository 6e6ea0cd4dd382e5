"""Streams over a table that is one file and over one that is a folder of part files."""

import pytest


@pytest.mark.parametrize("parts", [0, 3])
def test_stream_dedupe(spark, tmp_path, parts):
    from chunkloom.plans import catalog

    rows = [(i, f"text {i % 4}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if parts:
        df.repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        df.toPandas().to_parquet(tmp_path / "documents.parquet")
    found = catalog.queries()["stream_dedupe"](spark, str(tmp_path))
    wanted = df.selectExpr("sha2(text, 256) AS fingerprint").distinct()
    assert sorted(r.fingerprint for r in found.collect()) == sorted(r.fingerprint for r in wanted.collect())
