"""Documents asked for are cut by many tasks, even where they lie together in one file of the table."""

from pyspark.sql import functions as F

from chunkloom.plans import bridges


def test_documents_of_one_file_are_dealt_anew(spark, tmp_path):
    rows = spark.range(64).select(
        F.col("id").alias("doc_id"), F.lit("src1").alias("source"), F.lit("en").alias("lang"),
        F.concat(F.lit("The text of document "), "id").alias("text"))
    rows.repartitionByRange(8, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    asked = spark.range(8).select(F.col("id").alias("vec_id"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")       # else eight rows are put together again
    try:
        got = bridges.prose_chunks_of(spark, str(tmp_path), asked, deal=True).select("doc_id", "vec_id", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sorted(r.doc_id for r in got) == list(range(8)) and all(r.vec_id == r.doc_id for r in got)
    assert len({r.task for r in got}) > 1
