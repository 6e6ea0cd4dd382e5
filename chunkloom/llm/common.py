"""What the operators share: tables, bounded Arrow batches, written intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkloom.session import prepare, scratch_path

# Rows and bytes that one Arrow batch carries to Python. Whole texts travel in these batches, so they are kept small.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings that bound what one Python batch holds."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables after their last reader, so that a long job holds no more than it still needs."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "written_path", None)
        if path is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
