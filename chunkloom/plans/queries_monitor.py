"""Queries over logs, builds and sessions, and streams that must equal their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkloom.plans import bridges, oracle as o
from chunkloom.plans.registry import query
from chunkloom.session import scratch_path
from chunkloom.streaming import monitor
from chunkloom.streaming.ingest import stream_dedupe

COUNTS = """SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
  upper(event_type) AS level, count(*) AS n FROM events GROUP BY ALL"""


def _plain(df):
    """Timestamps without a zone, as the tables have them."""
    names = [c for c, t in df.dtypes if t == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


@query("log_counts", COUNTS)
def log_counts(spark, sf):
    return _plain(monitor.log_counts(bridges.log_events(spark, sf)))


@query("log_counts_sliding", """SELECT w AS window_start, w + INTERVAL 6 HOUR AS window_end, upper(event_type) AS level, count(*) AS n
  FROM (SELECT *, unnest([date_trunc('hour', ts) - (date_part('hour', ts)::INT % 3) * INTERVAL 1 HOUR,
    date_trunc('hour', ts) - (date_part('hour', ts)::INT % 3) * INTERVAL 1 HOUR - INTERVAL 3 HOUR]) AS w FROM events) GROUP BY ALL""")
def log_counts_sliding(spark, sf):
    return _plain(monitor.log_counts(bridges.log_events(spark, sf), "6 hours", "3 hours"))


@query("session_activity", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id AS session, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k""")
def session_activity(spark, sf):
    return _plain(monitor.session_activity_batch(bridges.log_events(spark, sf)))


def _builds(spark, sf):
    events = bridges.log_events(spark, sf).withColumnRenamed("event_id", "build_id")
    return events.filter("level = 'SIGNUP'"), events.filter("level = 'PURCHASE'")


@query("build_timeouts", """SELECT s.event_id AS build_id, s.user_id AS session, s.ts AS started_at FROM events s WHERE event_type = 'signup' AND NOT EXISTS (
  SELECT 1 FROM events f WHERE f.event_type = 'purchase' AND f.user_id = s.user_id AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 15 MINUTE)""")
def build_timeouts(spark, sf):
    return _plain(monitor.build_timeouts_batch(*_builds(spark, sf)))


@query("log_tail", """SELECT session, position, printf('[%02d] ', position) || line AS entry FROM (
    SELECT user_id AS session, upper(event_type) || ' ' || event_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20)""")
def log_tail(spark, sf):
    lines = bridges.log_events(spark, sf).select(
        "session", F.col("event_id").alias("seq"), F.concat_ws(" ", "level", "event_id").alias("line"))
    return monitor.log_tail(lines)


# -- streams -----------------------------------------------------------------------------------

def _stream(spark, sf, name: str):
    """A table as a stream; it may be one file or a folder of part files."""
    # A pattern: without one, Spark's file stream takes the path for a folder.
    return spark.readStream.schema(bridges.table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query("stream_log_counts", COUNTS)
def stream_log_counts(spark, sf):
    """The daily counts as a stream; its complete result is written per micro-batch."""
    target, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "counts-checkpoint")
    events = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.upper("event_type").alias("level"))
    (
        monitor.log_counts(events).writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )
    return _plain(spark.read.parquet(target))


@query("stream_dedupe", f"SELECT DISTINCT sha256(content) AS fingerprint FROM ({o.PROSE_FILES})")
def stream_dedupe_(spark, sf):
    """Documents as a stream, one row per text within the watermark."""
    target, checkpoint = scratch_path(spark, "dedupe"), scratch_path(spark, "dedupe-checkpoint")
    texts = _stream(spark, sf, "documents").select(
        F.sha2("text", 256).alias("fingerprint"), F.timestamp_seconds("doc_id").alias("mtime"))
    (
        stream_dedupe(texts, horizon="36500 days").writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema("fingerprint string, mtime timestamp").parquet(target).select("fingerprint")


@query("stream_timeouts")
def stream_timeouts(spark, sf):
    """Builds without a finish in time, as a join of two streams; the last ones stay open."""
    target, checkpoint = scratch_path(spark, "timeouts"), scratch_path(spark, "timeouts-checkpoint")
    events = _stream(spark, sf, "events").select(
        F.col("event_id").alias("build_id"), F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    late = monitor.build_timeouts(events.filter("event_type = 'signup'"), events.filter("event_type = 'purchase'"))
    (
        late.writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )
    return _plain(spark.read.schema("build_id bigint, session bigint, started_at timestamp").parquet(target))
