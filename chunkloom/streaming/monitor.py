"""Log and build monitoring. Each job takes a batch or a streaming DataFrame of events.

``events(ts, session, level, ...)`` with ``ts`` a timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from chunkloom.options import Options


def _watermarked(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def log_counts(events: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events per level in tumbling (or, with ``slide``, sliding) windows."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return _watermarked(events, delay).groupBy(span.alias("w"), "level").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "level", "n")


def session_activity(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions per user of a stream: a pause of ``gap`` or more starts a new one."""
    return (
        _watermarked(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "session")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("session", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
    )


def session_activity_batch(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Batch form of ``session_activity``.

    Events of one slot of ``gap`` length always belong together, so they are first folded
    to one row per session key and slot on the map side; what is then sorted per key is
    bounded by the covered time, not by the number of events of a busy key.
    """
    gap = gap_minutes * 60_000_000
    at = F.unix_micros("ts")
    slots = events.groupBy("session", F.floor(at / gap).alias("slot")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy("session").orderBy("slot")
    starts = F.when(F.col("first") - F.lag("last").over(in_order) < gap, 0).otherwise(1)
    numbered = slots.withColumn("_new", starts).withColumn(
        "_s", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("session", "_s").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n_events")
    ).select(
        "session", F.timestamp_micros("first").alias("session_start"),
        F.timestamp_micros(F.col("last") + gap).alias("session_end"), "n_events",
    )


def build_timeouts(starts: DataFrame, finishes: DataFrame, options: Options = Options(), delay: str = "1 hour") -> DataFrame:
    """Builds ``(build_id, session, ts)`` without a finish of the session within the limit.

    A time-bounded left outer join; on streams the watermarks bound the state on both sides.
    """
    limit = F.expr(f"interval {options.build_timeout_minutes} minutes")
    s = _watermarked(starts, delay).select("build_id", F.col("session").alias("s_session"), F.col("ts").alias("started_at"))
    f = _watermarked(finishes, delay).select(F.col("session").alias("f_session"), F.col("ts").alias("finished_at"))
    within = (
        (F.col("s_session") == F.col("f_session")) & (F.col("finished_at") >= F.col("started_at"))
        & (F.col("finished_at") <= F.col("started_at") + limit)
    )
    return s.join(f, within, "left_outer").filter("finished_at is null").select(
        "build_id", F.col("s_session").alias("session"), "started_at")


def build_timeouts_batch(starts: DataFrame, finishes: DataFrame, options: Options = Options()) -> DataFrame:
    """Batch form of ``build_timeouts``, without pairing starts and finishes.

    Time is cut into slots of the limit's length. A finish in time lies in the slot of the
    start (then the last finish there is not before the start) or in the next one (then the
    first finish there is not after the deadline); so two numbers per session and slot decide.
    """
    limit = options.build_timeout_minutes * 60_000_000
    at = F.unix_micros("ts")
    slot = F.floor(at / limit)
    spans = finishes.groupBy("session", slot.alias("slot")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    here = spans.select("session", "slot", F.col("last").alias("last_here"))
    after = spans.select("session", (F.col("slot") - 1).alias("slot"), F.col("first").alias("first_after"))
    in_time = (F.col("last_here") >= F.col("at")) | (F.col("first_after") <= F.col("at") + limit)
    return (
        starts.select("build_id", "session", "ts", at.alias("at"), slot.alias("slot"))
        .join(here, ["session", "slot"], "left").join(after, ["session", "slot"], "left")
        .filter(~F.coalesce(in_time, F.lit(False)))
        .select("build_id", "session", F.col("ts").alias("started_at"))
    )


def log_tail(lines: DataFrame, n: int = 20) -> DataFrame:
    """Last ``n`` lines per session, numbered ``[01]`` from the oldest of them.

    ``lines(session, seq, line)``; ``seq`` orders the lines of a session. Ranking keeps only
    n rows per session before anything is gathered.
    """
    newest = Window.partitionBy("session").orderBy(F.desc("seq"))
    oldest = Window.partitionBy("session").orderBy("seq")
    return (
        lines.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
        .withColumn("position", F.row_number().over(oldest).cast("bigint"))
        .select("session", "position", F.format_string("[%02d] %s", F.col("position"), F.col("line")).alias("entry"))
    )


def tail_stream(lines: DataFrame, n: int = 20) -> DataFrame:
    """Streaming tail: per session the newest ``n`` (seq, line) pairs, kept by a bounded state.

    Update mode; a late line with a smaller ``seq`` than the kept ones does not enter.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, batches, state):
        kept = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            kept = sorted(set(kept) | set(zip(batch["seq"].tolist(), batch["line"].tolist())))[-n:]
        state.update(([int(s) for s, _ in kept], [l for _, l in kept]))
        yield pd.DataFrame({
            "session": [key[0]] * len(kept),
            "position": list(range(1, len(kept) + 1)),
            "entry": [f"[{i:02d}] {line}" for i, (_, line) in enumerate(kept, start=1)],
        })

    return lines.groupBy("session").applyInPandasWithState(
        update, "session string, position bigint, entry string", "seqs array<bigint>, lines array<string>",
        "update", GroupStateTimeout.NoTimeout,
    )
