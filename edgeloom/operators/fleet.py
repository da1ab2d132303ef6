"""Agent health from heartbeat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import previous_in_order

DEPTH_LIMIT, DLQ_LIMIT = 10_000, 100
SLOT = 86_400


def latest(beats: DataFrame) -> DataFrame:
    """Each agent's newest heartbeat."""
    fields = [c for c in beats.columns if c not in ("agent_id", "ts")]
    newest = F.max(F.struct("ts", *fields)).alias("_last")
    return beats.groupBy("agent_id").agg(newest).select("agent_id", "_last.*")


def gaps(beats: DataFrame, interval: int, slot: int = SLOT, now: Column | int | None = None) -> DataFrame:
    """Silences longer than two intervals, ended by a later heartbeat or, if ``now`` is given, still going on then
    (``ts`` is null for those)."""
    seconds = beats.select("agent_id", "ts").distinct()
    with_previous = previous_in_order(seconds, "agent_id", "ts", slot, "previous_ts")
    if now is not None:
        now = F.lit(now) if isinstance(now, int) else now
        last = beats.groupBy("agent_id").agg(F.max("ts").alias("previous_ts")).select("agent_id", "previous_ts", F.lit(None).cast("bigint").alias("ts"), (now - F.col("previous_ts")).alias("silent_seconds"))
        return gaps(beats, interval, slot).unionByName(last.where(F.col("silent_seconds") > 2 * interval))
    return with_previous.select("agent_id", "previous_ts", "ts", (F.col("ts") - F.col("previous_ts")).alias("silent_seconds")).where(
        F.col("silent_seconds") > 2 * interval
    )


def window_alerts(beats: DataFrame, seconds: int = 600, slide: int | None = None) -> DataFrame:
    """Per agent and window: depth above the limit throughout, drops rising, too many dead letters.

    Windows follow one another or, with ``slide``, begin every ``slide`` seconds, so that a rise across the edge of one window
    shows in the next. A heartbeat then counts in each of the windows that hold it.
    """
    slide = slide or seconds
    newest = F.floor(F.col("ts") / slide) * slide
    oldest = (F.floor((F.col("ts") - seconds) / slide) + 1) * slide
    placed = beats.withColumn("window_start", F.explode(F.sequence(oldest.cast("bigint"), newest.cast("bigint"), F.lit(slide).cast("bigint"))))
    drops = F.struct("ts", "dropped_count")
    return placed.groupBy("agent_id", "window_start").agg(
        (F.min("queue_depth") > DEPTH_LIMIT).alias("depth_high"),
        (F.max_by("dropped_count", drops) > F.min_by("dropped_count", drops)).alias("drops_rising"),
        (F.max("dlq_size") > DLQ_LIMIT).alias("dead_letters_high"),
        F.count(F.lit(1)).alias("heartbeats"),
    )
