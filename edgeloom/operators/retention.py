"""Ordered streams: positions, bounded retention, batches. Nothing here sorts a stream in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT_BYTES = 500  # fixed value: flat size estimate of a queued event
SLICE = 1_000_000


def positions(df: DataFrame, stream: str, offset: str, alias: str = "position", slice_rows: int = SLICE) -> DataFrame:
    """1-based position of each row within its stream by an increasing unique integer offset.

    Offsets are cut into slices. Rows are numbered inside their slice, and a running sum over the
    few per-slice counts tells where each slice starts.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(offset) / slice_rows))
    before = Window.partitionBy(stream).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(stream, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
        .select(stream, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy(stream, "_slice").orderBy(offset))
    return sliced.withColumn("_inside", inside).join(starts, [stream, "_slice"]).withColumn(alias, F.col("_start") + F.col("_inside")).drop(
        "_slice", "_inside", "_start"
    )


def positions_from_end(df: DataFrame, stream: str, offset: str, alias: str = "from_end", slice_rows: int = SLICE) -> DataFrame:
    turned = positions(df.withColumn("_back", -F.col(offset)), stream, "_back", alias, slice_rows)
    return turned.drop("_back")


def _limit(max_events: int | None, max_bytes: int | None) -> int | None:
    """Rows that fit: by count, and by the flat estimate of their size."""
    limits = ([max_events] if max_events else []) + ([max_bytes // EVENT_BYTES] if max_bytes else [])
    return min(limits) if limits else None


def drop_oldest(df: DataFrame, max_events: int | None = None, max_bytes: int | None = None, stream: str = "stream", offset: str = "offset") -> DataFrame:
    """Adds ``status``: the newest rows that fit are kept, older ones dropped."""
    limit = _limit(max_events, max_bytes)
    ranked = positions_from_end(df, stream, offset)
    kept = F.lit(True) if limit is None else F.col("from_end") <= limit
    return ranked.withColumn("status", F.when(kept, "kept").otherwise("dropped")).drop("from_end")


def reject_new(df: DataFrame, max_events: int | None = None, max_bytes: int | None = None, stream: str = "stream", offset: str = "offset") -> DataFrame:
    """Adds ``status``: the first rows that fit are kept, later ones rejected."""
    limit = _limit(max_events, max_bytes)
    ranked = positions(df, stream, offset)
    kept = F.lit(True) if limit is None else F.col("position") <= limit
    return ranked.withColumn("status", F.when(kept, "kept").otherwise("rejected")).drop("position")


def oldest(df: DataFrame, n: int, offset: str = "offset") -> DataFrame:
    """The first ``n`` rows by offset: a bounded top-n, no full sort."""
    return df.orderBy(offset).limit(n)


def uncommitted(df: DataFrame, committed: DataFrame, stream: str = "stream", offset: str = "offset") -> DataFrame:
    """Rows past each stream's commit mark. ``committed`` has one row per stream."""
    marks = committed.groupBy(stream).agg(F.max(offset).alias("_mark"))
    return df.join(marks, stream, "left").where(F.col("_mark").isNull() | (F.col(offset) > F.col("_mark"))).drop("_mark")


def batched(df: DataFrame, batch_size: int, stream: str = "stream", offset: str = "offset", alias: str = "batch") -> DataFrame:
    """Adds the number of the batch each row is sent in: ``batch_size`` rows each, the rest in the last."""
    return positions(df, stream, offset).withColumn(alias, F.floor((F.col("position") - 1) / batch_size)).drop("position")


def framed(df: DataFrame, batch_size: int = 50, stream: str = "stream", offset: str = "offset", payload: str = "payload") -> DataFrame:
    """One JSON array per batch: (stream, batch, records, line). A batch holds at most ``batch_size`` rows."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(offset).alias("o"), F.col(payload).alias("p"))))
    line = F.concat(F.lit("["), F.array_join(F.transform("_rows", lambda r: r["p"]), ","), F.lit("]"))
    return batched(df, batch_size, stream, offset).groupBy(stream, "batch").agg(rows.alias("_rows")).select(
        stream, "batch", F.size("_rows").cast("bigint").alias("records"), line.alias("line")
    )


def padded_offset(offset: Column) -> Column:
    """Offset as 20 digits, so that text order is number order."""
    return F.lpad(offset.cast("string"), 20, "0")


def queue_metrics(log: DataFrame, stream: str = "stream", status: str = "status") -> DataFrame:
    """Counters per stream over a log of queue actions. Depth is what was enqueued and neither read nor dropped."""
    count = lambda value: F.count_if(F.col(status) == value)
    depth = count("enqueued") - count("dequeued") - count("dropped")
    return log.groupBy(stream).agg(
        count("enqueued").alias("enqueued"), count("dequeued").alias("dequeued"), count("committed").alias("committed"),
        count("dropped").alias("dropped"), depth.alias("depth"), (depth * EVENT_BYTES).alias("bytes"),
    )


def queue_totals(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("depth", "dropped", "enqueued")])
