"""Joins and counts over |left time - right time| <= window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import within
from ..session import Stage
from .skew import balanced_join


def window_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    window: int,
    on: list[str] | None = None,
    left_by: list[str] | None = None,
    right_by: list[str] | None = None,
    hot_rows: int | None = None,
    stage: Stage | None = None,
    sizes: tuple[int, int] | None = None,
    many: bool = False,
) -> DataFrame:
    """Pairs at most ``window`` apart, optionally also equal on ``on``.

    Time is cut into buckets as wide as the window. Each row of one side is placed in its own bucket and the two beside it, each row of
    the other in one, so a bucket equality replaces the nested loop and every pair meets in exactly one bucket. The side placed three times is
    the smaller one by ``sizes``, without them the right one. With ``hot_rows`` set, overfull buckets are spread over cells
    (`balanced_join`), rows told apart by ``left_by`` and ``right_by``; ``many`` pairs for each row are then formed on all cores.
    """
    on = on or []
    width = max(window, 1)  # a window <= 0 matches nothing: `within` is then constant false
    thrice_left = sizes is not None and sizes[0] < sizes[1]
    left, right = _placed(left, left_time, width, thrice_left), _placed(right, right_time, width, not thrice_left)
    keys = [*on, "_bucket"]
    if hot_rows and window > 0:
        if sizes is not None:
            sizes = (sizes[0] * (3 if thrice_left else 1), sizes[1] * (1 if thrice_left else 3))
        pairs = balanced_join(left, right, keys, left_by or [left_time], right_by or [right_time], hot_rows, stage, sizes, many)
    else:
        pairs = left.join(right, keys)
    return pairs.where(within(F.col(left_time), F.col(right_time), window)).drop("_bucket")


def _placed(side: DataFrame, time: str, width: int, thrice: bool) -> DataFrame:
    bucket = F.floor(F.col(time) / width)
    return side.withColumn("_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)) if thrice else bucket)


def count_within(left: DataFrame, right: DataFrame, left_time: str, right_time: str, window: int) -> DataFrame:
    """One row ``pairs``: how many (left, right) pairs lie within the window, without forming them.
    A left row stands for ``n`` events.

    Both sides shrink to one row per second first. A left second t reads three right buckets: the
    part of the one before at or after t - window, all of its own, the part of the next up to
    t + window. Running sums inside each bucket (at most a few thousand rows) give the parts.
    """
    spark = left.sparkSession
    if window <= 0:
        return spark.range(1).select(F.lit(0).cast("bigint").alias("pairs"))
    per_left = left.groupBy(F.col(left_time).alias("t")).agg(F.sum("n").alias("n"))
    per_right = right.groupBy(F.col(right_time).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    bucket = F.floor(F.col("t") / window)
    nothing = F.lit(0).cast("bigint")
    points = per_right.select(bucket.alias("b"), F.col("t").alias("pos"), F.col("n").alias("weight"), nothing.alias("asked"), nothing.alias("part"))
    probe = lambda shift, pos, part: F.struct(
        (bucket + shift).alias("b"), pos.alias("pos"), nothing.alias("weight"), F.col("n").alias("asked"), F.lit(part).cast("bigint").alias("part")
    )
    probes = per_left.select(
        F.inline(
            F.array(
                probe(-1, F.col("t") - window - 1, -1),
                probe(0, F.col("t"), 0),
                probe(1, F.col("t") + window, 1),
            )
        )
    )
    whole = Window.partitionBy("b")
    upto = whole.orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = points.unionByName(probes).select(
        "asked", "part", F.sum("weight").over(upto).alias("upto"), F.sum("weight").over(whole).alias("total")
    )
    hits = F.when(F.col("part") == -1, F.col("total") - F.col("upto")).when(F.col("part") == 0, F.col("total")).otherwise(F.col("upto"))
    return seen.where(F.col("asked") > 0).agg(F.coalesce(F.sum(F.col("asked") * hits), nothing).alias("pairs"))
