"""Joins and windows that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stage, spread

# What one task should hold of a key at most: so many rows of a side, and so many pairs per such row.
HOT_ROWS = 1_000_000
PAIRS_PER_ROW = 1_000


def may_be_hot(left_rows: int, right_rows: int, hot_rows: int = HOT_ROWS) -> bool:
    """Whether sides of these sizes can hold a key that `cells` would split."""
    return max(left_rows, right_rows) > hot_rows or left_rows * right_rows > hot_rows * PAIRS_PER_ROW


def cells(left: DataFrame, right: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, ``_rows``, ``_columns``): the grid that spreads the pairs of each key too heavy for one task.

    Rows cut the left side of the key and columns the right side, each by that side's count; where the pairs alone are too many, both
    are cut so finely that a cell forms about ``hot_rows * PAIRS_PER_ROW``. Counts are pre-aggregated before the shuffle. Keys of
    one side only, and null keys, join with nothing and need no cells.
    """
    edge = min(hot_rows, max(1, int((hot_rows * PAIRS_PER_ROW) ** 0.5)))
    rows = F.count(F.lit(1))
    counts = left.groupBy(*on).agg(rows.alias("_l")).join(right.groupBy(*on).agg(rows.alias("_r")), on)
    crowded = F.col("_l").cast("double") * F.col("_r") > float(hot_rows * PAIRS_PER_ROW)
    cut = lambda n: F.ceil(F.col(n) / F.when(crowded, edge).otherwise(hot_rows)).alias("_rows" if n == "_l" else "_columns")
    return counts.where(crowded | (F.greatest("_l", "_r") > hot_rows)).select(*on, cut("_l"), cut("_r"))


def balanced_join(
    left: DataFrame, right: DataFrame, on: list[str], left_by: list[str], right_by: list[str],
    hot_rows: int = HOT_ROWS, stage: Stage | None = None, sizes: tuple[int, int] | None = None, many: bool = False,
) -> DataFrame:
    """Inner join on ``on`` that no key overloads, whichever side, or both, it is heavy on.

    Of a heavy key a left row belongs to one row of the grid of `cells`, by the hash of ``left_by``, and goes to all its columns; a right row
    to one column, by ``right_by``, and to all its rows. So each pair meets in exactly one cell, and a side is repeated only as often as
    the other is cut. The grid is stored and joined in like any table: Spark broadcasts it only while its size allows.
    Known ``sizes`` of the sides spare the counts where no key can be heavy. The sides are read twice, so they should be stored tables.
    ``many`` says that pairs far outnumber rows: the sides are then dealt over all cores, as Spark would merge partitions of few rows.
    """
    dealt = (lambda side, keys: spread(side, *keys)) if many else (lambda side, keys: side)
    if sizes is not None and not may_be_hot(*sizes, hot_rows):
        return dealt(left, on).join(dealt(right, on), on)
    grid = (stage or Stage(left.sparkSession)).table(cells(left, right, on, hot_rows), f"cells-{uuid.uuid4().hex}")
    keys = [*on, "_rows", "_columns"]
    placed = dealt(_in_cells(left, grid, on, left_by, "_rows", "_columns"), keys).join(dealt(_in_cells(right, grid, on, right_by, "_columns", "_rows"), keys), keys)
    return placed.drop("_rows", "_columns")


def _in_cells(side: DataFrame, grid: DataFrame, on: list[str], by: list[str], own: str, other: str) -> DataFrame:
    """``side`` with one number of its ``own`` cut per row, repeated for all numbers of the ``other``."""
    known = side.join(grid, on, "left")
    first = F.lit(0).cast("bigint")
    one = F.coalesce(F.pmod(F.xxhash64(*by), F.col(own)), first)
    every = F.sequence(first, F.coalesce(F.col(other) - 1, first))
    return known.select(*side.columns, one.alias(own), F.explode(every).alias(other))


def previous_in_order(df: DataFrame, key: str, order: str, slot: int, alias: str) -> DataFrame:
    """``lag(order)`` per key for an integer order column, without one task per key.

    Rows are ordered inside (key, slot of ``slot`` units); only the first order value of each slot
    looks back, through a per-slot summary, to the last value of the slot before it.
    """
    sliced = df.withColumn("_slot", F.floor(F.col(order) / slot))
    local = Window.partitionBy(key, "_slot").orderBy(order)
    sliced = sliced.withColumn("_prev", F.lag(order).over(local))
    summary = sliced.groupBy(key, "_slot").agg(F.max(order).alias("_last"))
    before = summary.select(
        F.col(key), "_slot", F.lag("_last").over(Window.partitionBy(key).orderBy("_slot")).alias("_carried")
    )
    firsts = sliced.where(F.col("_prev").isNull()).drop("_prev").join(before, [key, "_slot"], "left")
    rest = sliced.where(F.col("_prev").isNotNull()).withColumnRenamed("_prev", alias)
    return rest.drop("_slot").unionByName(firsts.withColumnRenamed("_carried", alias).drop("_slot"))
