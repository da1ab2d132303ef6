"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Document rates w maximise entropy relative to one copy each, under one token constraint per source,
``sum(w * size) = target``, and a ceiling on w. The dual is convex and separable: rates are tilted exponentially by
``tilt * size`` and bent below the ceiling. Newton rounds solve it for all sources at once; each is one aggregation of a
(source, size) histogram. Rates become whole copies by adding a repeatable uniform number and a common offset per
source, and the offset is placed where the sum of the rounded words meets the target, by refining a histogram of the
points at which documents gain a copy. So the hot source is only ever pre-aggregated.

Defined results: a null text has size 0 and gets no words. A null source is a source of its own, the last in order.
Documents repeated with the same id and text are rounded alike. An empty table gives no rows. Columns named ``size``,
``source_size``, ``target``, ``copies`` and ``taken`` are replaced if the input has them; others pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.session import Stage

from .common import table, uniform

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CEILING = (5.0, 2.0, 1.0), 3
#: Newton ends when every source is this near its target; the rounding offset takes up the rest.
TOLERANCE, MOST_ROUNDS = 1e-4, 40
BINS, REFINEMENTS = 1024, 3
ADDED = ("size", "source_size", "target", "copies", "taken")


def targets(sources: DataFrame, weights: Sequence[float], ceiling: int) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n): weights by order of the source, filled up to the ceiling.

    ``min(ceiling * size, level * weight)`` sums to all sizes at one level, which a running sum over the sources
    finds; the windows see one row per source.
    """
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sources.withColumn("weight", F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("most", ceiling * F.col("source_size").cast("double"))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.when(F.col("fill") * F.col("open") >= F.col("left"), F.col("left") / F.col("open"))).over(all_rows))
        .select("source", "source_size", "n", F.least("most", F.col("level") * F.col("weight")).alias("target"))
    )


def _rate(size: Column, ceiling: int) -> Column:
    """Tilted rate of a document: 1 without a tilt, between 0 and the ceiling."""
    return ceiling / (1 + (ceiling - 1) * F.exp(-F.col("tilt") * size / F.col("mean")))


def solve_tilts(sizes: DataFrame, goals: DataFrame, stage: Stage, ceiling: int) -> DataFrame:
    """(source, source_size, target, mean, tilt, full): the dual solved by safeguarded Newton rounds."""
    counts = stage.table(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n_docs")), "size_counts")
    state = stage.table(
        goals.select("source", "source_size", "target", F.coalesce(F.try_divide("source_size", "n"), F.lit(1.0)).alias("mean"), F.lit(0.0).alias("tilt"),
                     (F.col("target") >= ceiling * F.col("source_size") * (1 - 1e-12)).alias("full"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), F.lit(1.0).alias("miss")),
        "tilt_0",
    )
    for turn in range(1, MOST_ROUNDS + 1):
        x, w = F.col("size") / F.col("mean"), _rate(F.col("size"), ceiling)
        sums = (
            counts.join(state.where("not full").select(F.col("source").alias("of"), "mean", "tilt"), F.col("source").eqNullSafe(F.col("of")))
            .groupBy("of").agg(F.sum(F.col("n_docs") * F.col("size") * w).alias("got"), F.sum(F.col("n_docs") * F.col("size") * x * w * (1 - w / ceiling)).alias("slope"))
        )
        low = F.when(F.col("got") <= F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("got") >= F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        reach = 4 * (1 + F.abs("tilt"))
        step = F.greatest(-reach, F.least(reach, (F.col("target") - F.col("got")) / F.greatest("slope", F.lit(1e-300))))
        state = stage.table(
            state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
            .select("*", low.alias("l"), high.alias("h"), (F.col("tilt") + step).alias("newton"))
            .select(
                "source", "source_size", "target", "mean",
                F.when(F.col("got").isNull(), F.col("tilt")).when((F.col("newton") > F.col("l")) & (F.col("newton") < F.col("h")), F.col("newton")).otherwise((F.col("l") + F.col("h")) / 2).alias("tilt"),
                "full", F.coalesce("l", "low").alias("low"), F.coalesce("h", "high").alias("high"),
                F.coalesce(F.abs(F.col("got") - F.col("target")) / F.greatest("target", F.lit(1.0)), F.lit(0.0)).alias("miss"),
            ),
            f"tilt_{turn}",
        )
        if (state.agg(F.max("miss")).first()[0] or 0.0) < TOLERANCE:
            break
    return state.select("source", "source_size", "target", "mean", "tilt", "full")


def _gains(ceiling: int) -> Column:
    """The offsets at which a document gains its first, second, ... copy."""
    base = _rate(F.col("size"), ceiling) + F.col("u")
    return F.array(*[F.lit(float(m)) - base for m in range(1, ceiling + 1)])


def place_offsets(sizes: DataFrame, tilts: DataFrame, stage: Stage, ceiling: int) -> DataFrame:
    """Adds ``offset``: copies are the gains below it, and their words come as near the target as one document allows."""
    span = 2.0 * ceiling + 2
    state = tilts.select("*", F.lit(-span / 2).alias("low"), F.lit(0.0).alias("below"))
    order = Window.partitionBy("of").orderBy("bin")
    for turn in range(REFINEMENTS):
        width = span / BINS ** (turn + 1)
        bins = (
            sizes.where("size > 0").join(state.where("not full").select(F.col("source").alias("of"), "mean", "tilt", "low"), F.col("source").eqNullSafe(F.col("of")))
            .select("of", "size", "low", F.explode(_gains(ceiling)).alias("gain"))
            .withColumn("bin", F.floor((F.col("gain") - F.col("low")) / width)).where(F.col("bin").between(0, BINS - 1))
            .groupBy("of", "bin").agg(F.sum("size").alias("words"))
            .withColumn("upto", F.sum("words").over(order))
        )
        crossing = (
            bins.join(state.select(F.col("source").alias("src"), "target", "below"), F.col("of").eqNullSafe(F.col("src")))
            .where(F.col("below") + F.col("upto") >= F.col("target"))
            .groupBy("of").agg(F.min_by(F.struct("bin", "words", "upto"), "bin").alias("at"))
        )
        state = stage.table(
            state.join(crossing, F.col("source").eqNullSafe(F.col("of")), "left").select(
                "source", "source_size", "target", "mean", "tilt", F.expr("full or (at is null and target > 0)").alias("full"),
                F.coalesce(F.col("low") + F.col("at.bin") * width, F.col("low")).alias("low"),
                F.coalesce(F.col("below") + F.col("at.upto") - F.col("at.words"), F.col("below")).alias("below"), F.coalesce("at.words", F.lit(0)).alias("words"),
            ),
            f"offset_{turn}",
        )
    nearer = F.abs(F.col("below") + F.col("words") - F.col("target")) < F.abs(F.col("below") - F.col("target"))
    return state.select("source", "source_size", "target", "mean", "tilt", "full", (F.col("low") + F.when(nearer, span / BINS**REFINEMENTS).otherwise(0.0)).alias("offset"))


def _measured(docs: DataFrame) -> DataFrame:
    """(row, source, size, u): what passes through is packed, so that its names clash with none here."""
    kept = F.struct(*[c for c in docs.columns if c not in ADDED])
    return docs.select(kept.alias("row"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), uniform("doc_id", "text").alias("u"))


def mix(docs: DataFrame, stage: Stage, weights: Sequence[float] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` (of the source), ``copies`` and ``taken`` (copies * size)."""
    sizes = stage.table(_measured(docs).select("source", "size", "u"), "sizes")
    goals = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n")), weights, ceiling)
    plan = place_offsets(sizes, solve_tilts(sizes, goals, stage, ceiling), stage, ceiling)
    copies = F.when(F.col("size") == 0, 0).when(F.col("full"), ceiling).otherwise(F.size(F.filter(_gains(ceiling), lambda g: g < F.col("offset"))))
    joined = _measured(docs).join(plan.withColumnRenamed("source", "__of"), F.col("source").eqNullSafe(F.col("__of")))
    return joined.select("row.*", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source."""
    return mix(table(spark, sf_dir, "documents"), Stage(spark)).select("doc_id", "size", "source_size", "target", "taken")
