"""Usage events: sample events derived from subscriptions, and normalisation of raw ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERSONAL_KEYS = "(?i)email|user|token|cookie"


def sample_usage(items: DataFrame, subscriptions: int = 5) -> DataFrame:
    """Sample events for the ``subscriptions`` that come first by (created_at, id).

    ``items`` is (sub_id, customer, created_at, line, price, product). The event for the first item's price
    follows the creation by 60 s per place, the one for its product by 120 s.
    """
    first = F.min(F.struct("line", "price", "product")).alias("first")
    subs = items.groupBy("sub_id", "customer", "created_at").agg(first)
    chosen = subs.orderBy("created_at", "sub_id").limit(subscriptions)
    place = F.row_number().over(Window.orderBy("created_at", "sub_id")) - 1  # over the sampled rows only
    event = lambda feature, sku, step: F.struct(
        F.col("customer").alias("user"), F.lit(feature).alias("feature"), sku.alias("sku"), (F.col("created_at") + step * F.col("_place")).alias("at")
    )
    events = F.array(event("export_csv", F.col("first.price"), 60), event("api_call", F.col("first.product"), 120))
    return chosen.withColumn("_place", place).select(F.inline(events)).where(F.col("sku") != "")


def or_fallback(usage: DataFrame, now: Column | int) -> DataFrame:
    """``usage``, or one stand-in event ten minutes before ``now`` when it is empty."""
    spark = usage.sparkSession
    at = (F.lit(now) if isinstance(now, int) else now) - 600
    stand_in = spark.range(1).select(
        F.lit("syn_user_sample").alias("user"), F.lit("sample_feature").alias("feature"), F.lit("syn_price_sample").alias("sku"), at.cast("bigint").alias("at")
    )
    empty = usage.limit(1).agg(F.count(F.lit(1))).scalar() == 0
    return usage.unionByName(stand_in.where(empty))


def normalised(raw: DataFrame, org: str, feature: str, start: str, attributes: str) -> DataFrame:
    """Adds a repeatable event id and drops attributes whose key looks personal."""
    event_id = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (org, feature, start)]), 256)
    kept = F.map_filter(F.from_json(attributes, "map<string,string>"), lambda k, v: ~k.rlike(PERSONAL_KEYS))
    return raw.withColumn("event_id", event_id).withColumn(attributes, kept)
