"""Reading billing tables: schema given, filters and limits pushed to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.sanitize import whitelist_invoices, whitelist_subscriptions

PROBE_ROWS = 5


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def raw_subscriptions(source: DataFrame, customer: str | None = None, limit: int | None = None) -> DataFrame:
    """All subscriptions, or one customer's. No match gives an empty frame; ``limit`` is a true maximum."""
    out = source if customer is None else source.where(F.col("customer.id") == customer)
    return out if limit is None else out.limit(limit)


def raw_invoices(source: DataFrame, customer: str | None = None, subscription: str | None = None, limit: int | None = None) -> DataFrame:
    out = source if customer is None else source.where(F.col("customer.id") == customer)
    if subscription is not None:
        out = out.where(F.exists("lines", lambda line: F.coalesce(line["subscription"]["id"] == subscription, F.lit(False))))
    return out if limit is None else out.limit(limit)


def subscriptions(source: DataFrame, limit: int | None = None) -> DataFrame:
    """Whitelisted subscriptions with raw ids: all, or at most ``limit``."""
    out = whitelist_subscriptions(source)
    return out if limit is None else out.limit(limit)


def invoices(source: DataFrame, limit: int | None = None) -> DataFrame:
    out = whitelist_invoices(source)
    return out if limit is None else out.limit(limit)


def probe(source: DataFrame) -> int:
    """Rows seen when reading at most five: raises if the source cannot be read."""
    return source.limit(PROBE_ROWS).count()


def created_between(source: DataFrame, after: Column | int | None = None, before: Column | int | None = None, column: str = "created") -> DataFrame:
    """Backfill window, both ends included."""
    out = source if after is None else source.where(F.col(column) >= after)
    return out if before is None else out.where(F.col(column) <= before)


def resumed(source: DataFrame, target: DataFrame, column: str = "created", key: str = "id") -> DataFrame:
    """Rows a stopped backfill has still to load: those past the target's high-water mark, and those at the
    mark that are not in it yet."""
    mark = target.agg(F.max(column)).scalar()
    fresh = source.where(mark.isNull() | (F.col(column) >= mark))
    at_mark = target.where(F.col(column) == target.agg(F.max(column)).scalar()).select(key)
    return fresh.join(at_mark, key, "left_anti")


def deliveries_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Landed webhook deliveries as a stream."""
    reader = spark.readStream.schema(schemas.DELIVERY).format("parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
