"""Rejected rows: kept with their reason, counted, purged, put back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import QUARANTINE, STREAM_BILLING, STREAM_DLQ, STREAM_USAGE
from . import sanitize as sz

COLUMNS = [
    "original_event", "stream", "reason", "error_message", "first_attempt_at", "last_attempt_at", "attempt_count", "http_status_code",
]


def quarantined(rejects: DataFrame, event: Column, stream: Column, reason: Column, at: Column, message: Column | None = None, http_status: Column | None = None, attempts: Column | None = None) -> DataFrame:
    """Quarantine rows of ``rejects``. Rows that come from the quarantine itself are not accepted again."""
    out = rejects.select(
        event.alias("original_event"), stream.alias("stream"), reason.alias("reason"),
        (message if message is not None else F.lit("")).alias("error_message"), at.alias("first_attempt_at"), at.alias("last_attempt_at"),
        (attempts if attempts is not None else F.lit(1)).cast("int").alias("attempt_count"), (http_status if http_status is not None else F.lit(None)).cast("int").alias("http_status_code"),
    )
    return out.where(F.col("stream") != STREAM_DLQ)


# The fields of a raw row that its quarantine row keeps: what is needed to find it again, and nothing personal.
KEPT = {
    sz.SUBSCRIPTIONS: ("id", "customer.id", "status", "created"), sz.INVOICES: ("id", "customer.id", "total", "status", "created"),
    sz.HEADERS: ("id", "customer", "status", "created_at"), sz.LINES: ("id", "price", "product"), sz.USAGE: ("user", "feature", "sku", "at"),
}


def rejected_rows(raw: DataFrame, relation: str, at: Column) -> DataFrame:
    """What a sanitiser refuses of ``raw``, as quarantine rows."""
    _, rejected = sz.split_raw(raw, relation)
    event = F.to_json(F.struct(*[F.col(c).alias(c.replace(".", "_")) for c in KEPT[relation]]))
    return quarantined(rejected, event, F.lit(STREAM_USAGE if relation == sz.USAGE else STREAM_BILLING), F.col("reason"), at, F.lit(relation))


def invalid_inputs(rejects: DataFrame, at: Column) -> DataFrame:
    """Rejects of a linking run (relation, reason, row), as quarantine rows."""
    stream = F.when(F.col("relation") == "usages", STREAM_USAGE).otherwise(STREAM_BILLING)
    return quarantined(rejects, F.col("row"), stream, F.col("reason"), at, F.col("relation"))


def failed_batches(outcome: DataFrame, at: Column) -> DataFrame:
    """Batches that no attempt of the HTTP sink delivered, each as one entry with its status and all its attempts."""
    failed = outcome.where(~F.col("delivered"))
    return quarantined(failed, F.col("line"), F.col("stream"), F.lit("http_error"), at, F.col("error_message"), F.col("http_status_code"), F.col("attempts"))


class Quarantine:
    """One table for everything that was refused: by sanitisers, checks, the intake and the sinks. Each source of a run, or of a
    micro-batch, writes a folder of its own, so that a repetition replaces it."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def put(self, rows: DataFrame, source: str, run: str | int) -> None:
        rows.select(*COLUMNS).write.mode("overwrite").parquet(f"{self.path}/source={source}/run={run}")

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{QUARANTINE}, source STRING, run STRING").parquet(self.path)


def merged_attempts(entries: DataFrame) -> DataFrame:
    """One row per event and stream: attempts add up, the last attempt's reason and error stand."""
    last = F.struct("last_attempt_at", "reason", "error_message", "http_status_code")
    return entries.groupBy("original_event", "stream").agg(
        F.max(last).alias("_last"), F.min("first_attempt_at").alias("first_attempt_at"), F.sum("attempt_count").cast("int").alias("attempt_count")
    ).select(
        "original_event", "stream", "_last.reason", "_last.error_message", "first_attempt_at", "_last.last_attempt_at", "attempt_count", "_last.http_status_code"
    )


def summary(entries: DataFrame, now: Column) -> DataFrame:
    """(dimension, value, entries, oldest_age_seconds): in all, by reason and by stream, in one pass."""
    dims = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")),
        F.struct(F.lit("reason").alias("dimension"), F.col("reason").alias("value")),
        F.struct(F.lit("stream").alias("dimension"), F.col("stream").alias("value")),
    )
    age = F.unix_timestamp(now) - F.unix_timestamp(F.min("first_attempt_at"))
    return entries.select("first_attempt_at", F.inline(dims)).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("entries"), age.alias("oldest_age_seconds")
    )


def purged(entries: DataFrame, cutoff: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows left, one row ``removed``). Without a cutoff everything goes; each row is judged on its own."""
    old = F.lit(True) if cutoff is None else F.col("first_attempt_at") < cutoff
    return entries.where(~old), entries.agg(F.count_if(old).alias("removed"))


def reprocessed(entries: DataFrame, chosen: Column) -> tuple[DataFrame, DataFrame]:
    """(events to send again with their stream, entries that stay)."""
    picked = F.coalesce(chosen, F.lit(False))
    return entries.where(picked).select("stream", F.col("original_event").alias("payload")), entries.where(~picked)


def listed(entries: DataFrame, limit: int | None = None, order: tuple[str, ...] = ("first_attempt_at", "original_event")) -> DataFrame:
    """The entries in order: all, or the first ``limit``."""
    ordered = entries.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)
