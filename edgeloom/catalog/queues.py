"""Bounded queues, quarantine, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators import quarantine as qr
from ..operators import retention as rt
from ..operators import sanitize as sz
from ..operators.matchers import LinkInputs
from ..operators.validate import checked_inputs, split, usage_reason
from ..plans.billing_export import billing_stream
from ..session import Stage
from ..sinks.export import edge_records, numbered
from ..sources import testevents as te
from ..sources import testviews as tv
from ..sources.testevents import with_events
from ..sources.testviews import id_sql, with_views
from .common import Catalog, test_hasher
from .linking import _ALL, _VIEWS, setting

catalog = Catalog()


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te.queue_rows(te.events(spark, sf_dir))


_RANK = 'row_number() OVER (PARTITION BY stream ORDER BY "offset" {})'


@catalog.add("queue_positions", with_events(f"""SELECT stream, lpad(CAST("offset" AS VARCHAR), 20, '0') AS "offset", {_RANK.format('')} AS position FROM queue_rows""", "queue_rows"))
def queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.positions(_rows(spark, sf_dir), "stream", "offset", slice_rows=997).select("stream", rt.padded_offset(F.col("offset")).alias("offset"), "position")


@catalog.add("retention_drop_oldest", with_events(
    f"""SELECT stream, "offset", CASE WHEN {_RANK.format('DESC')} <= 500 THEN 'kept' ELSE 'dropped' END AS status FROM queue_rows""", "queue_rows"))
def retention_drop_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.drop_oldest(_rows(spark, sf_dir), max_events=500, max_bytes=400_000).select("stream", "offset", "status")


@catalog.add("retention_reject_new", with_events(
    f"""SELECT stream, "offset", CASE WHEN {_RANK.format('')} <= 800 THEN 'kept' ELSE 'rejected' END AS status FROM queue_rows""", "queue_rows"))
def retention_reject_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.reject_new(_rows(spark, sf_dir), max_events=1_000, max_bytes=400_000).select("stream", "offset", "status")


@catalog.add("dequeued_batch", with_events(
    """SELECT stream, "offset", payload FROM queue_rows WHERE "offset" > CASE stream WHEN 'edges' THEN 40 WHEN 'billing' THEN 25 ELSE -1 END ORDER BY "offset" LIMIT 100""", "queue_rows"))
def dequeued_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 oldest rows after each stream's commit mark, the marks taken from a log of commits."""
    rows = _rows(spark, sf_dir)
    log = rows.select("stream", F.when(F.col("stream") == "edges", 40).when(F.col("stream") == "billing", 25).cast("bigint").alias("offset")).where(F.col("offset").isNotNull())
    return rt.oldest(rt.uncommitted(rows, log).select("stream", "offset", "payload"), 100)


@catalog.add("committed_removed", with_events("""SELECT stream, count(*) AS left_rows, min("offset") AS first_offset FROM queue_rows WHERE "offset" % 4 <> 0 GROUP BY stream""", "queue_rows"))
def committed_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left once the processed ones, listed by id, are taken out."""
    rows = _rows(spark, sf_dir)
    done = te.events(spark, sf_dir).where(F.col("event_id") % 4 == 0).select(F.col("event_id").alias("offset"))
    return rows.join(done, "offset", "left_anti").groupBy("stream").agg(F.count(F.lit(1)).alias("left_rows"), F.min("offset").alias("first_offset"))


@catalog.add("framed_batches", with_events(
    """SELECT stream, batch, count(*) AS records, sha256('[' || string_agg(payload, ',' ORDER BY "offset") || ']') AS line FROM
    (SELECT *, (row_number() OVER (PARTITION BY stream ORDER BY "offset") - 1) // 50 AS batch FROM queue_rows) GROUP BY ALL""", "queue_rows"))
def framed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.framed(_rows(spark, sf_dir)).withColumn("line", F.sha2("line", 256))


_COUNT = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("enqueued", "dequeued", "committed", "dropped"))
_DEPTH = "count(*) FILTER (status = 'enqueued') - count(*) FILTER (status = 'dequeued') - count(*) FILTER (status = 'dropped')"


@catalog.add("queue_metrics", with_events(f"SELECT stream, {_COUNT}, {_DEPTH} AS depth, ({_DEPTH}) * 500 AS bytes FROM queue_log GROUP BY stream", "queue_log"))
def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.queue_metrics(te.queue_log(te.events(spark, sf_dir)))


@catalog.add("queue_totals", with_events(f"SELECT {_DEPTH} AS depth, count(*) FILTER (status = 'dropped') AS dropped, count(*) FILTER (status = 'enqueued') AS enqueued FROM queue_log", "queue_log"))
def queue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.queue_totals(rt.queue_metrics(te.queue_log(te.events(spark, sf_dir))))


# ---------------------------------------------------------------- quarantine

_MERGED = """SELECT original_event, stream, arg_max(reason, tried) AS reason, arg_max(error_message, tried) AS error_message, min(tried) AS first_attempt, max(tried) AS last_attempt,
    count(*) AS attempt_count, arg_max(http_status_code, tried) AS http_status_code FROM entries GROUP BY original_event, stream"""
_MERGED_VIEW = {"merged": _MERGED}


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qr.merged_attempts(te.quarantine_entries(te.events(spark, sf_dir)))


def _plain(entries: DataFrame) -> DataFrame:
    return entries.select(
        "original_event", "stream", "reason", "error_message", F.unix_timestamp("first_attempt_at").alias("first_attempt"),
        F.unix_timestamp("last_attempt_at").alias("last_attempt"), "attempt_count", "http_status_code")


@catalog.add("quarantine_attempts", with_events("SELECT * FROM merged", "entries", extra=_MERGED_VIEW))
def quarantine_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_merged(spark, sf_dir))


_NOW = tv.BASE_TIME + 40 * 86_400


@catalog.add("quarantine_summary", with_events(
    f"""SELECT 'total' AS dimension, '' AS value, count(*) AS entries, {_NOW} - min(first_attempt) AS oldest_age_seconds FROM merged
    UNION ALL SELECT 'reason', reason, count(*), {_NOW} - min(first_attempt) FROM merged GROUP BY reason
    UNION ALL SELECT 'stream', stream, count(*), {_NOW} - min(first_attempt) FROM merged GROUP BY stream""", "entries", extra=_MERGED_VIEW))
def quarantine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qr.summary(_merged(spark, sf_dir), F.timestamp_seconds(F.lit(_NOW)))


_CUT = tv.BASE_TIME + 15 * 86_400


@catalog.add("quarantine_purge", with_events(
    f"""SELECT count(*) FILTER (first_attempt < {_CUT}) AS removed, count(*) FILTER (first_attempt >= {_CUT}) AS kept, count(*) AS removed_by_full_purge FROM merged""", "entries", extra=_MERGED_VIEW))
def quarantine_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _merged(spark, sf_dir)
    kept, removed = qr.purged(entries, F.timestamp_seconds(F.lit(_CUT)))
    return removed.select("removed", kept.agg(F.count(F.lit(1))).scalar().alias("kept"), qr.purged(entries)[1].scalar().alias("removed_by_full_purge"))


@catalog.add("quarantine_reprocess", with_events(
    """SELECT stream, CASE WHEN reason = 'http_error' THEN 'sent' ELSE 'stays' END AS fate, original_event AS payload FROM merged""", "entries", extra=_MERGED_VIEW))
def quarantine_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent, stay = qr.reprocessed(_merged(spark, sf_dir), F.col("reason") == "http_error")
    return sent.select("stream", F.lit("sent").alias("fate"), "payload").unionByName(stay.select("stream", F.lit("stays").alias("fate"), F.col("original_event").alias("payload")))


@catalog.add("quarantine_listing", with_events("SELECT * FROM merged", "entries", extra=_MERGED_VIEW))
def quarantine_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(qr.listed(_merged(spark, sf_dir)))


@catalog.add("quarantined_usage", with_views(
    """SELECT "user" AS original_user, 'usage' AS stream, 'at_not_positive' AS reason, count(*) AS attempts FROM usages WHERE "at" % 11 = 0 GROUP BY ALL""", "usages"))
def quarantined_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid usage rows moved to quarantine with their reason."""
    broken = tv.usages(spark, sf_dir, test_hasher(spark)).withColumn("was", F.col("at")).withColumn("at", F.when(F.col("at") % 11 == 0, F.lit(0)).otherwise(F.col("at")))
    _, rejected = split(broken, usage_reason())
    rows = qr.quarantined(rejected, F.to_json(F.struct("user", "feature", "sku", "was")), F.lit("usage"), F.col("reason"), F.timestamp_seconds("was"))
    return rows.groupBy(F.get_json_object("original_event", "$.user").alias("original_user"), "stream", "reason").agg(F.sum("attempt_count").alias("attempts"))


@catalog.add("quarantine_of_a_run", with_views(
    """SELECT source, stream, reason, error_message, count(*) AS entries FROM (
    SELECT 'sanitize' AS source, 'billing' AS stream, CASE WHEN total % 17 = 0 THEN 'empty_id' WHEN total % 19 = 0 THEN 'empty_customer' END AS reason, 'invoices' AS error_message FROM raw_invoices
    UNION ALL SELECT 'sanitize', 'billing', CASE WHEN created_at % 17 = 0 THEN 'empty_id' WHEN created_at % 19 = 0 THEN 'empty_customer' END, 'headers' FROM raw_headers
    UNION ALL SELECT 'sanitize', 'usage', CASE WHEN "at" % 13 = 0 THEN 'empty_user' END, 'usage' FROM raw_usage
    UNION ALL SELECT 'checks', 'usage', CASE WHEN "at" % 13 <> 0 AND "at" % 11 = 0 THEN 'user_not_synthetic' END, 'usages' FROM raw_usage)
    WHERE reason IS NOT NULL GROUP BY ALL""", "raw_invoices", "raw_headers", "raw_usage"))
def quarantine_of_a_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoiled raw tables through the sanitisers and the checks of a linking run: all that was refused, read back from one table."""
    hasher, kept = test_hasher(spark), qr.Quarantine(f"{Stage(spark).root}/quarantine")
    unless = lambda column, by, every: F.when(F.col(by) % every != 0, F.col(column))
    invoices = tv.raw_invoices(spark, sf_dir).withColumns({"id": unless("id", "total", 17), "customer": unless("customer", "total", 19)})
    headers = tv.raw_headers(spark, sf_dir).withColumns({"id": unless("id", "created_at", 17), "customer": unless("customer", "created_at", 19)})
    usage = tv.raw_usage(spark, sf_dir).withColumn("user", unless("user", "at", 13))
    refused = qr.rejected_rows(invoices, sz.INVOICES, F.timestamp_seconds("created"))
    for raw, relation, at in ((headers, sz.HEADERS, "created_at"), (usage, sz.USAGE, "at")):
        refused = refused.unionByName(qr.rejected_rows(raw, relation, F.timestamp_seconds(at)))
    kept.put(refused, "sanitize", 0)
    usages = sz.sanitize_usage(usage, hasher).withColumn("user", F.when(F.col("at") % 11 == 0, F.concat(F.lit("cus_"), "user")).otherwise(F.col("user")))
    subs, invs = sz.sanitize_subscription_headers(headers, hasher), sz.invoice_lite(sz.sanitize_invoices(invoices, hasher))
    items = sz.sanitize_items(headers.select("id", "customer", "created_at"), tv.raw_lines(spark, sf_dir), hasher)
    _, rejects = checked_inputs(LinkInputs(usages, subs, invs, items))
    kept.put(qr.invalid_inputs(rejects, F.lit(0).cast("timestamp")), "checks", 0)
    return kept.entries(spark).groupBy("source", "stream", "reason", "error_message").agg(F.sum("attempt_count").alias("entries"))


# ---------------------------------------------------------------- exports


def _billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing_stream(tv.raw_subscription_pages(spark, sf_dir), tv.raw_invoices(spark, sf_dir), test_hasher(spark))


@catalog.add("billing_records", with_views(f"""SELECT 'billing' AS stream, 'subscription' AS record_type, {id_sql('sub_id', 'syn_sub')} AS id, {id_sql('customer', 'syn_cust')} AS customer, created_at, quantity + 1 AS amount FROM raw_items
    UNION ALL SELECT 'billing', 'invoice', id, customer, created_at, total FROM invs""", "raw_items", "invs"))
def billing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The billing stream's JSON, read back; a subscription's amount is the sum over all its items (each page also has one of quantity 1)."""
    record = F.from_json("payload", "id STRING, customer STRING, created_at BIGINT, total BIGINT, items ARRAY<STRUCT<quantity: BIGINT>>")
    quantities = F.aggregate("r.items.quantity", F.lit(0).cast("bigint"), lambda total, q: total + q)
    return _billing(spark, sf_dir).select("stream", "record_type", record.alias("r")).select(
        "stream", "record_type", "r.id", "r.customer", "r.created_at", F.coalesce(quantities, "r.total").alias("amount"))


@catalog.add("leak_audit", """SELECT (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) + (SELECT count(*) FROM events WHERE event_type = 'purchase') AS records,
    0 AS personal_fields, 0 AS email_addresses, 0 AS raw_ids, 0 AS not_synthetic""")
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.leaks(_billing(spark, sf_dir))


@catalog.add("leak_audit_of_raw_rows", """SELECT count(*) AS records, count(*) AS personal_fields, count(*) AS email_addresses, count(*) AS raw_ids, count(*) AS not_synthetic FROM events WHERE event_type = 'purchase'""")
def leak_audit_of_raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit must flag every raw invoice."""
    raw = tv.raw_invoices(spark, sf_dir).select("id", F.col("customer.id").alias("customer"), F.col("customer.email").alias("email"), "total")
    return audit.leaks(raw.select(F.to_json(F.struct("id", "customer", "email", "total")).alias("payload")))


@catalog.add("exported_edges_by_kind", with_views("SELECT kind, count(*) AS records FROM linked GROUP BY kind", *_VIEWS, extra=_ALL))
def exported_edges_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges framed as export lines, then read back and counted."""
    ensemble, stage = setting(spark)
    edges = ensemble.link(ensemble.view(tv.link_inputs(spark, sf_dir, ensemble.hasher), stage), stage)
    records = stage.table(numbered(edge_records(edges)), "records")
    return audit.edges_by_kind(audit.exported_records(rt.framed(records), "line"))
