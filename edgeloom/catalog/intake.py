"""Webhook deliveries, signed messages, agent health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed_hash import KeyedHash
from ..operators import deliveries as dl
from ..operators import fleet
from ..session import Stage, spread
from ..sources import testevents as te
from ..sources import testviews as tv
from ..sources.testevents import with_events
from .common import Catalog

catalog = Catalog()
RULES = dl.DeliveryRules(allowed_ranges=te.RANGES)
TTL = 3600


def classified(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    hasher = te.webhook_hasher(spark)
    return dl.classified(te.deliveries(spread(te.events(spark, sf_dir), "event_id"), hasher), hasher, RULES, seen, Stage(spark))


@catalog.add("classified_deliveries", with_events("SELECT * FROM classified", "classified"))
def classified_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classified(spark, sf_dir)
    return rows.select("delivery_id", F.unix_timestamp("received_at").alias("received"), "outcome", "reason", "detail", "event_id", "type", "object_id", "route")


@catalog.add("delivery_counters", with_events("SELECT outcome, coalesce(reason, '') AS reason, count(*) AS deliveries FROM classified GROUP BY ALL", "classified"))
def delivery_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.delivery_counters(classified(spark, sf_dir))


@catalog.add("deliveries_after_earlier_run", with_events(
    """SELECT delivery_id, CASE WHEN outcome IN ('accepted', 'ignored') AND CAST(substr(event_id, 5) AS BIGINT) % 3 = 0 THEN 'duplicate' ELSE outcome END AS outcome FROM classified""", "classified"))
def deliveries_after_earlier_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the event ids was handled by an earlier run."""
    seen = te.events(spark, sf_dir).where(F.col("event_id") % 3 == 0).select(F.concat(F.lit("evt_"), "event_id").alias("event_id"))
    return classified(spark, sf_dir, seen).select("delivery_id", "outcome")


@catalog.add("canonical_invoices_of_events", with_events(
    """SELECT c.event_id, c.type, c.object_id, CAST(round(e.value * 100) AS BIGINT) AS total, CASE WHEN e.event_id IS NOT NULL THEN 'cus_' || e.user_id END AS customer
    FROM classified c LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') e ON c.object_id = 'in_' || e.event_id
    WHERE c.outcome = 'accepted' AND c.route = 'invoice'""", "classified"))
def canonical_invoices_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = classified(spark, sf_dir).where((F.col("outcome") == "accepted") & (F.col("route") == "invoice")).select("event_id", "type", "object_id")
    stored = tv.raw_invoices(spark, sf_dir).select("id", "total", F.col("customer.id").alias("customer"))
    return dl.canonical(accepted, stored).select("event_id", "type", "object_id", "total", "customer")


@catalog.add("verified_messages", with_events(
    f"""SELECT m.message_id, m.nonce, CASE WHEN m.message_id % 9 <> 0 AND m.message_id % 10 = 0 THEN 'missing_signature' WHEN abs(m.received - m.ts) > 300 THEN 'outside_skew'
    WHEN c.id IS NULL THEN 'replayed' WHEN m.message_id % 9 = 0 THEN 'signature_mismatch' END AS reason FROM messages m LEFT JOIN chain c ON c.id = m.message_id""",
    "messages", extra={
        "live": "SELECT * FROM messages WHERE NOT (message_id % 9 <> 0 AND message_id % 10 = 0) AND abs(received - ts) <= 300",
        "chain": f"""SELECT arg_min(message_id, (received, message_id)) AS id, nonce, arg_min(ts, (received, message_id)) AS ts FROM live GROUP BY nonce
        UNION ALL SELECT arg_min(l.message_id, (l.received, l.message_id)), l.nonce, arg_min(l.ts, (l.received, l.message_id)) FROM chain c JOIN live l ON l.nonce = c.nonce AND l.received - c.ts > {TTL} GROUP BY l.nonce"""},
    recursive=True))
def verified_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    hasher = KeyedHash(spark, te.MESSAGE_KEY)
    return dl.verified_messages(te.messages(te.events(spark, sf_dir), hasher), hasher, ttl=TTL).select("message_id", "nonce", "reason")


@catalog.add("latest_heartbeats", with_events(
    """SELECT agent_id, ts, uptime_seconds, queue_depth, dlq_size, dropped_count, last_flush_ts FROM
    (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, uptime_seconds DESC) AS r FROM beats) WHERE r = 1""", "beats"))
def latest_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = te.heartbeats(te.events(spark, sf_dir)).select("agent_id", "ts", "uptime_seconds", "queue_depth", "dlq_size", "dropped_count", "last_flush_ts")
    return fleet.latest(beats)


@catalog.add("heartbeat_gaps", with_events(
    """SELECT * FROM (SELECT agent_id, lag(ts) OVER w AS previous_ts, ts, ts - lag(ts) OVER w AS silent_seconds FROM (SELECT DISTINCT agent_id, ts FROM beats)
    WINDOW w AS (PARTITION BY agent_id ORDER BY ts)) WHERE silent_seconds > 7200""", "beats"))
def heartbeat_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.gaps(te.heartbeats(te.events(spark, sf_dir)), interval=3600)


@catalog.add("fleet_alerts", with_events(
    """SELECT agent_id, ts // 600 * 600 AS window_start, min(queue_depth) > 10000 AS depth_high, arg_max(dropped_count, (ts, dropped_count)) > arg_min(dropped_count, (ts, dropped_count)) AS drops_rising,
    max(dlq_size) > 100 AS dead_letters_high, count(*) AS heartbeats FROM beats GROUP BY ALL""", "beats"))
def fleet_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.window_alerts(te.heartbeats(te.events(spark, sf_dir)))


@catalog.add("sliding_fleet_alerts", with_events(
    """SELECT agent_id, CAST(w AS BIGINT) AS window_start, min(queue_depth) > 10000 AS depth_high, arg_max(dropped_count, (ts, dropped_count)) > arg_min(dropped_count, (ts, dropped_count)) AS drops_rising,
    max(dlq_size) > 100 AS dead_letters_high, count(*) AS heartbeats FROM (SELECT *, unnest([ts // 900 * 900, ts // 900 * 900 - 900, ts // 900 * 900 - 1800, ts // 900 * 900 - 2700]) AS w FROM beats)
    GROUP BY agent_id, w""", "beats"))
def sliding_fleet_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour, one every quarter."""
    return fleet.window_alerts(te.heartbeats(te.events(spark, sf_dir)), 3600, 900)
