"""The driver's events table as webhook deliveries, signed messages, queue rows and heartbeats.

Each view takes the events frame, so the same view serves a table and a stream. `SQL` states the views as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed_hash import KeyedHash, mac, mac_base64
from ..operators.deliveries import SUPPORTED_TYPES
from .testviews import WEBHOOK_SECRET, mac_sql, table

TYPES = (*SUPPORTED_TYPES, "customer.created")
RANGES = ("192.168.1.0/24", "10.0.0.0/8", "2001:db8::/32")
MESSAGE_KEY = b"message-key-of-the-test-views"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def webhook_hasher(spark: SparkSession) -> KeyedHash:
    return KeyedHash(spark, WEBHOOK_SECRET)


def _seconds() -> Column:
    return F.unix_timestamp(F.col("ts").cast("timestamp"))


def _every(n: int) -> Column:
    return F.col("event_id") % n == 0


def deliveries(source: DataFrame, hasher: KeyedHash) -> DataFrame:
    """One delivery per event: some tampered, late, unsigned, malformed or from elsewhere; every seventh repeated."""
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("event_id") % len(TYPES) + 1).cast("int"))
    body = F.when(_every(19), '{"id": ').otherwise(
        F.concat(F.lit('{"id":"evt_'), "event_id", F.lit('","type":"'), kind, F.lit('","created":'), F.col("_t").cast("string"),
                 F.lit(',"data":{"object":{"id":"in_'), "event_id", F.lit('"}}}')))
    base = source.select("event_id", _seconds().alias("_t")).withColumn("body", body)
    signed = hasher.with_columns(base, {"_sig": mac(F.concat(F.col("_t").cast("string"), F.lit("."), "body"))})
    header = (
        F.when(_every(17), "")
        .when(_every(23), F.concat(F.lit("t=abc,v1="), "_sig"))
        .otherwise(F.concat(F.lit("t="), F.col("_t").cast("string"), F.lit(", v0=old, v1="), F.when(_every(11), "bad").otherwise(""), "_sig"))
    )
    octet = (F.col("event_id") % 256).cast("string")
    remote = F.when(_every(29), "172.16.0.1:443").when(_every(31), "[2001:db8::7]:443").when(_every(2), F.concat(F.lit("10."), octet, F.lit(".0.7:1234"))).otherwise(
        F.concat(F.lit("192.168.1."), octet))
    arrived = F.timestamp_seconds(F.col("_t") + F.when(_every(13), 301).otherwise(5) + 60 * F.col("_again"))
    again = F.explode(F.when(_every(7), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return signed.withColumn("_again", again).select(
        (F.col("event_id") * 2 + F.col("_again")).alias("delivery_id"), "body", header.alias("signature_header"), remote.alias("remote_addr"), arrived.alias("received_at"))


def messages(source: DataFrame, hasher: KeyedHash) -> DataFrame:
    nonce = F.concat(F.lit("n"), (F.floor(F.col("event_id") / 4) % 200).cast("string"))
    base = source.select("event_id", nonce.alias("nonce"), _seconds().alias("ts"), F.col("props").alias("body"))
    signed = hasher.with_columns(base, {"_sig": mac_base64(F.concat_ws("|", F.col("ts").cast("string"), "nonce", "body"))})
    signature = F.when(_every(9), "AAAA").when(_every(10), "").otherwise(F.col("_sig"))
    return signed.select(F.col("event_id").alias("message_id"), "nonce", "ts", "body", signature.alias("signature"),
                         F.timestamp_seconds(F.col("ts") + F.when(_every(13), 400).otherwise(1)).alias("received_at"))


STREAM_OF = {"view": "edges", "click": "edges", "error": "usage", "signup": "billing", "purchase": "billing"}


def queue_rows(source: DataFrame) -> DataFrame:
    mapping = F.create_map(*[F.lit(x) for pair in STREAM_OF.items() for x in pair])
    return source.select(
        mapping[F.col("event_type")].alias("stream"), F.col("event_id").alias("offset"), F.concat(F.lit('{"id":'), "event_id", F.lit("}")).alias("payload"),
        F.timestamp_seconds(_seconds()).alias("enqueued_at"))


def queue_log(source: DataFrame) -> DataFrame:
    """Actions on the queue: every row enqueued, half of them read, half of those committed, a few dropped."""
    steps = F.array_compact(F.array(
        F.lit("enqueued"), F.when(_every(2), "dequeued"), F.when(_every(4), "committed"), F.when(F.col("event_id") % 50 == 1, "dropped")))
    mapping = F.create_map(*[F.lit(x) for pair in STREAM_OF.items() for x in pair])
    return source.select(mapping[F.col("event_type")].alias("stream"), F.explode(steps).alias("status"))


def quarantine_entries(source: DataFrame) -> DataFrame:
    """Errors as quarantined events; every fifth failed a second time an hour later, with another status."""
    reason = F.element_at(F.array(F.lit("http_error"), F.lit("json_parse_error"), F.lit("signature_invalid")), (F.col("event_id") % 3 + 1).cast("int"))
    tries = F.explode(F.when(_every(5), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    at = F.timestamp_seconds(_seconds() + 3600 * F.col("_try"))
    return source.where(F.col("event_type") == "error").withColumn("_try", tries).select(
        F.concat(F.lit('{"id":'), "event_id", F.lit("}")).alias("original_event"), F.when(_every(2), "edges").otherwise("billing").alias("stream"),
        F.when(F.col("_try") == 1, "http_error").otherwise(reason).alias("reason"), F.concat(F.lit("try "), F.col("_try").cast("string")).alias("error_message"),
        at.alias("first_attempt_at"), at.alias("last_attempt_at"), F.lit(1).alias("attempt_count"), (F.lit(500) + F.col("_try")).cast("int").alias("http_status_code"))


def heartbeats(source: DataFrame) -> DataFrame:
    return source.select(
        F.concat(F.lit("agent_"), (F.col("user_id") % 20).cast("string")).alias("agent_id"), F.lit("org-1").alias("organization_id"), F.lit("1.0").alias("version"),
        (F.col("event_id") * 10).alias("uptime_seconds"), F.lit("one-shot").alias("mode"), F.floor(F.col("value") * 400).cast("int").alias("queue_depth"),
        (F.col("event_id") % 150).cast("int").alias("dlq_size"), F.floor(F.col("event_id") / 40).alias("dropped_count"), F.lit(0).alias("retry_count"),
        (_seconds() - 30).alias("last_flush_ts"), _seconds().alias("ts"))


# ---------------------------------------------------------------- the same views as SQL text

_T = "CAST(floor(epoch(ts)) AS BIGINT)"
_KIND = "['" + "','".join(TYPES) + f"'][event_id % {len(TYPES)} + 1]"
_STREAM = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STREAM_OF.items()) + " END"

SQL = {
    "bodies": f"""SELECT event_id, {_T} AS t, {_KIND} AS kind, CASE WHEN event_id % 19 = 0 THEN '{{"id": ' ELSE '{{"id":"evt_' || event_id || '","type":"' || {_KIND} ||
        '","created":' || {_T} || ',"data":{{"object":{{"id":"in_' || event_id || '"}}}}}}' END AS body FROM events""",
    "signed": f"SELECT *, {mac_sql('''t || '.' || body''', WEBHOOK_SECRET)} AS sig FROM bodies",
    "deliveries": """SELECT event_id * 2 + again AS delivery_id, event_id, kind, body, sig,
        CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 23 = 0 THEN 't=abc,v1=' || sig
             ELSE 't=' || t || ', v0=old, v1=' || CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE '' END || sig END AS header,
        CASE WHEN event_id % 29 = 0 THEN '172.16.0.1:443' WHEN event_id % 31 = 0 THEN '[2001:db8::7]:443'
             WHEN event_id % 2 = 0 THEN '10.' || (event_id % 256) || '.0.7:1234' ELSE '192.168.1.' || (event_id % 256) END AS remote_addr,
        t + CASE WHEN event_id % 13 = 0 THEN 301 ELSE 5 END + 60 * again AS received
        FROM signed, (SELECT unnest([0, 1]) AS again) WHERE again = 0 OR event_id % 7 = 0""",
    "reasons": """SELECT *, CASE WHEN remote_addr LIKE '172.%' THEN 'ip_not_allowed' WHEN header = '' THEN 'missing_header'
        WHEN try_cast(regexp_extract(header, '^t=([^,]*)', 1) AS BIGINT) IS NULL THEN 'invalid_timestamp'
        WHEN abs(received - try_cast(regexp_extract(header, '^t=([^,]*)', 1) AS BIGINT)) > 300 THEN 'outside_skew'
        WHEN regexp_extract(header, 'v1=(.*)$', 1) <> sig THEN 'signature_mismatch' WHEN NOT json_valid(body) THEN 'json_parse_error' END AS detail FROM deliveries""",
    "classified": f"""SELECT delivery_id, received, CASE WHEN detail IS NOT NULL THEN 'rejected'
        WHEN row_number() OVER (PARTITION BY detail IS NULL, json_extract_string(body, '$.id') ORDER BY received, delivery_id) > 1 THEN 'duplicate'
        WHEN kind = 'customer.created' THEN 'ignored' ELSE 'accepted' END AS outcome,
        CASE WHEN detail IN ('ip_not_allowed', 'json_parse_error') THEN detail WHEN detail IS NOT NULL THEN 'signature_invalid' END AS reason, detail,
        CASE WHEN detail IS NULL THEN json_extract_string(body, '$.id') END AS event_id, CASE WHEN detail IS NULL THEN kind END AS type,
        CASE WHEN detail IS NULL THEN json_extract_string(body, '$.data.object.id') END AS object_id,
        CASE WHEN detail IS NULL THEN CASE WHEN kind LIKE 'invoice.%' THEN 'invoice' WHEN kind LIKE 'customer.subscription.%' THEN 'subscription' WHEN kind LIKE 'charge.%' THEN 'charge' END END AS route
        FROM (SELECT * REPLACE (CASE WHEN detail IS NULL THEN body ELSE '{{}}' END AS body) FROM reasons)""".replace("{{", "{").replace("}}", "}"),
    "queue_rows": f"""SELECT {_STREAM} AS stream, event_id AS "offset", '{{"id":' || event_id || '}}' AS payload, {_T} AS enqueued FROM events""",
    "queue_log": f"""SELECT {_STREAM} AS stream, unnest(list_filter(['enqueued', CASE WHEN event_id % 2 = 0 THEN 'dequeued' END, CASE WHEN event_id % 4 = 0 THEN 'committed' END,
        CASE WHEN event_id % 50 = 1 THEN 'dropped' END], lambda s: s IS NOT NULL)) AS status FROM events""",
    "entries": f"""SELECT '{{"id":' || event_id || '}}' AS original_event, CASE WHEN event_id % 2 = 0 THEN 'edges' ELSE 'billing' END AS stream,
        CASE WHEN n = 1 THEN 'http_error' ELSE ['http_error', 'json_parse_error', 'signature_invalid'][event_id % 3 + 1] END AS reason, 'try ' || n AS error_message,
        {_T} + 3600 * n AS tried, 500 + n AS http_status_code FROM events, (SELECT unnest([0, 1]) AS n) WHERE event_type = 'error' AND (n = 0 OR event_id % 5 = 0)""",
    "beats": f"""SELECT 'agent_' || (user_id % 20) AS agent_id, event_id * 10 AS uptime_seconds, CAST(floor(value * 400) AS INTEGER) AS queue_depth, event_id % 150 AS dlq_size,
        event_id // 40 AS dropped_count, {_T} AS ts, {_T} - 30 AS last_flush_ts FROM events""",
    "messages": f"""SELECT *, {mac_sql('''ts || '|' || nonce || '|' || body''', MESSAGE_KEY)} AS expected FROM
        (SELECT event_id AS message_id, 'n' || ((event_id // 4) % 200) AS nonce, {_T} AS ts, props AS body, {_T} + CASE WHEN event_id % 13 = 0 THEN 400 ELSE 1 END AS received FROM events)""",
}
NEEDS = {"signed": ["bodies"], "deliveries": ["bodies", "signed"], "reasons": ["bodies", "signed", "deliveries"], "classified": ["bodies", "signed", "deliveries", "reasons"]}


def with_events(query: str, *views: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    order: list[str] = []
    for view in views:
        order += [v for v in [*NEEDS.get(view, []), view] if v not in order]
    parts = [f"{v} AS ({SQL[v]})" for v in order] + [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {query}"
