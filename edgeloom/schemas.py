"""Explicit schemas of every relation, as DDL text; nothing is inferred from data."""

from __future__ import annotations

USAGE = "user STRING, feature STRING, sku STRING, at BIGINT"

RAW_SUBSCRIPTION = (
    "id STRING, customer STRUCT<id: STRING, email: STRING, name: STRING>, status STRING, created BIGINT, "
    "items ARRAY<STRUCT<price: STRUCT<id: STRING, product: STRUCT<id: STRING>>, quantity: BIGINT>>"
)
RAW_INVOICE = (
    "id STRING, customer STRUCT<id: STRING, email: STRING, name: STRING>, total BIGINT, currency STRING, "
    "status STRING, created BIGINT, lines ARRAY<STRUCT<subscription: STRUCT<id: STRING>>>"
)

SUBSCRIPTION = (
    "id STRING, customer STRING, status STRING, "
    "items ARRAY<STRUCT<price_id: STRING, product_id: STRING, quantity: BIGINT>>, created_at BIGINT"
)
INVOICE = (
    "id STRING, customer STRING, subscription STRING, total BIGINT, currency STRING, status STRING, "
    "created_at BIGINT, paid BOOLEAN"
)
SUBSCRIPTION_LITE = (
    "id STRING, customer STRING, price_ids ARRAY<STRING>, product_ids ARRAY<STRING>, created_at BIGINT, status STRING"
)
INVOICE_LITE = INVOICE

# One row per price or product named by a subscription: the flat form the joins work on.
ITEM = "sub_id STRING, customer STRING, created_at BIGINT, item_id STRING, item_kind STRING"

LINK_EDGE = (
    "meta STRUCT<schema: STRING, id_mode: STRING>, from STRING, to STRING, kind STRING, confidence DOUBLE, "
    "proof STRING, recipe STRING, at BIGINT, notes STRING"
)

# Evidence for a candidate edge: `n` raw edges share the row. Each part is the tail of the text a proof
# signs, and how many of the edges have that proof.
EVIDENCE = (
    "from STRING, to STRING, kind STRING, matcher STRING, confidence DOUBLE, "
    "parts ARRAY<STRUCT<v: STRING, n: BIGINT>>, n BIGINT, at BIGINT, note STRING"
)

DELIVERY = (
    "delivery_id BIGINT, body STRING, signature_header STRING, remote_addr STRING, received_at TIMESTAMP"
)
BILLING_EVENT = (
    "id STRING, type STRING, created BIGINT, data STRUCT<object: STRUCT<id: STRING>>, _corrupt STRING"
)
QUEUE_EVENT = "stream STRING, offset BIGINT, data STRING, enqueued_at TIMESTAMP"
QUARANTINE = (
    "original_event STRING, stream STRING, reason STRING, error_message STRING, first_attempt_at TIMESTAMP, "
    "last_attempt_at TIMESTAMP, attempt_count INT, http_status_code INT"
)
SIGNED_MESSAGE = "message_id BIGINT, nonce STRING, ts BIGINT, body STRING, signature STRING, received_at TIMESTAMP"
HEARTBEAT = (
    "agent_id STRING, organization_id STRING, version STRING, uptime_seconds BIGINT, mode STRING, queue_depth INT, "
    "dlq_size INT, dropped_count BIGINT, retry_count INT, last_flush_ts BIGINT, ts BIGINT"
)

USER_SUBSCRIPTION = "user->subscription"
USER_INVOICE = "user->invoice"
USER_PRICE = "user->price"
USER_PRODUCT = "user->product"

# The export streams.
STREAM_EDGES, STREAM_BILLING, STREAM_USAGE, STREAM_DLQ = "edges", "billing", "usage", "dlq"
EXPORT_STREAMS = (STREAM_EDGES, STREAM_BILLING, STREAM_USAGE)

EDGE_SCHEMA_NAME = "link-edge/v1"
