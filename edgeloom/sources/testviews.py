"""The driver's parquet tables as billing and usage relations.

`SQL` states the same views as text for an independent engine, so results can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed_hash import KeyedHash
from ..operators.matchers import LinkInputs
from ..operators.sanitize import invoice_lite, sanitize_invoices, sanitize_items, sanitize_subscription_headers, sanitize_usage

# Fixed values shared by both engines. The salt and secret are public test values.
TEST_SALT = b"test-tenant-salt-12345"
WEBHOOK_SECRET = b"whsec_test123"
BASE_TIME = 1_704_067_200
SPREAD_FACTOR, SPREAD_SECONDS = 7_919, 2_592_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read in splits of the session's size."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def _order_time(key: str) -> Column:
    return (F.lit(BASE_TIME) + F.col(key) * SPREAD_FACTOR % SPREAD_SECONDS).cast("bigint")


def raw_usage(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``events`` may be a stream of the same rows."""
    events = table(spark, sf_dir, "events") if events is None else events
    parts = table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.where(F.col("event_type").isin("view", "click", "error")).select(
        F.concat(F.lit("cus_"), "user_id").alias("user"),
        F.col("event_type").alias("feature"),
        F.concat(F.lit("price_"), ((F.col("user_id") * 100 + k) % parts).cast("string")).alias("sku"),
        _seconds("ts").alias("at"),
    )


def _status() -> Column:
    return F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "canceled").otherwise("trialing")


def raw_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions that have at least one item."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_semi").select(
        F.concat(F.lit("sub_"), "o_orderkey").alias("id"), F.concat(F.lit("cus_"), "o_custkey").alias("customer"),
        _order_time("o_orderkey").alias("created_at"), _status().alias("status"),
    )


def _price(part: str) -> Column:
    return F.concat(F.lit("price_"), F.col(part).cast("string"))


def _product(part: str) -> Column:
    return F.concat(F.lit("prod_"), F.expr(f"{part} div 10").cast("string"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("sub_"), "l_orderkey").alias("id"), _price("l_partkey").alias("price"), _product("l_partkey").alias("product")
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as subscriptions, with or without items."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("sub_"), "o_orderkey").alias("id"), F.concat(F.lit("cus_"), "o_custkey").alias("customer"), _order_time("o_orderkey").alias("created_at")
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(orders, "l_orderkey").select(
        F.concat(F.lit("sub_"), "l_orderkey").alias("sub_id"), F.concat(F.lit("cus_"), "o_custkey").alias("customer"),
        _order_time("l_orderkey").alias("created_at"), _price("l_partkey").alias("price"), _product("l_partkey").alias("product"),
        F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_linenumber").cast("bigint").alias("line"), _status().alias("status"),
    )


def raw_subscription_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested raw subscriptions as an object API would return them, one page per item, PII included.

    A page carries its item twice: as sold, and with the price left empty.
    """
    product = F.struct(F.col("product").alias("id"))
    full = F.struct(F.struct(F.col("price").alias("id"), product.alias("product")).alias("price"), F.col("quantity").alias("quantity"))
    bare = F.struct(F.struct(F.lit("").alias("id"), product.alias("product")).alias("price"), F.lit(1).cast("bigint").alias("quantity"))
    number = F.substring("customer", 5, 20)
    return raw_items(spark, sf_dir).select(
        F.col("sub_id").alias("id"),
        F.struct(F.col("customer").alias("id"), F.concat(F.lit("user"), number, F.lit("@example.com")).alias("email"),
                 F.concat(F.lit("Customer "), number).alias("name")).alias("customer"),
        "status", F.col("created_at").alias("created"), F.array(full, bare).alias("items"), "line",
    )


def raw_invoices(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Purchases as invoices: the first line has no subscription, the second an empty id, the third names one
    for every other invoice."""
    line = lambda sub: F.struct(sub.alias("subscription"))
    ref = lambda value: F.struct(value.alias("id"))
    none = F.lit(None).cast("struct<id:string>")
    named = F.when(F.col("event_id") % 2 == 0, ref(F.concat(F.lit("sub_"), (F.col("event_id") % 1000).cast("string"))))
    events = table(spark, sf_dir, "events") if events is None else events
    return (
        events
        .where(F.col("event_type") == "purchase")
        .select(
            F.concat(F.lit("in_"), "event_id").alias("id"),
            F.struct(F.concat(F.lit("cus_"), "user_id").alias("id"), F.concat(F.lit("user"), "user_id", F.lit("@example.com")).alias("email"),
                     F.concat(F.lit("Customer "), "user_id").alias("name")).alias("customer"),
            F.round(F.col("value") * 100).cast("bigint").alias("total"), F.lit("usd").alias("currency"),
            F.when(F.col("event_id") % 3 != 0, "paid").otherwise("open").alias("status"), _seconds("ts").alias("created"),
            F.array(line(none), line(ref(F.lit(""))), line(named)).alias("lines"),
        )
    )


def usages(spark: SparkSession, sf_dir: str, hasher: KeyedHash) -> DataFrame:
    return sanitize_usage(raw_usage(spark, sf_dir), hasher)


def whole_subscriptions(spark: SparkSession, sf_dir: str, hasher: KeyedHash) -> DataFrame:
    """Subscriptions as a service would send them, one row each with the lists of their prices and products."""
    items = sanitize_items(raw_orders(spark, sf_dir), raw_lines(spark, sf_dir), hasher)
    of = lambda kind: F.collect_list(F.when(F.col("item_kind") == kind, F.col("item_id"))).alias(f"{kind}_ids")
    listed = items.groupBy(F.col("sub_id").alias("id")).agg(of("price"), of("product"))
    return sanitize_subscription_headers(raw_headers(spark, sf_dir), hasher).join(listed, "id").select("id", "customer", "price_ids", "product_ids", "created_at")


def link_inputs(spark: SparkSession, sf_dir: str, hasher: KeyedHash) -> LinkInputs:
    return LinkInputs(
        usages(spark, sf_dir, hasher),
        sanitize_subscription_headers(raw_headers(spark, sf_dir), hasher),
        invoice_lite(sanitize_invoices(raw_invoices(spark, sf_dir), hasher)),
        sanitize_items(raw_orders(spark, sf_dir), raw_lines(spark, sf_dir), hasher),
    )


# ---------------------------------------------------------------- the same views as SQL text


def _blob(raw: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in raw) + "'::BLOB"


def mac_sql(text: str, secret: bytes = TEST_SALT) -> str:
    block = secret.ljust(64, b"\0")
    inner, outer = _blob(bytes(b ^ 0x36 for b in block)), _blob(bytes(b ^ 0x5C for b in block))
    return f"sha256({outer} || unhex(sha256({inner} || encode({text}))))"


def id_sql(text: str, prefix: str) -> str:
    return f"('{prefix}_' || substr({mac_sql(text)}, 1, 16))"


_ORDER_TIME = f"({BASE_TIME} + (o_orderkey * {SPREAD_FACTOR}) % {SPREAD_SECONDS})"
_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'canceled' ELSE 'trialing' END"

SQL = {
    "raw_usage": f"""SELECT 'cus_' || user_id AS "user", event_type AS feature,
        'price_' || ((user_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT)) % (SELECT count(*) FROM part)) AS sku,
        {_SECONDS} AS "at" FROM events WHERE event_type IN ('view', 'click', 'error')""",
    "raw_headers": f"""SELECT 'sub_' || o_orderkey AS id, 'cus_' || o_custkey AS customer, {_ORDER_TIME} AS created_at, {_STATUS} AS status
        FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    "raw_items": f"""SELECT 'sub_' || o_orderkey AS sub_id, 'cus_' || o_custkey AS customer, {_ORDER_TIME} AS created_at,
        'price_' || l_partkey AS price, 'prod_' || (l_partkey // 10) AS product, CAST(l_quantity AS BIGINT) AS quantity,
        CAST(l_linenumber AS BIGINT) AS line, {_STATUS} AS status FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "raw_invoices": f"""SELECT 'in_' || event_id AS id, 'cus_' || user_id AS customer, CAST(round(value * 100) AS BIGINT) AS total, 'usd' AS currency,
        CASE WHEN event_id % 3 <> 0 THEN 'paid' ELSE 'open' END AS status, {_SECONDS} AS created_at,
        CASE WHEN event_id % 2 = 0 THEN 'sub_' || (event_id % 1000) ELSE '' END AS subscription FROM events WHERE event_type = 'purchase'""",
}
SQL["usages"] = f"""SELECT {id_sql('"user"', 'syn_cust')} AS "user", feature, {id_sql('sku', 'syn_price')} AS sku, "at" FROM raw_usage"""
SQL["subs"] = f"""SELECT {id_sql('id', 'syn_sub')} AS id, {id_sql('customer', 'syn_cust')} AS customer, created_at, status FROM raw_headers"""
SQL["invs"] = f"""SELECT {id_sql('id', 'syn_inv')} AS id, {id_sql('customer', 'syn_cust')} AS customer,
    CASE WHEN subscription = '' THEN '' ELSE {id_sql('subscription', 'syn_sub')} END AS subscription,
    total, currency, status, created_at, status = 'paid' AS paid FROM raw_invoices"""
SQL["items"] = f"""SELECT {id_sql('sub_id', 'syn_sub')} AS sub_id, {id_sql('customer', 'syn_cust')} AS customer, created_at,
    {id_sql('price', 'syn_price')} AS item_id, 'price' AS item_kind FROM raw_items
    UNION ALL SELECT {id_sql('sub_id', 'syn_sub')}, {id_sql('customer', 'syn_cust')}, created_at, {id_sql('product', 'syn_prod')}, 'product' FROM raw_items"""

_NEEDS = {"usages": ["raw_usage"], "subs": ["raw_headers"], "invs": ["raw_invoices"], "items": ["raw_items"]}


def with_views(query: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``query`` with the views it names."""
    order: list[str] = []
    for view in views:
        order += [v for v in [*_NEEDS.get(view, []), view] if v not in order]
    parts = [f"{v} AS MATERIALIZED ({SQL[v]})" for v in order] + [f"{k} AS MATERIALIZED ({v})" for k, v in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {query}"
