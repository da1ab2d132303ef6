"""Identifiers, sanitising, sources, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.keyed_hash import equal_hex, link_proof, mac
from ..operators import sanitize as sz
from ..operators import validate as vd
from ..recipe import PASSTHROUGH
from ..sources import billing
from ..sources import testviews as tv
from ..sources.testviews import id_sql, mac_sql, with_views
from ..sources.usage import normalised, or_fallback, sample_usage
from .common import Catalog, test_hasher

catalog = Catalog()


@catalog.add("hashed_customers", f"""SELECT c_custkey, {mac_sql('c_name')} AS name_mac, {id_sql('c_name', 'syn_cust')} AS synthetic,
    sha256(c_name || chr(31) || c_mktsegment || chr(31) || c_nationkey) AS proof, true AS same_hex, NULL::BOOLEAN AS bad_hex FROM customer""")
def hashed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hasher = test_hasher(spark)
    rows = hasher.with_columns(tv.table(spark, sf_dir, "customer"), {"name_mac": mac(F.col("c_name")), "synthetic": ids.synthetic_id(F.col("c_name"), "syn_cust")})
    return rows.select(
        "c_custkey", "name_mac", "synthetic", link_proof(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("proof"),
        equal_hex(F.upper("name_mac"), F.col("name_mac")).alias("same_hex"), equal_hex(F.col("c_name"), F.col("name_mac")).alias("bad_hex"))


_ENTITIES = {"customer": "c_name", "subscription": "c_mktsegment", "invoice": "c_name", "price": "c_mktsegment", "product": "c_name"}


@catalog.add("mapped_ids", "SELECT c_custkey, " + ", ".join(f"{id_sql(col, ids.PREFIXES[e])} AS {e}_id" for e, col in _ENTITIES.items())
             + """, c_name AS kept_id, true AS synthetic_form, false AS platform_form, 'cus_' || c_custkey AS raw_id, true AS raw_platform_form, false AS raw_synthetic_form FROM customer""")
def mapped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict mapping of every entity, passthrough mapping, and the two form tests."""
    rows = test_hasher(spark).with_columns(tv.table(spark, sf_dir, "customer"), {f"{e}_id": ids.map_id(F.col(col), e) for e, col in _ENTITIES.items()})
    raw = F.concat(F.lit("cus_"), "c_custkey")
    return rows.select(
        "c_custkey", *[f"{e}_id" for e in _ENTITIES], ids.map_id(F.col("c_name"), "customer", PASSTHROUGH).alias("kept_id"),
        ids.is_synthetic(F.col("customer_id")).alias("synthetic_form"), ids.is_platform_id(F.col("customer_id")).alias("platform_form"), raw.alias("raw_id"),
        ids.is_platform_id(raw).alias("raw_platform_form"), ids.is_synthetic(raw).alias("raw_synthetic_form"))


_PRICE, _PRODUCT = id_sql("price", "syn_price"), id_sql("product", "syn_prod")


@catalog.add("sanitized_subscriptions", with_views(f"""SELECT {id_sql('sub_id', 'syn_sub')} AS id, {id_sql('customer', 'syn_cust')} AS customer, status, created_at,
    {_PRICE} || ',' AS prices, {_PRODUCT} || ',' || {_PRODUCT} AS products, quantity + 1 AS quantity FROM raw_items""", "raw_items"))
def sanitized_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sz.sanitize_subscriptions(tv.raw_subscription_pages(spark, sf_dir), test_hasher(spark))
    return rows.select("id", "customer", "status", "created_at", F.array_join("items.price_id", ",").alias("prices"), F.array_join("items.product_id", ",").alias("products"),
                       F.aggregate("items.quantity", F.lit(0).cast("bigint"), lambda a, q: a + q).alias("quantity"))


@catalog.add("subscription_lites", with_views(f"""SELECT {id_sql('sub_id', 'syn_sub')} AS id, {id_sql('customer', 'syn_cust')} AS customer, status, created_at,
    {_PRICE} AS prices, {_PRODUCT} || ',' || {_PRODUCT} AS products, 1 AS price_count, 2 AS product_count FROM raw_items""", "raw_items"))
def subscription_lites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sz.subscription_lite(sz.sanitize_subscriptions(tv.raw_subscription_pages(spark, sf_dir), test_hasher(spark)))
    return rows.select("id", "customer", "status", "created_at", F.array_join("price_ids", ",").alias("prices"), F.array_join("product_ids", ",").alias("products"),
                       F.size("price_ids").alias("price_count"), F.size("product_ids").alias("product_count"))


@catalog.add("subscription_items", with_views("SELECT * FROM items", "items"))
def subscription_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sz.sanitize_items(tv.raw_orders(spark, sf_dir), tv.raw_lines(spark, sf_dir), test_hasher(spark))


@catalog.add("sanitized_invoices", with_views("SELECT * FROM invs", "invs"))
def sanitized_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sz.invoice_lite(sz.sanitize_invoices(tv.raw_invoices(spark, sf_dir), test_hasher(spark)))


@catalog.add("sanitized_usage", with_views("SELECT * FROM usages", "usages"))
def sanitized_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tv.usages(spark, sf_dir, test_hasher(spark))


@catalog.add("whitelisted_invoices", with_views("SELECT id, customer, '' AS subscription, total, currency, status, created_at, status = 'paid' AS paid FROM raw_invoices", "raw_invoices"))
def whitelisted_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sz.whitelist_invoices(tv.raw_invoices(spark, sf_dir))


@catalog.add("whitelisted_subscriptions", with_views("SELECT sub_id AS id, customer, status, created_at, price || ',' AS prices, product || ',' || product AS products FROM raw_items", "raw_items"))
def whitelisted_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sz.whitelist_subscriptions(tv.raw_subscription_pages(spark, sf_dir))
    return rows.select("id", "customer", "status", "created_at", F.array_join("items.price_id", ",").alias("prices"), F.array_join("items.product_id", ",").alias("products"))


@catalog.add("subscriptions_of_customer", with_views("SELECT sub_id AS id, status, created_at AS created, line FROM raw_items WHERE customer = 'cus_7'", "raw_items"))
def subscriptions_of_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.raw_subscriptions(tv.raw_subscription_pages(spark, sf_dir), "cus_7").select("id", "status", "created", "line")


@catalog.add("invoices_of_customer", with_views("SELECT id, total, status FROM raw_invoices WHERE customer = 'cus_7'", "raw_invoices"))
def invoices_of_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.raw_invoices(tv.raw_invoices(spark, sf_dir), customer="cus_7").select("id", "total", "status")


@catalog.add("invoices_of_subscription", with_views("SELECT id, customer FROM raw_invoices WHERE subscription IN ('sub_2', 'sub_18', 'sub_20')", "raw_invoices"))
def invoices_of_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, out = tv.raw_invoices(spark, sf_dir), None
    for subscription in ("sub_2", "sub_18", "sub_20"):
        part = billing.raw_invoices(source, subscription=subscription).select("id", F.col("customer.id").alias("customer"))
        out = part if out is None else out.unionByName(part)
    return out


@catalog.add("source_listing_sizes", """SELECT (SELECT count(*) FROM lineitem) AS subscriptions, count(*) AS invoices, least(25, count(*)) AS invoices_25,
    least(5, (SELECT count(*) FROM customer)) AS probed FROM events WHERE event_type = 'purchase'""")
def source_listing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    subs, invs = tv.raw_subscription_pages(spark, sf_dir), tv.raw_invoices(spark, sf_dir)
    return tv.table(spark, sf_dir, "customer").limit(billing.PROBE_ROWS).agg(F.count(F.lit(1)).alias("probed")).select(
        size(billing.subscriptions(subs)).alias("subscriptions"), size(billing.invoices(invs)).alias("invoices"), size(billing.invoices(invs, 25)).alias("invoices_25"), "probed")


_FROM, _TO = tv.BASE_TIME + 5 * 86_400, tv.BASE_TIME + 9 * 86_400


@catalog.add("backfill_window", with_views(f"SELECT id, created_at AS created, total FROM raw_invoices WHERE created_at BETWEEN {_FROM} AND {_TO}", "raw_invoices"))
def backfill_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.created_between(tv.raw_invoices(spark, sf_dir), _FROM, _TO).select("id", "created", "total")


@catalog.add("backfill_resumed", with_views(
    f"""SELECT id, created_at AS created FROM raw_invoices WHERE created_at >= (SELECT max(created_at) FROM raw_invoices WHERE created_at <= {_FROM})
    AND id NOT IN (SELECT id FROM raw_invoices WHERE created_at <= {_FROM})""", "raw_invoices"))
def backfill_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = tv.raw_invoices(spark, sf_dir).select("id", "created")
    return billing.resumed(source, billing.created_between(source, before=_FROM))


@catalog.add("sample_usage", with_views("""SELECT customer AS "user", feature, sku, "at" FROM (
    SELECT customer, 'export_csv' AS feature, price AS sku, created_at + 60 * i AS "at" FROM chosen UNION ALL
    SELECT customer, 'api_call', product, created_at + 120 * i FROM chosen)""", "raw_items", extra={
    "firsts": "SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY line, price, product) AS r FROM raw_items",
    "chosen": "SELECT *, row_number() OVER (ORDER BY created_at, sub_id) - 1 AS i FROM firsts WHERE r = 1 ORDER BY created_at, sub_id LIMIT 5"}))
def sampled_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return or_fallback(sample_usage(tv.raw_items(spark, sf_dir)), tv.BASE_TIME)


@catalog.add("normalised_usage", """SELECT sha256('org-1|' || event_type || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')) AS event_id, event_type AS feature, 'k' AS kept_keys,
    json_extract_string(props, '$.k') AS k FROM events""")
def normalised_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    personal = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "user_email": "a@b.c", "Session-Token": "t", "cookie": "x"}'))
    raw = tv.table(spark, sf_dir, "events").select(
        F.lit("org-1").alias("org"), F.col("event_type").alias("feature"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("start"), personal.alias("attributes"))
    return normalised(raw, "org", "feature", "start", "attributes").select("event_id", "feature", F.array_join(F.map_keys("attributes"), ",").alias("kept_keys"), F.col("attributes")["k"].alias("k"))


@catalog.add("validation_failures", with_views("""SELECT relation, reason, count(*) AS rows FROM (
    SELECT 'usages' AS relation, CASE WHEN "at" % 7 = 0 THEN 'user_not_synthetic' WHEN "at" % 11 = 0 THEN 'at_not_positive' END AS reason FROM usages
    UNION ALL SELECT 'invs', CASE WHEN total % 5 = 0 THEN 'customer_not_synthetic' WHEN total % 3 = 0 AND subscription <> '' THEN 'subscription_not_synthetic' END FROM invs
    UNION ALL SELECT 'items', CASE WHEN created_at % 13 = 0 THEN 'item_not_synthetic' END FROM items) WHERE reason IS NOT NULL GROUP BY ALL""", "usages", "invs", "items"))
def validation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each relation with some raw ids and zero times put back in."""
    data = tv.link_inputs(spark, sf_dir, test_hasher(spark))
    raw = lambda cond, col, bad: F.when(cond, bad).otherwise(F.col(col))
    usages = data.usages.withColumn("user", raw(F.col("at") % 7 == 0, "user", "cus_1")).withColumn("at", raw(F.col("at") % 11 == 0, "at", F.lit(0)))
    invs = data.invs.withColumn("customer", raw(F.col("total") % 5 == 0, "customer", "cus_1")).withColumn(
        "subscription", raw((F.col("total") % 3 == 0) & (F.col("subscription") != ""), "subscription", "sub_1"))
    items = data.items.withColumn("item_id", raw(F.col("created_at") % 13 == 0, "item_id", "price_1"))
    return vd.failures("usages", usages, vd.usage_reason()).unionByName(vd.failures("invs", invs, vd.invoice_reason())).unionByName(vd.failures("items", items, vd.item_reason()))


@catalog.add("unsanitisable_invoices", with_views("""SELECT id, total, CASE WHEN total % 17 = 0 THEN 'empty_id' WHEN total % 19 = 0 THEN 'empty_customer' ELSE 'usable' END AS reason FROM raw_invoices""", "raw_invoices"))
def unsanitisable_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tv.raw_invoices(spark, sf_dir).withColumn("seen_id", F.col("id"))
    broken = raw.withColumn("id", F.when(F.col("total") % 17 != 0, F.col("id"))).withColumn("customer", F.when(F.col("total") % 19 != 0, F.col("customer")))
    usable, rejected = sz.split_raw(broken)
    return usable.select(F.col("seen_id").alias("id"), "total", F.lit("usable").alias("reason")).unionByName(rejected.select(F.col("seen_id").alias("id"), "total", "reason"))
