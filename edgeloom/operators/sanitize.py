"""Whitelist projections from raw billing objects to synthetic, PII-free rows.

Only named fields are selected, so whatever else a raw row holds never leaves the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import map_id
from ..functions.keyed_hash import KeyedHash
from ..recipe import STRICT


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _first_reason(*checks: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for bad, reason in reversed(checks):
        out = F.when(bad, reason).otherwise(out)
    return out


def _empty(value: Column) -> Column:
    return _text(value) == ""


#: Why a raw row of a relation cannot be sanitised, null if it can: nested objects, flat subscriptions and their lines, usage.
SUBSCRIPTIONS, INVOICES, HEADERS, LINES, USAGE = "subscriptions", "invoices", "headers", "lines", "usage"


def reject_reason(relation: str = SUBSCRIPTIONS) -> Column:
    col = F.col
    if relation in (SUBSCRIPTIONS, INVOICES):
        return _first_reason((_empty(col("id")), "empty_id"), (_empty(col("customer.id")), "empty_customer"))
    if relation == HEADERS:
        return _first_reason((_empty(col("id")), "empty_id"), (_empty(col("customer")), "empty_customer"))
    if relation == LINES:
        return _first_reason((_empty(col("id")), "empty_id"), (_empty(col("price")) & _empty(col("product")), "no_item"))
    if relation == USAGE:
        return _first_reason((_empty(col("user")), "empty_user"), (col("at").isNull(), "missing_time"))
    raise ValueError(f"unknown relation {relation!r}")


def split_raw(raw: DataFrame, relation: str = SUBSCRIPTIONS) -> tuple[DataFrame, DataFrame]:
    """(usable raw rows, rejected ones with a reason). Every sanitiser takes the first; `quarantine.rejected_rows` stores the second."""
    checked = raw.withColumn("reason", reject_reason(relation))
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def sanitize_subscriptions(raw: DataFrame, hasher: KeyedHash, mode: str = STRICT) -> DataFrame:
    """Hashes id, customer and every item's price and product; an absent price or product stays ''."""
    usable, _ = split_raw(raw)
    item = lambda t: F.struct(
        _text(map_id(t["price"]["id"], "price", mode)).alias("price_id"),
        _text(map_id(t["price"]["product"]["id"], "product", mode)).alias("product_id"),
        F.coalesce(t["quantity"], F.lit(0).cast("bigint")).alias("quantity"),
    )
    out = hasher.attach(usable).select(
        map_id(F.col("id"), "subscription", mode).alias("id"),
        map_id(F.col("customer.id"), "customer", mode).alias("customer"),
        _text(F.col("status")).alias("status"),
        F.coalesce(F.transform("items", item), F.expr("cast(array() as array<struct<price_id:string,product_id:string,quantity:bigint>>)")).alias("items"),
        F.col("created").alias("created_at"),
    )
    return out


def sanitize_invoices(raw: DataFrame, hasher: KeyedHash, mode: str = STRICT) -> DataFrame:
    """Also keeps the first line's subscription that is not empty, hashed, else ''; paid follows the status."""
    usable, _ = split_raw(raw)
    named = F.filter(F.transform("lines", lambda line: line["subscription"]["id"]), lambda s: _text(s) != "")
    return hasher.attach(usable).select(
        map_id(F.col("id"), "invoice", mode).alias("id"),
        map_id(F.col("customer.id"), "customer", mode).alias("customer"),
        _text(map_id(F.get(named, F.lit(0)), "subscription", mode)).alias("subscription"),
        "total", _text(F.col("currency")).alias("currency"), _text(F.col("status")).alias("status"),
        F.col("created").alias("created_at"),
        (_text(F.col("status")) == "paid").alias("paid"),
    )


def whitelist_subscriptions(raw: DataFrame) -> DataFrame:
    """The same whitelist with raw ids kept."""
    item = lambda t: F.struct(
        _text(t["price"]["id"]).alias("price_id"), _text(t["price"]["product"]["id"]).alias("product_id"), t["quantity"].alias("quantity")
    )
    return raw.select("id", F.col("customer.id").alias("customer"), "status", F.transform("items", item).alias("items"), F.col("created").alias("created_at"))


def whitelist_invoices(raw: DataFrame) -> DataFrame:
    """Raw ids kept; here the first line with a subscription object counts, even if its id is empty."""
    first = F.get(F.filter("lines", lambda line: line["subscription"].isNotNull()), F.lit(0))
    return raw.select(
        "id", F.col("customer.id").alias("customer"), _text(first["subscription"]["id"]).alias("subscription"),
        "total", "currency", "status", F.col("created").alias("created_at"), (_text(F.col("status")) == "paid").alias("paid"),
    )


def subscription_lite(subs: DataFrame) -> DataFrame:
    """Items as two arrays, empty ids dropped, order and repeats kept."""
    ids = lambda field: F.filter(F.transform("items", lambda t: t[field]), lambda v: v != "")
    return subs.select("id", "customer", ids("price_id").alias("price_ids"), ids("product_id").alias("product_ids"), "created_at", "status")


def invoice_lite(invs: DataFrame) -> DataFrame:
    return invs.select("id", "customer", "subscription", "total", "currency", "status", "created_at", "paid")


def sanitize_usage(raw: DataFrame, hasher: KeyedHash, mode: str = STRICT) -> DataFrame:
    """Usage rows keyed by raw customer and price ids."""
    usable, _ = split_raw(raw, USAGE)
    return hasher.attach(usable).select(
        map_id(F.col("user"), "customer", mode).alias("user"), "feature", _text(map_id(F.col("sku"), "price", mode)).alias("sku"), "at"
    )


def sanitize_items(headers: DataFrame, lines: DataFrame, hasher: KeyedHash, mode: str = STRICT) -> DataFrame:
    """Flat subscriptions (id, customer, created_at) and their lines (id, price, product) to one row per named item.

    The flat form keeps a subscription with any number of items from becoming one huge row. Each
    subscription's own ids are hashed once, before the join with its lines.
    """
    (headers, _), (lines, _) = split_raw(headers, HEADERS), split_raw(lines, LINES)
    head = hasher.detach(hasher.attach(headers).select(
        "id", map_id(F.col("id"), "subscription", mode).alias("sub_id"), map_id(F.col("customer"), "customer", mode).alias("customer"), "created_at"
    ))
    entry = lambda name: F.struct(map_id(F.col(name), name, mode).alias("item_id"), F.lit(name).alias("item_kind"))
    named = hasher.attach(head.join(lines.select("id", "price", "product"), "id"))
    return named.select("sub_id", "customer", "created_at", F.inline(F.array(entry("price"), entry("product")))).where(F.col("item_id").isNotNull())


def sanitize_subscription_headers(raw: DataFrame, hasher: KeyedHash, mode: str = STRICT) -> DataFrame:
    """Flat subscriptions (id, customer, created_at, status) without their items."""
    usable, _ = split_raw(raw, HEADERS)
    return hasher.attach(usable).select(
        map_id(F.col("id"), "subscription", mode).alias("id"), map_id(F.col("customer"), "customer", mode).alias("customer"), "created_at", "status"
    )
