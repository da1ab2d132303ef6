"""The three matchers, as joins that emit evidence rows.

A row stands for ``n`` raw edges of one key and matcher. Its ``parts`` list what their proofs sign and
how often. Given one row per usage event the output expands to the raw edges (`raw_edges`); given usage
pre-aggregated by what the proofs depend on (`View.compact`) the same joins carry far fewer rows, and
the multiplicity stays exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.keyed_hash import KeyedHash, mac
from ..functions.scoring import temporal_confidence, within
from ..recipe import EXACT, SKU, STRICT, TEMPORAL
from ..schemas import EDGE_SCHEMA_NAME, USER_INVOICE, USER_PRICE, USER_PRODUCT, USER_SUBSCRIPTION
from ..session import Stage
from .rangejoin import window_join
from .skew import HOT_ROWS, balanced_join


@dataclass(frozen=True)
class LinkInputs:
    """Sanitised inputs. ``items`` may be given flat; otherwise it is unfolded from the arrays of ``subs``."""

    usages: DataFrame
    subs: DataFrame
    invs: DataFrame
    items: DataFrame | None = None

    def flat_items(self) -> DataFrame:
        if self.items is not None:
            return self.items
        entries = F.concat(
            F.transform("price_ids", lambda p: F.struct(p.alias("item_id"), F.lit("price").alias("item_kind"))),
            F.transform("product_ids", lambda p: F.struct(p.alias("item_id"), F.lit("product").alias("item_kind"))),
        )
        return self.subs.select(F.col("id").alias("sub_id"), "customer", "created_at", F.inline(entries))

    def index(self, skus: DataFrame | None = None) -> DataFrame:
        """SKU -> subscriptions naming it, with how often as a price and how often as a product; of ``skus`` only, if given."""
        items = self.flat_items()
        if skus is not None:
            # Items outside the range of the SKUs, as products are where SKUs are prices, need not move for the join.
            bounds = skus.agg(F.min("sku").alias("lo"), F.max("sku").alias("hi"))
            items = items.where(F.col("item_id").between(bounds.select("lo").scalar(), bounds.select("hi").scalar()))
            items = items.join(skus.select(F.col("sku").alias("item_id")), "item_id", "left_semi")
        return items.groupBy(F.col("item_id").alias("sku"), F.col("sub_id").alias("id"), "customer", "created_at").agg(
            F.count_if(F.col("item_kind") == "price").alias("price_hits"), F.count_if(F.col("item_kind") == "product").alias("product_hits")
        )


@dataclass(frozen=True)
class View:
    """What a matcher reads: usage by SKU and by time (with counts), and the billing side. Once stored, the index holds
    only SKUs that usage names, as the others match nothing."""

    by_sku: DataFrame
    by_time: DataFrame
    subs: DataFrame
    invs: DataFrame
    index: DataFrame
    hot_rows: int = HOT_ROWS
    by_user: DataFrame | None = None
    stage: Stage | None = None
    inputs: LinkInputs | None = None

    @classmethod
    def raw(cls, inputs: LinkInputs, hot_rows: int = HOT_ROWS) -> "View":
        """One row per usage event."""
        events = inputs.usages.select("user", "sku", "at", F.lit(1).cast("bigint").alias("n"))
        return cls(events, events, *cls._billing(inputs), hot_rows, inputs=inputs)

    @classmethod
    def compact(cls, inputs: LinkInputs, hot_rows: int = HOT_ROWS) -> "View":
        """Usage merged to one row per (user, SKU) and one per (user, second); and per user the list of
        SKUs, which is no longer than the catalogue."""
        count = F.count(F.lit(1)).alias("n")
        by_sku = inputs.usages.groupBy("user", "sku").agg(count, F.max("at").alias("at"))
        by_time = inputs.usages.groupBy("user", "at").agg(count)
        return cls(by_sku, by_time, *cls._billing(inputs), hot_rows, inputs=inputs)

    @staticmethod
    def _billing(inputs: LinkInputs) -> tuple[DataFrame, DataFrame, DataFrame]:
        columns = ("id", "customer", "created_at")
        return inputs.subs.select(*columns), inputs.invs.select(*columns), inputs.index()

    def stored(self, stage: Stage, names: Sequence[str] = ("by_sku", "by_time", "subs", "invs", "index")) -> "View":
        """Stored once: every matcher reads these tables several times. ``names`` are the tables that will be read."""
        frames = {name: getattr(self, name) for name in names}
        if self.by_time is self.by_sku:
            frames.pop("by_time", None)
        index = frames.pop("index", None)
        kept = stage.tables(frames)
        if index is not None:
            skus = kept["by_sku"].select("sku").distinct()
            kept["index"] = stage.table(index if self.inputs is None else self.inputs.index(skus), "index")
        if self.by_time is self.by_sku:
            kept["by_time"] = kept["by_sku"]
        return replace(self, **kept, stage=stage)

    def drop(self) -> None:
        """Remove the stored tables; what was read off them (`figures`) stays."""
        self.stage.drop("by_sku", "by_time", "by_user", "subs", "invs", "index")

    def staged(self, stage: Stage) -> "View":
        """Stored, with the list of SKUs per user."""
        stored = self.stored(stage)
        per_user = stored.by_sku.groupBy("user").agg(
            F.max("at").alias("at"), F.sum("n").alias("n"), F.collect_list(F.struct("sku", "n")).alias("skus")
        )
        return replace(stored, by_user=stage.table(per_user, "by_user"))

    @cached_property
    def figures(self) -> Row:
        """Sizes the plans depend on, gathered in one pass of one-row aggregates over stored tables."""
        size = lambda df: df.agg(F.count(F.lit(1))).scalar()
        most = lambda df, value: df.agg(F.coalesce(F.max(value), F.lit(0)).cast("double")).scalar()
        named = self.hits().groupBy("sku").agg(F.count(F.lit(1)).alias("subs"), F.sum("hits").alias("hits"))
        by_sku = self.by_sku.join(named, ["sku"])
        return self.by_sku.sparkSession.range(1).select(
            size(self.by_sku).alias("by_sku"), size(self.by_time).alias("by_time"), size(self.by_sku if self.by_user is None else self.by_user).alias("by_user"), size(self.subs).alias("subs"), size(self.invs).alias("invs"), size(self.index).alias("index"),
            by_sku.agg(F.coalesce(F.sum(F.col("subs").cast("double")), F.lit(0.0))).scalar().alias("sku_pairs"),
            most(by_sku, F.col("n").cast("double") * F.col("hits")).alias("most_item_edges"),
            most(self.by_sku.groupBy("user").agg(F.sum("n").alias("n")), "n").alias("most_user_events"),
            most(self.hits(), "hits").alias("most_hits"),
        ).first()

    def longest(self) -> float:
        """No key has more raw edges than this: an edge to a subscription or invoice comes from each of the
        user's events at most once exactly, once in time and once per naming entry; an edge to an item
        from each event with the SKU, at most once exactly and once as overlap per naming entry."""
        return max(self.figures["most_user_events"] * (2 + self.figures["most_hits"]), 2 * self.figures["most_item_edges"])

    def hits(self) -> DataFrame:
        """The index with one hit count; a price entry decides the type."""
        both = F.col("price_hits") + F.col("product_hits")
        return self.index.select("sku", "id", "customer", "created_at", both.alias("hits"), (F.col("price_hits") > 0).alias("is_price"))

    def sizes(self, left: str, right: str) -> tuple[int, int] | None:
        """Rows of two stored tables, where they have been counted."""
        return (self.figures[left], self.figures[right]) if self.by_user is not None else None

    def join(self, left: DataFrame, right: DataFrame, on: list[str], left_by: list[str], right_by: list[str], sizes: tuple[int, int] | None, many: bool = False) -> DataFrame:
        return balanced_join(left, right, on, left_by, right_by, self.hot_rows, self.stage, sizes, many)

    def near(self, times: DataFrame, targets: DataFrame, window: int, sizes: tuple[int, int] | None, on: list[str] | None = None) -> DataFrame:
        """Usage times and (id, created_at) rows at most ``window`` apart."""
        return window_join(times, targets, "at", "created_at", window, on, ["user", "at"], ["id"], self.hot_rows, self.stage, sizes)


class Matcher(Protocol):
    """Anything with a name and evidence rows can join an ensemble."""

    name: str

    def evidence(self, view: View) -> DataFrame: ...


def part(detail: Column, n: Column) -> Column:
    return F.array(F.struct(detail.alias("v"), n.alias("n")))


def _rows(df: DataFrame, to: Column, kind: Column, matcher: str, confidence: Column, parts: Column, n: Column, note: Column) -> DataFrame:
    return df.select(
        F.col("user").alias("from"), to.alias("to"), kind.alias("kind"), F.lit(matcher).alias("matcher"),
        confidence.alias("confidence"), parts.alias("parts"), n.alias("n"), F.col("at").alias("at"), note.alias("note"),
    )


def _item_kind(is_price: Column) -> Column:
    return F.when(is_price, USER_PRICE).otherwise(USER_PRODUCT)


def _item_note(is_price: Column) -> Column:
    return F.when(is_price, "exact SKU-price match").otherwise("exact SKU-product match")


@dataclass(frozen=True)
class ExactMatcher:
    """Usage user = billing customer; and, among those, usage SKU = a price or product of the subscription."""

    id_mode: str = STRICT
    name: str = EXACT

    def evidence(self, view: View) -> DataFrame:
        return self.subscriptions(view).unionByName(self.invoices(view)).unionByName(self.items(view))

    def _detail(self, sku: Column) -> Column:
        return F.concat_ws("|", F.lit(self.name), F.coalesce(sku, F.lit("")), F.lit(self.id_mode))

    def _by_customer(self, view: View, targets: DataFrame, kind: str, name: str) -> DataFrame:
        """All of a user's SKUs count for each of their targets, so one row per (user, target) carries the list."""
        owned = targets.select(F.col("customer").alias("user"), "id")
        if view.by_user is None:
            usage, by = view.by_sku.select("user", "sku", "at", "n"), ["sku", "at"]
        else:
            usage, by = view.by_user.select("user", "at", "n", "skus"), ["at"]
        pairs = view.join(usage, owned, ["user"], by, ["id"], view.sizes("by_user", name))
        return self.rows(pairs, kind)

    def rows(self, pairs: DataFrame, kind: str) -> DataFrame:
        """Evidence of matched (user, id) pairs, with the user's list of ``skus`` or else one ``sku``."""
        if "skus" in pairs.columns:
            parts = F.transform("skus", lambda s: F.struct(self._detail(s["sku"]).alias("v"), s["n"].alias("n")))
        else:
            parts = part(self._detail(F.col("sku")), F.col("n"))
        return _rows(pairs, F.col("id"), F.lit(kind), self.name, F.lit(1.0), parts, F.col("n"), F.lit("exact customer ID match"))

    def subscriptions(self, view: View) -> DataFrame:
        return self._by_customer(view, view.subs, USER_SUBSCRIPTION, "subs")

    def invoices(self, view: View) -> DataFrame:
        return self._by_customer(view, view.invs, USER_INVOICE, "invs")

    def items(self, view: View) -> DataFrame:
        """One raw edge per naming entry, so entries are counted per (customer, item) before the join."""
        entry = lambda kind: F.struct(F.lit(kind).alias("item_kind"), F.col(f"{kind}_hits").alias("entries"))
        named = view.index.groupBy(F.col("customer").alias("user"), "sku").agg(
            F.sum("price_hits").alias("price_hits"), F.sum("product_hits").alias("product_hits")
        )
        entries = named.select("user", "sku", F.inline(F.array(entry("price"), entry("product")))).where(F.col("entries") > 0)
        is_price = F.col("item_kind") == "price"
        n = F.col("n") * F.col("entries")
        return _rows(
            view.join(view.by_sku, entries, ["user", "sku"], ["at"], ["item_kind"], view.sizes("by_sku", "index")), F.col("sku"), _item_kind(is_price), self.name, F.lit(1.0),
            part(self._detail(F.col("sku")), n), n, _item_note(is_price),
        )


@dataclass(frozen=True)
class TemporalMatcher:
    """Usage within the window of a subscription's or invoice's creation, whoever the customer is."""

    window_sec: int = 3600
    name: str = TEMPORAL

    def evidence(self, view: View) -> DataFrame:
        return self.subscriptions(view).unionByName(self.invoices(view))

    def subscriptions(self, view: View) -> DataFrame:
        return self._near(view, "subs", USER_SUBSCRIPTION)

    def invoices(self, view: View) -> DataFrame:
        return self._near(view, "invs", USER_INVOICE)

    def _near(self, view: View, name: str, kind: str) -> DataFrame:
        times, targets = view.by_time.select("user", "at", "n"), getattr(view, name).select("id", "created_at")
        return self.rows(view.near(times, targets, self.window_sec, view.sizes("by_time", name)), kind)

    def for_keys(self, view: View, keys: DataFrame, kind: str, rows: int | None = None) -> DataFrame:
        """Evidence of the given (user, id, created_at) keys only: an equality on user as well as on time."""
        sizes = None if rows is None or view.by_user is None else (view.figures["by_time"], rows)
        return self.rows(view.near(view.by_time.select("user", "at", "n"), keys, self.window_sec, sizes, ["user"]), kind)

    def nearest(self, view: View, targets: DataFrame, kind: str, keys: DataFrame, stage: Stage, sizes: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
        """Evidence with one row per key, of its smallest distance: (that of the given (user, id, created_at) ``keys``, that of all others).
        No id of ``targets`` may repeat or be null.

        A target lies in one time bucket, and what a user did around it is brought there as one list. So a list and a target are all a key
        has, and the pairs, by far the most rows, are neither shuffled nor grouped.
        """
        bucket = lambda seconds: F.floor(F.col(seconds) / max(self.window_sec, 1))
        around = F.explode(F.array(bucket("at") - 1, bucket("at"), bucket("at") + 1)).alias("_bucket")
        seen = view.by_time.select("user", "at", "n", around).groupBy("user", "_bucket").agg(F.collect_list(F.struct("at", "n")).alias("_seen"))
        known = keys.groupBy(F.col("user").alias("_user"), bucket("created_at").alias("_b")).agg(F.collect_list(F.struct("id", "created_at")).alias("_keys"))
        same = F.col("user").eqNullSafe(F.col("_user")) & (F.col("_bucket") == F.col("_b"))
        lists = stage.table(seen.join(known, same, "left").drop("_user", "_b"), f"near-{uuid.uuid4().hex}")
        given = self._nearest(lists.select("user", "_seen", F.inline("_keys")), kind)
        placed = targets.select("id", "created_at", bucket("created_at").alias("_bucket"))
        pairs = lambda side: view.join(
            side.withColumn("_ids", F.col("_keys.id")).drop("_keys"), placed, ["_bucket"], ["user"], ["id"], None if sizes is None else (3 * sizes[0], sizes[1]), many=True,
        ).where(~F.coalesce(F.array_contains("_ids", F.col("id")), F.lit(False)))
        alone = lists.where(F.size("_seen") == 1).select("user", "_bucket", "_keys", F.col("_seen")[0]["at"].alias("at"), F.col("_seen")[0]["n"].alias("n"))
        near = within(F.col("at"), F.col("created_at"), self.window_sec)
        rest = self.rows(pairs(alone).where(near), kind).unionByName(self._nearest(pairs(lists.where(F.size("_seen") > 1)), kind))
        return given, rest

    def _nearest(self, listed: DataFrame, kind: str) -> DataFrame:
        hits = F.filter("_seen", lambda s: within(s["at"], F.col("created_at"), self.window_sec))
        found = listed.withColumn("_hits", hits).where(F.size("_hits") > 0)
        return self.rows(found.select(
            "user", "id", F.array_min(F.transform("_hits", lambda s: F.abs(s["at"] - F.col("created_at")))).alias("distance"),
            F.aggregate("_hits", F.lit(0).cast("bigint"), lambda total, s: total + s["n"]).alias("n"), F.array_max("_hits.at").alias("at"),
        ), kind)

    def rows(self, pairs: DataFrame, kind: str) -> DataFrame:
        """Evidence of pairs with the time ``created_at`` of their target, or else with their ``distance``."""
        diff = F.col("distance") if "distance" in pairs.columns else F.abs(F.col("at") - F.col("created_at"))
        target = "subscription" if kind == USER_SUBSCRIPTION else "invoice"
        return _rows(
            pairs, F.col("id"), F.lit(kind), self.name, temporal_confidence(diff, self.window_sec),
            part(F.concat_ws("|", F.lit(self.name), diff.cast("string")), F.col("n")), F.col("n"),
            F.concat(F.lit("usage within "), diff.cast("string"), F.lit(f"s of {target} creation")),
        )


@dataclass(frozen=True)
class SkuMatcher:
    """Usage SKU named by a subscription: one edge to the subscription and one to the item per naming entry."""

    name: str = SKU

    def evidence(self, view: View) -> DataFrame:
        return self.subscriptions(view).unionByName(self.items(view))

    def _detail(self) -> Column:
        return F.concat_ws("|", F.lit(self.name), F.col("sku"))

    def subscriptions(self, view: View) -> DataFrame:
        pairs = view.join(view.by_sku, view.hits(), ["sku"], ["user", "at"], ["id"], view.sizes("by_sku", "index"))
        return self.subscription_rows(pairs)

    def subscription_rows(self, pairs: DataFrame) -> DataFrame:
        note = F.concat(F.lit("SKU matched subscription "), F.when(F.col("is_price"), "price").otherwise("product"))
        n = F.col("n") * F.col("hits")
        return _rows(pairs, F.col("id"), F.lit(USER_SUBSCRIPTION), self.name, F.lit(0.8), part(self._detail(), n), n, note)

    def items(self, view: View) -> DataFrame:
        """Item edges do not name the subscription, so the hits of all subscriptions add up before the join."""
        totals = view.hits().groupBy("sku", "is_price").agg(F.sum("hits").alias("hits"))
        is_price, n = F.col("is_price"), F.col("n") * F.col("hits")
        return _rows(
            view.join(view.by_sku, totals, ["sku"], ["user", "at"], ["is_price"], view.sizes("by_sku", "index")),
            F.col("sku"), _item_kind(is_price), self.name, F.lit(0.9),
            part(self._detail(), n), n, _item_note(is_price),
        )


def proof_text(detail: Column) -> Column:
    """The text a raw edge's proof signs."""
    return F.concat_ws("|", F.col("from"), F.col("to"), F.col("kind"), detail)


def raw_edges(evidence: DataFrame, hasher: KeyedHash, id_mode: str = STRICT) -> DataFrame:
    """One LinkEdge row per raw edge, proofs included."""
    listed = evidence.select("from", "to", "kind", "matcher", "confidence", "at", "note", F.inline("parts"))
    signed = hasher.with_columns(listed, {"proof": mac(proof_text(F.col("v")))})
    expanded = signed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return expanded.select(
        F.struct(F.lit(EDGE_SCHEMA_NAME).alias("schema"), F.lit(id_mode).alias("id_mode")).alias("meta"),
        "from", "to", "kind", "confidence", "proof", F.concat("matcher", F.lit("/v1")).alias("recipe"),
        "at", F.col("note").alias("notes"),
    )
