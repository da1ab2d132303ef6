"""Input checks: every identifier must be synthetic and every usage must carry a time."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import is_synthetic
from ..recipe import STRICT
from .matchers import LinkInputs

REASON = "reason"


def _first_failure(*checks: tuple[Column, str]) -> Column:
    """Name of the first failed check, null when all hold."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for failed, name in checks])


def usage_reason(strict: bool = True) -> Column:
    return _first_failure(
        *([(~is_synthetic(F.col("user")), "user_not_synthetic")] if strict else [(F.coalesce("user", F.lit("")) == "", "user_empty")]),
        (F.coalesce(F.col("at"), F.lit(0)) <= 0, "at_not_positive"),
    )


def _empty(*names: str) -> list[tuple[Column, str]]:
    """In passthrough mode ids keep their form, but must be there."""
    return [(F.coalesce(F.col(n), F.lit("")) == "", f"{n}_empty") for n in names]


def subscription_reason(with_items: bool = True, strict: bool = True) -> Column:
    if not strict:
        return _first_failure(*_empty("id", "customer"))
    checks = [
        (~is_synthetic(F.col("id")), "id_not_synthetic"),
        (~is_synthetic(F.col("customer")), "customer_not_synthetic"),
    ]
    if with_items:
        checks += [
            (~F.forall("price_ids", is_synthetic), "price_not_synthetic"),
            (~F.forall("product_ids", is_synthetic), "product_not_synthetic"),
        ]
    return _first_failure(*checks)


def item_reason(strict: bool = True) -> Column:
    """An item names its subscription and customer itself, so all three ids are checked."""
    if not strict:
        return _first_failure(*_empty("sub_id", "customer", "item_id"))
    return _first_failure(
        (~is_synthetic(F.col("sub_id")), "subscription_not_synthetic"),
        (~is_synthetic(F.col("customer")), "customer_not_synthetic"),
        (~is_synthetic(F.col("item_id")), "item_not_synthetic"),
    )


def invoice_reason(strict: bool = True) -> Column:
    if not strict:
        return _first_failure(*_empty("id", "customer"))
    linked = F.coalesce(F.col("subscription"), F.lit(""))
    return _first_failure(
        (~is_synthetic(F.col("id")), "id_not_synthetic"),
        (~is_synthetic(F.col("customer")), "customer_not_synthetic"),
        ((linked != "") & ~is_synthetic(linked), "subscription_not_synthetic"),
    )


def split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a reason)."""
    checked = df.withColumn(REASON, reason)
    return checked.where(F.col(REASON).isNull()).drop(REASON), checked.where(F.col(REASON).isNotNull())


def failures(relation: str, df: DataFrame, reason: Column) -> DataFrame:
    return df.select(reason.alias(REASON)).where(F.col(REASON).isNotNull()).groupBy(REASON).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(relation).alias("relation"), REASON, "rows"
    )


class InvalidInput(ValueError):
    pass


def _checked(inputs: LinkInputs, strict: bool) -> dict[str, DataFrame]:
    """Each relation with the reason of every row, null if it stands. An item of a subscription that is not among
    the valid ones does not stand either."""
    subs = inputs.subs.withColumn(REASON, subscription_reason("price_ids" in inputs.subs.columns, strict))
    marked = {"usages": inputs.usages.withColumn(REASON, usage_reason(strict)), "subs": subs, "invs": inputs.invs.withColumn(REASON, invoice_reason(strict))}
    if inputs.items is not None:
        valid = subs.where(F.col(REASON).isNull()).select(F.col("id").alias("_valid")).distinct()
        items = inputs.items.withColumn(REASON, item_reason(strict)).join(valid, F.col("sub_id") == F.col("_valid"), "left")
        marked["items"] = items.withColumn(REASON, F.coalesce(REASON, F.when(F.col("_valid").isNull(), "subscription_not_valid"))).drop("_valid")
    return marked


def checked_inputs(inputs: LinkInputs, id_mode: str = STRICT) -> tuple[LinkInputs, DataFrame]:
    """(the valid rows, the rejected ones as relation, reason and the row in JSON). The prefix rule holds in strict id
    mode; in passthrough mode ids must not be empty."""
    valid, rejects = {}, None
    for relation, df in _checked(inputs, id_mode == STRICT).items():
        valid[relation] = df.where(F.col(REASON).isNull()).drop(REASON)
        kept = [c for c in df.columns if c != REASON]
        part = df.where(F.col(REASON).isNotNull()).select(F.lit(relation).alias("relation"), REASON, F.to_json(F.struct(*kept)).alias("row"))
        rejects = part if rejects is None else rejects.unionByName(part)
    return replace(inputs, **valid), rejects


def check_inputs(inputs: LinkInputs, on_invalid: str = "fail", id_mode: str = STRICT) -> LinkInputs:
    """``fail`` raises when any row breaks a rule; ``quarantine`` goes on with the valid rows (`checked_inputs` also gives the others)."""
    if on_invalid not in ("fail", "quarantine"):
        raise ValueError(f"on_invalid must be 'fail' or 'quarantine', got {on_invalid!r}")
    valid, rejects = checked_inputs(inputs, id_mode)
    if on_invalid == "quarantine":
        return valid
    bad = rejects.groupBy("relation", REASON).agg(F.count(F.lit(1)).alias("rows")).collect()  # one row per rule
    if bad:
        raise InvalidInput("; ".join(f"{r['relation']}: {r[REASON]} in {r['rows']} rows" for r in sorted(bad)))
    return inputs
