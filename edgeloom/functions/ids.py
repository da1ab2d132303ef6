"""Synthetic identifiers and tests of identifier form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..recipe import PASSTHROUGH, STRICT, SettingsError
from .keyed_hash import mac

# Prefix of each entity's synthetic id.
PREFIXES = {
    "customer": "syn_cust",
    "subscription": "syn_sub",
    "invoice": "syn_inv",
    "price": "syn_price",
    "product": "syn_prod",
    "charge": "syn_ch",
    "refund": "syn_ref",
}

SYNTHETIC_PREFIX = "syn_"

# Prefixes of the billing platform's own ids.
PLATFORM_PREFIXES = ("cus_", "sub_", "in_", "price_", "prod_", "pi_", "pm_")


def synthetic_id(raw: Column, prefix: str) -> Column:
    """``prefix_`` and the first 16 hex digits of the keyed hash; null for a null or empty id."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(mac(raw), 1, 16))


def map_id(raw: Column, entity: str, mode: str = STRICT) -> Column:
    """Map a raw id of ``entity`` to the id used downstream; null where the raw id is missing."""
    if mode == STRICT:
        return synthetic_id(raw, PREFIXES[entity])
    if mode == PASSTHROUGH:
        return F.nullif(raw, F.lit(""))
    raise SettingsError(f"unknown id mode {mode!r}")


def is_synthetic(value: Column) -> Column:
    return F.coalesce(F.startswith(value, F.lit(SYNTHETIC_PREFIX)), F.lit(False))


def is_platform_id(value: Column) -> Column:
    return F.coalesce(value.rlike(f"^({'|'.join(PLATFORM_PREFIXES)})"), F.lit(False))
