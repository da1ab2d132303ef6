"""Billing-only export: scan, sanitise, write. No shuffle until the batches are framed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.keyed_hash import KeyedHash
from ..operators.sanitize import sanitize_invoices, sanitize_subscriptions
from ..recipe import STRICT
from ..sinks.export import billing_records
from ..sources.billing import probe


def billing_stream(raw_subs: DataFrame, raw_invs: DataFrame, hasher: KeyedHash, mode: str = STRICT) -> DataFrame:
    return billing_records(sanitize_subscriptions(raw_subs, hasher, mode), sanitize_invoices(raw_invs, hasher, mode))


def check_sources(*sources: DataFrame) -> None:
    """Fail before any work if a source cannot be read."""
    for source in sources:
        probe(source)
