"""Checks on what leaves: no personal fields, no raw ids, only synthetic identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import PLATFORM_PREFIXES, is_synthetic

# Patterns a leak would match in a JSON payload.
FIELD_PATTERN = r'"(name|email|phone|address)"\s*:'
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
RAW_ID_PATTERN = rf'"({"|".join(PLATFORM_PREFIXES)})[^"]*"(?!\s*:)'
# What a match of the first or the last of them begins with.
SUSPECT_PATTERN = rf'"(?:(?:name|email|phone|address)"|{"|".join(PLATFORM_PREFIXES)})'


def leaks(exports: DataFrame, payload: str = "payload") -> DataFrame:
    """One row of counts over all exported payloads; zeros mean nothing leaked."""
    text = F.col(payload)
    ids = F.from_json(text, "id STRING, customer STRING, `from` STRING, `to` STRING")
    foreign = lambda v: v.isNotNull() & ~is_synthetic(v)
    suspect = F.col("_suspect")  # spares clean payloads the two longer searches
    exports = exports.select(text.alias(payload), ids.alias("_ids"), text.rlike(SUSPECT_PATTERN).alias("_suspect"))
    not_synthetic = foreign(F.col("_ids.id")) | foreign(F.col("_ids.customer")) | foreign(F.col("_ids.from")) | foreign(F.col("_ids.to"))
    return exports.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(suspect & text.rlike(FIELD_PATTERN)).alias("personal_fields"),
        F.count_if(F.contains(text, F.lit("@")) & text.rlike(EMAIL_PATTERN)).alias("email_addresses"),
        F.count_if(suspect & text.rlike(RAW_ID_PATTERN)).alias("raw_ids"),
        F.count_if(not_synthetic).alias("not_synthetic"),
    )


def exported_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """Records of exported lines, each a JSON array (or a single object)."""
    text = F.col(line)
    array = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return lines.select(F.explode(F.from_json(array, "array<string>")).alias("payload"))


def edges_by_kind(records: DataFrame, payload: str = "payload") -> DataFrame:
    return records.groupBy(F.get_json_object(payload, "$.kind").alias("kind")).agg(F.count(F.lit(1)).alias("records"))
