"""Scalar rules of the matchers and of the ensemble."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPORAL_BASE = 0.6


def within(ts: Column, center: Column, window: int | Column) -> Column:
    """Whether ``ts`` lies at most ``window`` from ``center``, ends included; never for a window <= 0."""
    window = F.lit(window) if isinstance(window, int) else window
    return (window > 0) & (F.abs(ts - center) <= window)


def temporal_confidence(diff: Column, window: int) -> Column:
    """0.6 at no distance, falling linearly to 0 at the window's edge."""
    if window <= 0:
        return F.lit(0.0)
    return F.least(F.lit(TEMPORAL_BASE), F.greatest(F.lit(0.0), F.lit(TEMPORAL_BASE) * (F.lit(1.0) - diff / F.lit(window))))


def two_decimals(value: Column) -> Column:
    """Round the exact binary value, as C's ``%.2f`` does; ``format_string`` rounds the decimal text instead."""
    return F.replace(F.format_number(value, 2), F.lit(","), F.lit(""))


def combined_note(notes: Column, score: Column, limit: int | None = None) -> Column:
    """Distinct notes in byte order plus the score. ``notes`` must be sorted. A text over ``limit`` characters, if
    one is given, ends in ``...`` at that length."""
    tail = F.concat(F.lit(" (score="), two_decimals(score), F.lit(")"))
    text = F.concat(F.array_join(notes, "; "), tail)
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def confidence_class(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.6, "medium").otherwise("low")
