"""Registered queries by group."""

from __future__ import annotations

from . import intake, linking, queues, records, streams
from .common import Query

GROUPS = (linking, records, intake, queues, streams)


def all_queries() -> dict[str, Query]:
    return {name: query for group in GROUPS for name, query in group.catalog.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: text for group in GROUPS for name, text in group.catalog.sql.items()}
