"""Shared by the query groups: each maps a name to a Spark query and, where SQL can say it, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.keyed_hash import KeyedHash
from ..sources.testviews import TEST_SALT

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def test_hasher(spark: SparkSession) -> KeyedHash:
    return KeyedHash(spark, TEST_SALT)
