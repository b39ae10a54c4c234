"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table


class Book:
    """Queries of one module by name, and the SQL of those that SQL can express on whole tables."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add


def once(spark: SparkSession, folder: str, name: str, key: str, columns: list[str]) -> DataFrame:
    """Columns of a table whose rows may be delivered again: each key once (its content is the same)."""
    return table(spark, folder, name).select(key, *columns).dropDuplicates([key])
