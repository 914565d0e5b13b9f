"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[..., Callable[[Query], Query]]]:
    """Empty QUERIES and SQL, and the decorator query(name, sql) that fills them."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(name: str, text: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[name] = f
            if text:
                sql[name] = text
            return f

        return add

    return queries, sql, query
