"""How a module registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def catalogue() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """(queries, SQL, decorator): ``@query(sql)`` registers a function under its name."""
    queries: dict[str, Query] = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def keep(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return keep

    return queries, oracle, query
