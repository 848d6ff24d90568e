"""Where plan modules register their queries and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from convlake.testbed import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, tagged: bool = False) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` may use conv, msg, notes and captures."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, tagged)
        return f

    return add
