"""Registration of checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseloom.harness.shapes import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, shapes: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator, with the equivalent SQL over the same shapes."""

    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = oracle(shapes.split(), sql)
        return query

    return register
