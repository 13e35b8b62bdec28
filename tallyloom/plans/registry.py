"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the DuckDB statement with the same result."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def sig(c: Column | str, digits: int = 9) -> Column:
    """Round a double to significant digits, so sums taken in another order agree."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.format_string(f"%.{digits - 1}e", c.cast("double")).cast("double") + F.lit(0.0))


def sqlsig(expr: str, digits: int = 9) -> str:
    """The SQL text of :func:`sig`."""
    return f"(CAST(printf('%.{digits - 1}e', CAST({expr} AS DOUBLE)) AS DOUBLE) + 0.0)"
