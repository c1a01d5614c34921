"""Registry of queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; without ``sql`` only its rows are checked."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rnd(column: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded double, so two engines agree on the last bits of a sum."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c.cast("double"), digits)
    return out.alias(name or column) if (name or isinstance(column, str)) else out


def text(column: str | Column, name: str | None = None) -> Column:
    """Dates and instants as text, to be engine neutral."""
    c = F.col(column) if isinstance(column, str) else column
    out = c.cast("string")
    return out.alias(name or column) if (name or isinstance(column, str)) else out
