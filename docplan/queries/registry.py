"""Registered queries: name -> (Spark query, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    """Registers a query under its function name, with its check if it has one."""

    def add(query: Query) -> Query:
        key = name or query.__name__
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return add


def load_all() -> None:
    from docplan.queries import extraction, measuring, planning, sources  # noqa: F401
