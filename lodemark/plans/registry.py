"""Registered queries: a Spark function, the survey rows it covers and, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, tuple[int, ...]] = {}


def query(*rows: int, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = rows
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add
