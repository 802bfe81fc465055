"""The queries that the driver runs, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, folder of the tables) under a name, with SQL that gives the same rows."""
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
