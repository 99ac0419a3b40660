"""The register of queries and of the SQL that states what they compute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of ``Tables`` under its own name, with the SQL for the same rows if SQL can state it."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, path: f(Tables(spark, path))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
