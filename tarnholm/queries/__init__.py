"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import learned, operators, tpch

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (operators, tpch, learned):
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
