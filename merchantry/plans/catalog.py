"""The registered queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from merchantry.plans import browse, forms, layouts, mining, pages, shops, streams, tables

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [shops, browse, tables, mining, pages, streams, layouts, forms]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
