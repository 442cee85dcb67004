"""All registered queries of the core and, where it is installed, of the text subpackage."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["instants", "document_queries", "record_queries"]

Query = Callable[[SparkSession, str], DataFrame]


def core_queries() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        module = importlib.import_module(f"{__package__}.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
