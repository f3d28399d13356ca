"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = (
    "source_queries", "filter_queries", "join_queries", "aggregate_queries", "window_queries",
    "scalar_queries", "matching_queries", "raster_queries", "streaming_queries",
)


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"arborlift.plans.{module}")
