"""Registered queries with, where SQL can say the same, their DuckDB check text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kbspark.sources.fixtures import check_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
MODULES = ("base", "predicates", "usage", "sessions", "retrieval", "chunks", "graph", "maintenance", "streams")
CHECKS: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Adds the decorated function under ``name``; ``views`` lists the derived views ``sql`` uses."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = check_sql(sql, *views.split())
        return fn

    return add


def load_all() -> None:
    import importlib

    for m in MODULES:
        importlib.import_module(f"kbspark.catalog.{m}")
