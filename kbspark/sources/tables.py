"""Table access: parquet tables by name and parameterised SQL over them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_with(spark: SparkSession, sql: str, params: Mapping[str, Any] | None = None,
               **frames: DataFrame) -> DataFrame:
    """Run SQL text with ``:named`` parameters; ``{frame}`` slots name DataFrames."""
    return spark.sql(sql, args=dict(params or {}), **frames)


def count_with(spark: SparkSession, sql: str, params: Mapping[str, Any] | None = None,
               **frames: DataFrame) -> int:
    """First cell of a counting statement, 0 when it returns no row."""
    row = query_with(spark, sql, params, **frames).first()
    return int(row[0]) if row and row[0] is not None else 0
