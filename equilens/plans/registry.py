"""Registry of named queries: a Spark plan and, where SQL can express it, the
equivalent DuckDB statement over the same parquet tables (the oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
ROWS: dict[str, str] = {}   # survey row ids per key, for docs


def register(key: str, sql: str | None = None, rows: str = ""):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        ROWS[key] = rows
        return fn
    return deco
