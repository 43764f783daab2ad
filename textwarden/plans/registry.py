"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.spread import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        n = name or f.__name__
        if n in QUERIES:
            raise ValueError(f"two queries named {n}")
        QUERIES[n] = f
        if sql:
            SQL[n] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{table}.parquet")
    return df.select(*columns) if columns else df


def texts(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    """As read, with enough parts for costly work on each row."""
    return spread(read(spark, d, table, *columns))


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(col: str, parts) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(p)})" for p in parts) + ")"
