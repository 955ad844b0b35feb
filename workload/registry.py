"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL where SQL can say it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Its schema is read from the file once per process, not once per query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def rnd(c, digits: int = 4) -> Column:
    """Rounded for comparison. A nudge far below the last digit keeps exact halves from going either way, adding 0 drops the sign
    of -0.0. :func:`R` says the same in SQL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def R(expr: str, digits: int = 4) -> str:
    return f"(round({expr} + 1e-{digits + 3}, {digits}) + 0)"


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    for n in names:
        df = df.withColumn(n, rnd(n, digits))
    return df
