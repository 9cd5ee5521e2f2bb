"""Registration of queries and the shape in which results are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
# Added before rounding, so that exact decimal ties do not depend on the order of a sum.
NUDGE = 2e-8


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result in ANSI SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shown(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Result columns as plain text, bigint and rounded double."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + NUDGE, digits)
        elif isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            c = c.cast("bigint")
        elif not isinstance(f.dataType, T.StringType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL of a rounded double without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE) + {NUDGE}, {digits}) + 0.0)"


def n(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def s(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"
