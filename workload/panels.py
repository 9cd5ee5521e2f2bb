"""Panels derived from the given tables, as DataFrames and as SQL.

Columns: ``k`` (and ``t``) series key, ``d`` date, ``y`` target. Every panel is
an aggregation of whole tables to one row per key and period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.grid import complete_panel, fill_time_gaps, to_panel
from seriesloom.spec import PanelSpec
from workload.registry import table

WEEKLY = PanelSpec("d", "y", ("k",), frequency="W")
DAILY = PanelSpec("d", "y", ("k",), frequency="D")
DAILY_BY_TYPE = PanelSpec("d", "y", ("k", "t"), frequency="D")
MONTHLY = PanelSpec("d", "y", ("k",), frequency="MS")


def _week(col: str):
    return F.trunc(F.col(col), "week")


def supplier_week(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("k"), _week("l_shipdate").alias("d"), "l_quantity"
    )
    return to_panel(rows, WEEKLY, {"y": F.sum("l_quantity")})


def part_week(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("k"), _week("l_shipdate").alias("d"), "l_quantity"
    )
    return to_panel(rows, WEEKLY, {"y": F.sum("l_quantity")})


def brand_day(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("k"))
    rows = table(spark, folder, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("d"), "l_quantity")
    # Reduced to part and day before the join: the join moves partial sums only.
    daily = rows.groupBy("l_partkey", "d").agg(F.sum("l_quantity").alias("q"))
    return to_panel(daily.join(part, "l_partkey"), DAILY, {"y": F.sum("q")})


def brand_month(spark: SparkSession, folder: str) -> DataFrame:
    daily = brand_day(spark, folder).withColumn("d", F.trunc("d", "month"))
    return to_panel(daily, MONTHLY, {"y": F.sum("y")})


def customer_week(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("k"), _week("o_orderdate").alias("d"), "o_totalprice"
    )
    return to_panel(rows, WEEKLY, {"y": F.round(F.sum("o_totalprice"), 2)})


def user_day(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.col("user_id").alias("k"), F.col("ts").cast("date").alias("d"), "value")
    return to_panel(rows, DAILY, {"y": F.round(F.sum("value"), 2), "x": F.count("*")})


def user_type_day(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("k"), F.col("event_type").alias("t"), F.col("ts").cast("date").alias("d"), "value"
    )
    return to_panel(rows, DAILY_BY_TYPE, {"y": F.round(F.sum("value"), 2), "x": F.count("*")})


def supplier_week_full(spark, folder):
    return complete_panel(supplier_week(spark, folder), WEEKLY)


def brand_month_full(spark, folder):
    return complete_panel(brand_month(spark, folder), MONTHLY)


def user_type_day_filled(spark, folder):
    return fill_time_gaps(user_type_day(spark, folder), DAILY_BY_TYPE)


SUPPLIER_WEEK = """SELECT l_suppkey AS k, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, sum(l_quantity) AS y
  FROM lineitem GROUP BY 1, 2"""
PART_WEEK = """SELECT l_partkey AS k, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, sum(l_quantity) AS y
  FROM lineitem GROUP BY 1, 2"""
BRAND_DAY = """SELECT p_brand AS k, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
BRAND_MONTH = """SELECT p_brand AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, sum(l_quantity) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
CUSTOMER_WEEK = """SELECT o_custkey AS k, CAST(date_trunc('week', o_orderdate) AS DATE) AS d, round(sum(o_totalprice), 2) AS y
  FROM orders GROUP BY 1, 2"""
USER_DAY = """SELECT user_id AS k, CAST(ts AS DATE) AS d, round(sum(value), 2) AS y, count(*) AS x
  FROM events GROUP BY 1, 2"""
USER_TYPE_DAY = """SELECT user_id AS k, event_type AS t, CAST(ts AS DATE) AS d, round(sum(value), 2) AS y, count(*) AS x
  FROM events GROUP BY 1, 2, 3"""


def with_grid(panel: str, step: str = "7 DAY", keys: str = "k", fill: str | None = "0") -> str:
    """SQL prefix defining ``panel``, ``grid`` and the completed ``filled``."""
    y = f"coalesce(p.y, {fill})" if fill is not None else "p.y"
    same = " AND ".join(f"g.{c} = p.{c}" for c in keys.split(", "))
    extra = ", p.x" if " AS x" in panel else ""
    return f"""WITH RECURSIVE panel AS ({panel}),
 grid AS (SELECT {keys}, CAST(unnest(generate_series(lo, hi, INTERVAL {step})) AS DATE) AS d
          FROM (SELECT {keys}, min(d) AS lo, max(d) AS hi FROM panel GROUP BY {keys})),
 filled AS (SELECT {", ".join("g." + c for c in keys.split(", "))}, g.d, {y} AS y{extra}, p.d IS NULL AS inserted
          FROM grid g LEFT JOIN panel p ON {same} AND g.d = p.d)"""
