"""Readers, writers, and selection of columns and rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seriesloom import make_spec
from seriesloom.operators import select
from seriesloom.sources import readers, writers
from seriesloom.session import shared_folder
from workload import panels as P
from workload.registry import n, query, r, s, shown, table

ORDERS = make_spec("o_orderdate", "o_totalprice", ["o_custkey", "o_orderkey"], ["o_orderstatus"], ["o_orderpriority"], "D")


def _place(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query(
    "loaded_panel",
    f"""SELECT o_custkey, o_orderkey, {s("CAST(o_orderdate AS DATE)")} AS o_orderdate, {r("o_totalprice")} AS o_totalprice, o_orderstatus, o_orderpriority FROM orders""",
)
def loaded_panel(spark, folder):
    df = readers.load_data(spark, f"{folder}/orders.parquet", ORDERS)
    return shown(df.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority"))


@query(
    "loaded_without_columns",
    f"""SELECT l_suppkey, l_partkey, {s("CAST(l_shipdate AS DATE)")} AS l_shipdate, {r("l_quantity")} AS l_quantity, l_orderkey, {r("l_extendedprice")} AS l_extendedprice, {r("l_discount")} AS l_discount FROM lineitem""",
)
def loaded_without_columns(spark, folder):
    return shown(
        readers.load_forecasting_data(
            spark, f"{folder}/lineitem.parquet", "l_shipdate", "l_quantity", ["l_suppkey", "l_partkey"], exclude_cols=["l_line*", "l_tax", "l_returnflag", "l_tax"]
        )
    )


@query(
    "csv_panel_with_types",
    f"""SELECT l_orderkey, l_suppkey, {n("l_linenumber")} AS l_linenumber, {s("CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END")} AS d,
 {r("CASE WHEN l_linenumber <> 6 THEN l_quantity END")} AS y, {r("l_discount")} AS l_discount FROM lineitem""",
)
def csv_panel_with_types(spark, folder):
    """Written as CSV and read back with declared types; text that is no date or number becomes null."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_discount",
        F.when(F.col("l_linenumber") == 7, "someday").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("d"),
        F.when(F.col("l_linenumber") == 6, "many").otherwise(F.col("l_quantity").cast("string")).alias("y"),
    )
    path = _place(spark, "lines_csv")
    writers.write_csv(lines, path)
    spec = make_spec("d", "y", ["l_suppkey", "l_orderkey"], dynamic_cols=["l_discount"])
    return shown(readers.load_data(spark, path, spec, "csv", "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_discount double, d string, y string"))


@query(
    "loaded_series",
    f"""{P.with_grid("SELECT 'all' AS k, CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS y FROM orders WHERE day(o_orderdate) % 3 <> 0 GROUP BY 1, 2", "1 DAY", "k", None)}
SELECT 'sales' AS series, {s("d")} AS day, {r("last_value(y IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 2)} AS total FROM filled""",
)
def loaded_series(spark, folder):
    """One daily series from a CSV with its own date pattern, completed and filled forward."""
    days = table(spark, folder, "orders").filter(F.dayofmonth("o_orderdate") % 3 != 0).groupBy(F.to_date("o_orderdate").alias("_d")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    path = _place(spark, "series_csv")
    writers.write_csv(days.select(F.date_format("_d", "dd.MM.yyyy").alias("day"), "total"), path)
    return shown(readers.load_timeseries(spark, path, "day", "total", "D", "ffill", date_format="dd.MM.yyyy", series_name="sales"), 2)


@query("dates_from_parts", f"""SELECT o_orderkey, {s("CAST(date_trunc('month', o_orderdate) AS DATE)")} AS month FROM orders""")
def dates_from_parts(spark, folder):
    parts = table(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("_y"), F.date_format("o_orderdate", "MMM").alias("_m"))
    return shown(parts.select("o_orderkey", readers.date_from_parts("_y", "_m").alias("month")))


@query(
    "several_tables",
    f"""SELECT o_orderkey, {s("CAST(o_orderdate AS DATE)")} AS o_orderdate, c_mktsegment, {n("c_nationkey")} AS c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def several_tables(spark, folder):
    got = readers.read_tables(
        spark, folder, {"orders": {"dates": ["o_orderdate"], "drop": ["o_totalprice", "o_orderstatus", "o_orderpriority"]}, "customer": {"drop": ["c_name", "c_acctbal"]}}, "parquet"
    )
    return shown(got["orders"].join(got["customer"], F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey"))


@query("partitioned_store", f"""SELECT {n("year(l_shipdate)")} AS year, count(*) AS lines, {r("sum(l_quantity)")} AS quantity FROM lineitem GROUP BY 1""")
def partitioned_store(spark, folder):
    """Rows written by year and read back; the filter-free total proves that every partition is there."""
    path = _place(spark, "lines_by_year")
    writers.write_parquet(table(spark, folder, "lineitem").select("l_quantity", F.year("l_shipdate").alias("year")), path, ["year"])
    return shown(spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity")))


@query("columns_by_prefix", f"""SELECT l_orderkey, {n("l_linenumber")} AS l_linenumber, {r("l_discount")} AS l_discount, l_linestatus FROM lineitem""")
def columns_by_prefix(spark, folder):
    lines = table(spark, folder, "lineitem")
    return shown(lines.select(*select.columns_starting(lines, ["l_dis", "l_line", "l_order"])))


@query(
    "ordered_totals",
    f"""SELECT row_number() OVER (ORDER BY y DESC, k) AS place, k, {r("y", 2)} AS y FROM (SELECT o_custkey AS k, sum(o_totalprice) AS y FROM orders GROUP BY 1) ORDER BY y DESC, k LIMIT 50""",
)
def ordered_totals(spark, folder):
    """The fifty largest customers in report order, each with its place."""
    totals = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("y"))
    top = select.ordered_report(totals, "y", ["k"]).limit(50)
    # Fifty rows: the place needs no key.
    return shown(top.withColumn("place", select.rank_within([], [F.desc("y"), F.asc("k")])), 2)


@query(
    "latest_rows",
    f"""WITH panel AS ({P.CUSTOMER_WEEK}) SELECT k, {r("arg_max(y, d)", 2)} AS y FROM panel GROUP BY k""",
)
def latest_rows(spark, folder):
    return shown(select.latest_row_per_key(P.customer_week(spark, folder), P.WEEKLY, "y"), 2)


@query(
    "ranked_orders",
    f"""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders""",
)
def ranked_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    place = select.rank_within(["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return shown(orders.withColumn("place", place).drop("o_totalprice"))
