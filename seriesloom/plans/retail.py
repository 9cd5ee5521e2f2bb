"""Retail feature table: sales, product and calendar tables joined and enriched.

Tables: ``sales(unique_id, date, warehouse, total_orders, sales, sell_price_main,
type_0_discount .. type_6_discount)``, ``inventory(unique_id, name, ..)``,
``calendar(date, warehouse, holiday_name, holiday, ..)``.

Group statistics are aggregated and joined back, so a family or warehouse with
very many rows is reduced on the map side. Only statistics along time use
windows, per product or per warehouse and at one row per day.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.calendar import days_since
from seriesloom.operators.grid import extend_to_last_date
from seriesloom.operators.impute import join_on_keys, next_value, previous_value
from seriesloom.operators.recurrence import ewm_mean, long_ema
from seriesloom.operators.select import composite_key, not_below, strongest
from seriesloom.operators.transforms import remove_group_mean
from seriesloom.operators.windows import add_time_range_features
from seriesloom.spec import PanelSpec

PRODUCT = PanelSpec("date", "sales", ("unique_id",))
WAREHOUSE = PanelSpec("date", "med_total_orders", ("warehouse",))
# Promotions counted for the strongest discount; the seventh type is not.
PROMOTIONS = [f"type_{i}_discount" for i in range(6)]
DISCOUNTS = [*PROMOTIONS, "type_6_discount"]


def holiday_proximity(calendar: DataFrame, keep_distances: bool = False) -> DataFrame:
    """Day-before and day-after flags of the nearest holidays in each warehouse.

    A holiday without a name does not count.
    """
    spec = PanelSpec("date", "holiday", ("warehouse",))
    named = calendar.withColumn("holiday", F.when(F.col("holiday_name").isNull(), 0).otherwise(F.col("holiday")))
    day = F.when(F.col("holiday") != 0, F.col("date"))
    out = named.withColumns(
        {
            "days_since_last_holiday": F.datediff("date", previous_value(day, spec)),
            "days_to_next_holiday": F.datediff(next_value(day, spec), F.col("date")),
        }
    )
    out = out.withColumns(
        {
            "day_before_holiday": F.coalesce(F.col("days_to_next_holiday") == 1, F.lit(False)),
            "day_after_holiday": F.coalesce(F.col("days_since_last_holiday") == 1, F.lit(False)),
        }
    )
    return out if keep_distances else out.drop("days_since_last_holiday", "days_to_next_holiday")


def row_features(df: DataFrame) -> DataFrame:
    """Features of a row alone: date, discounts, log price, product family."""
    doy = F.dayofyear("date") * (2 * math.pi) / 365
    clipped = df.withColumns({c: not_below(F.col(c)) for c in DISCOUNTS if c in df.columns})
    return clipped.withColumns(
        {
            "year": F.year("date"),
            "day_of_week": F.weekday("date"),
            "days_since_2020": days_since("date", "2020-01-01"),
            "day_of_year": F.dayofyear("date"),
            "cos_day": F.cos(doy),
            "sin_day": F.sin(doy),
            "max_discount": strongest([c for c in PROMOTIONS if c in df.columns]),
            "sell_price_main": F.ln("sell_price_main"),
            "common_name": F.substring_index("name", "_", 1),
        }
    ).withColumn("CN_WH", composite_key(["common_name", "warehouse"]))


def family_features(df: DataFrame) -> DataFrame:
    """Per date, warehouse and family: products on sale and their mean discount."""
    return df.groupBy("date", "warehouse", "common_name").agg(
        F.countDistinct("unique_id").alias("CN_total_products"), F.avg("max_discount").alias("CN_discount_avg")
    )


def name_features(df: DataFrame) -> DataFrame:
    """Per date and product name: warehouses that sell it."""
    return df.groupBy("date", "name").agg(F.countDistinct("unique_id").alias("name_num_warehouses"))


def warehouse_index(df: DataFrame) -> DataFrame:
    """Per warehouse and day: median orders, their 14-day mean and long weighted mean.

    Equal order counts of a day are merged before the median is taken.
    """
    counts = df.groupBy("date", "warehouse", "total_orders").agg(F.count("total_orders").alias("_n"))
    daily = counts.filter("_n > 0").groupBy("date", "warehouse").agg(F.percentile("total_orders", 0.5, F.col("_n")).alias("med_total_orders"))
    smooth = add_time_range_features(daily, ["warehouse"], "date", {"mean_orders_14d": ("med_total_orders", "mean", -13, 0)})
    smooth = ewm_mean(smooth, WAREHOUSE, F.col("med_total_orders"), 1 / 56, "ewmean_orders_56", adjust=True)
    return smooth.drop("med_total_orders")


def product_features(df: DataFrame) -> DataFrame:
    """Days on sale in the last four weeks and the price relative to the product's usual price.

    Both are windows over one partitioning by product (one row per product and day).
    """
    out = add_time_range_features(df, ["unique_id"], "date", {"num_sales_days_28D": ("date", "count", -28, -1)})
    w, price = PRODUCT.per_key(), F.col("sell_price_main")
    spread = F.stddev_samp(price).over(w)
    return out.withColumn("_scaled", F.when(spread == 0, 0.0).otherwise((price - F.avg(price).over(w)) / spread))


def target_features(df: DataFrame, alpha: float = 0.005, last: Column | None = None) -> DataFrame:
    """``last_sales_ema005``, ``CN_sales_sum``, ``last_sales_zs`` per product and day.

    The grid runs from each product's first day to the last day of all. The mean
    ends one day back, so a row never sees its own sales.
    """
    slim = df.select("unique_id", "date", "warehouse", "common_name", "sales")
    grid = extend_to_last_date(slim, PRODUCT, last, add_indicator=True)
    so_far = PRODUCT.in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = grid.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("warehouse", "common_name")})
    grid = long_ema(grid, PRODUCT, "sales", alpha, "last_sales_ema005", lag=1, null_as=0.0)
    # One aggregation per family and day gives the daily sum and the parts of the
    # family moments, so the long grid is reduced once.
    group = ["common_name", "warehouse"]
    y = F.col("sales")
    daily = grid.groupBy(*group, "date").agg(
        F.sum("last_sales_ema005").alias("CN_sales_sum"), F.count(y).alias("_n"), F.avg(y).alias("_m"), F.var_pop(y).alias("_v"),
        F.min(y).alias("_lo"), F.max(y).alias("_hi"),
    )
    w = Window.partitionBy(*group)
    n = F.sum("_n").over(w)
    daily = daily.withColumn("_mu", F.try_divide(F.sum(F.col("_n") * F.col("_m")).over(w), n))
    # Squares around the family mean: stable, and exactly zero where all values are equal.
    around = F.sum(F.col("_n") * (F.col("_v") + F.pow(F.col("_m") - F.col("_mu"), F.lit(2)))).over(w)
    flat = F.min("_lo").over(w) == F.max("_hi").over(w)
    daily = daily.withColumn("_sd", F.when(flat & (n > 1), 0.0).otherwise(F.sqrt(F.try_divide(around, n - 1))))
    own = grid.filter(y.isNotNull() | ~F.col("_was_imputed")).drop("_was_imputed")
    out = join_on_keys(own, daily.drop("_n", "_m", "_v", "_lo", "_hi"), [*group, "date"])
    z = F.try_divide(F.col("last_sales_ema005") - F.col("_mu"), F.col("_sd"))
    return out.withColumn("last_sales_zs", z).select("unique_id", "date", "last_sales_ema005", "CN_sales_sum", "last_sales_zs")


def feature_table(train: DataFrame, inventory: DataFrame, calendar: DataFrame, test: DataFrame | None = None, first_date: str | None = None) -> DataFrame:
    """All features of the training rows (target present) and the test rows.

    Every group statistic reads the few columns it needs from the joined rows,
    before the wide feature columns exist. None but the last group reads the target.
    """
    rows = train.filter(F.col("sales").isNotNull())
    if test is not None:
        rows = rows.unionByName(test, allowMissingColumns=True)
    base = row_features(rows.join(inventory, "unique_id").join(holiday_proximity(calendar), ["date", "warehouse"]))
    out = remove_group_mean(product_features(base), ["date", "warehouse"], "_scaled", "price_detrended").drop("_scaled")
    out = join_on_keys(out, family_features(base), ["date", "warehouse", "common_name"])
    out = join_on_keys(out, name_features(base), ["date", "name"])
    out = join_on_keys(out, warehouse_index(rows), ["date", "warehouse"])
    out = join_on_keys(out, target_features(base), ["unique_id", "date"])
    return out if first_date is None else out.filter(F.col("date") >= F.lit(first_date).cast("date"))


def with_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight of each row's product; products without one keep null."""
    return df.join(weights.select("unique_id", "weight"), "unique_id", "left")
