"""Feature tables, retail features, chart tables and learned models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seriesloom.operators import chartdata, demand, explain, learners, splits, tsstats, tuning
from seriesloom.operators.additive import AdditiveModel
from seriesloom.operators.features import FeatureBuilder
from seriesloom.operators.forecast import floor_zero
from seriesloom.operators.grid import future_dates
from seriesloom.plans import bakeoff, cleaning, retail, subset, univariate
from seriesloom.session import dealt, reliable_checkpoint
from seriesloom.spec import PanelSpec
from workload import panels as P
from workload.forecasting import _decomposition
from workload.registry import n, query, r, s, shown, table

SUP = P.with_grid(P.SUPPLIER_WEEK)
HL4 = 1.0 - math.exp(-math.log(2.0) / 4.0)
BUILDER = FeatureBuilder(P.WEEKLY, lags=(1, 2, 4, 13), rolling_windows=(4, 13), rolling_stats=("mean", "std"), ewm_halflives=(4.0,))
TREE = {"objective": "regression", "max_iter": 5, "max_depth": 3, "learning_rate": 0.2, "max_bins": 32}
LINEAR = {"objective": "tweedie", "variance_power": 1.2}


@query(
    "feature_table",
    f"""{SUP}, o AS (SELECT k, d, y, row_number() OVER (PARTITION BY k ORDER BY d) AS i, lag(y) OVER (PARTITION BY k ORDER BY d) AS prev FROM filled),
 e AS (SELECT k, i, prev, CAST(NULL AS DOUBLE) AS m FROM o WHERE i = 1
  UNION ALL SELECT o.k, o.i, o.prev, CASE WHEN e.m IS NULL THEN o.prev ELSE (1 - {HL4!r}) * e.m + {HL4!r} * o.prev END FROM e JOIN o ON o.k = e.k AND o.i = e.i + 1)
SELECT o.k, {s("o.d")} AS d, {r("o.y")} AS y, {n("weekofyear(o.d)")} AS week, {r("sin(2 * pi() * dayofyear(o.d) / 365.25)")} AS doy_sin,
 {r("lag(o.y, 13) OVER w")} AS y_lag_13, {r("avg(o.y) OVER (PARTITION BY o.k ORDER BY o.d ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)")} AS y_roll_mean_13,
 {r("stddev_samp(o.y) OVER (PARTITION BY o.k ORDER BY o.d ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")} AS y_roll_std_4, {r("e.m")} AS y_ewm_hl4,
 dense_rank() OVER (ORDER BY CAST(o.k AS VARCHAR)) - 1 AS k_code
FROM o JOIN e ON e.k = o.k AND e.i = o.i WINDOW w AS (PARTITION BY o.k ORDER BY o.d)""",
)
def feature_table(spark, folder):
    from dataclasses import replace

    out = replace(BUILDER, encode_keys=True).transform(P.supplier_week_full(spark, folder))
    return shown(out.select("k", "d", "y", "week", "doy_sin", "y_lag_13", "y_roll_mean_13", "y_roll_std_4", "y_ewm_hl4", "k_code"))


@query(
    "cleaned_panel",
    f"""{P.with_grid(P.USER_TYPE_DAY, "1 DAY", "k, t", None)}, x AS (SELECT *, row_number() OVER w AS a FROM filled WINDOW w AS (PARTITION BY k, t ORDER BY d)),
 b AS (SELECT *, last_value(y IGNORE NULLS) OVER p AS y0, first_value(y IGNORE NULLS) OVER f AS y1,
  max(CASE WHEN y IS NOT NULL THEN a END) OVER p AS a0, min(CASE WHEN y IS NOT NULL THEN a END) OVER f AS a1 FROM x
  WINDOW p AS (PARTITION BY k, t ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY k, t ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 z AS MATERIALIZED (SELECT k, t, d, inserted, coalesce(y, y0 + (y1 - y0) * (a - a0) / CAST(nullif(a1 - a0, 0) AS DOUBLE), y0, y1) AS y FROM b)
SELECT k, t, {s("d")} AS d, {n("inserted")} AS "_was_imputed",
 {r("least(greatest(y, quantile_cont(y, 0.01) OVER (PARTITION BY k, t)), quantile_cont(y, 0.99) OVER (PARTITION BY k, t))")} AS y FROM z""",
)
def cleaned_panel(spark, folder):
    out = cleaning.clean_panel(P.user_type_day(spark, folder).drop("x"), P.DAILY_BY_TYPE)
    return shown(out)


# --- retail star -----------------------------------------------------------------------


def _star(spark, folder):
    """Sales, inventory and calendar in the retail layout, from the given tables.

    Product = part name in a region, warehouse = region, holidays = turn of the
    year, 1 May and 24 to 26 December.
    """
    region = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("warehouse"))
    )
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_shipdate").cast("date").alias("date"))
    rows = lines.join(part, "l_partkey").join(region, "l_suppkey").withColumn("unique_id", F.concat_ws("@", "name", "warehouse"))
    sales = rows.groupBy("unique_id", "date", "warehouse").agg(
        F.sum("l_quantity").alias("sales"),
        F.round(F.sum("l_extendedprice"), 2).alias("_v"),
        F.max(F.col("l_discount") - 0.02).alias("type_0_discount"),
        F.max(F.col("l_tax") - 0.03).alias("type_1_discount"),
    )
    sales = sales.withColumn("sell_price_main", F.col("_v") / F.col("sales")).drop("_v")
    orders = rows.groupBy("date", "warehouse").agg(F.countDistinct("l_orderkey").cast("double").alias("total_orders"))
    inventory = rows.select("unique_id", "name").distinct()
    days = rows.select("date", "warehouse").distinct()
    md = F.date_format("date", "MM-dd")
    name = F.when(md.isin("12-24", "12-25", "12-26"), "christmas").when(md == "01-01", "new year").when(md == "05-01", "spring")
    calendar = days.withColumn("holiday_name", name).withColumn("holiday", (name.isNotNull() | (md == "07-04")).cast("int"))
    return sales.join(orders, ["date", "warehouse"]), inventory, calendar


_STAR = f"""WITH rows_ AS (SELECT replace(p_name, ' ', '_') AS name, r_name AS warehouse, CAST(l_shipdate AS DATE) AS date, l.* FROM lineitem l JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
 o AS (SELECT date, warehouse, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS total_orders FROM rows_ GROUP BY 1, 2),
 sales AS (SELECT name || '@' || warehouse AS unique_id, name, split_part(name, '_', 1) AS common_name, date, warehouse, sum(l_quantity) AS sales, round(sum(l_extendedprice), 2) / sum(l_quantity) AS price,
  greatest(max(l_discount - 0.02), 0) AS d0, greatest(max(l_tax - 0.03), 0) AS d1 FROM rows_ GROUP BY 1, 2, 3, 4, 5),
 star AS MATERIALIZED (SELECT s.*, greatest(d0, d1) AS max_discount, ln(price) AS lp, total_orders FROM sales s JOIN o USING (date, warehouse)),
 cal AS (SELECT DISTINCT date, warehouse, strftime(date, '%m-%d') IN ('12-24', '12-25', '12-26', '01-01', '05-01') AS hol FROM rows_),
 prox AS MATERIALIZED (SELECT *, date - max(CASE WHEN hol THEN date END) OVER (PARTITION BY warehouse ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since,
  min(CASE WHEN hol THEN date END) OVER (PARTITION BY warehouse ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - date AS until FROM cal)"""


@query(
    "holiday_proximity",
    f"""{_STAR} SELECT {s("date")} AS date, warehouse, {n("hol")} AS holiday, {n("since")} AS days_since_last_holiday, {n("until")} AS days_to_next_holiday,
 {n("coalesce(until = 1, false)")} AS day_before_holiday, {n("coalesce(since = 1, false)")} AS day_after_holiday FROM prox""",
)
def holiday_proximity(spark, folder):
    _, _, calendar = _star(spark, folder)
    return shown(retail.holiday_proximity(calendar, keep_distances=True).drop("holiday_name"))


@query(
    "retail_features",
    f"""{_STAR},
 fam AS MATERIALIZED (SELECT date, warehouse, common_name, count(DISTINCT unique_id) AS cn, avg(max_discount) AS ca FROM star GROUP BY 1, 2, 3),
 nm AS MATERIALIZED (SELECT date, name, count(DISTINCT unique_id) AS nw FROM star GROUP BY 1, 2),
 z AS (SELECT *, CASE WHEN stddev_samp(lp) OVER u = 0 THEN 0 ELSE (lp - avg(lp) OVER u) / stddev_samp(lp) OVER u END AS zs,
   count(*) OVER (PARTITION BY unique_id ORDER BY date RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS n28 FROM star WINDOW u AS (PARTITION BY unique_id)),
 w0 AS (SELECT date, warehouse, quantile_cont(total_orders, 0.5) AS m FROM star GROUP BY 1, 2),
 w1 AS (SELECT *, avg(m) OVER (PARTITION BY warehouse ORDER BY date RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW) AS m14, row_number() OVER (PARTITION BY warehouse ORDER BY date) AS i FROM w0),
 w2 AS MATERIALIZED (SELECT date, warehouse, m14, sum(m * pow(1 - 1.0 / 56, -i)) OVER v / sum(pow(1 - 1.0 / 56, -i)) OVER v AS ew FROM w1 WINDOW v AS (PARTITION BY warehouse ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT z.unique_id, {s("z.date")} AS date, z.common_name || '_' || z.warehouse AS "CN_WH", {r("z.max_discount")} AS max_discount, fam.cn AS "CN_total_products", {r("fam.ca")} AS "CN_discount_avg",
 nm.nw AS name_num_warehouses, z.n28 AS "num_sales_days_28D", {r("zs - avg(zs) OVER (PARTITION BY z.date, z.warehouse)", 5)} AS price_detrended, {r("w2.m14", 5)} AS mean_orders_14d, {r("w2.ew", 5)} AS ewmean_orders_56,
 {n("coalesce(until = 1, false)")} AS day_before_holiday
FROM z JOIN fam ON fam.date = z.date AND fam.warehouse = z.warehouse AND fam.common_name = z.common_name JOIN nm ON nm.date = z.date AND nm.name = z.name
 JOIN w2 ON w2.date = z.date AND w2.warehouse = z.warehouse JOIN prox ON prox.date = z.date AND prox.warehouse = z.warehouse""",
)
def retail_features(spark, folder):
    sales, inventory, calendar = _star(spark, folder)
    # The feature plan reads the sales several times; a user would have them as a stored table.
    out = retail.feature_table(reliable_checkpoint(sales), reliable_checkpoint(inventory), reliable_checkpoint(calendar))
    exact = ["unique_id", "date", "CN_WH", "CN_total_products", "name_num_warehouses", "num_sales_days_28D", "day_before_holiday"]
    six = ["max_discount", "CN_discount_avg"]
    five = ["price_detrended", "mean_orders_14d", "ewmean_orders_56"]
    left = shown(out.select(*exact, *six, *[F.round(F.col(c) + 2e-8, 5).alias(c) for c in five]))
    return left


@query(
    "retail_target_features",
    f"""{_STAR},
 g AS (SELECT unique_id, common_name, warehouse, CAST(unnest(generate_series(lo, (SELECT max(date) FROM star), INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT unique_id, common_name, warehouse, min(date) AS lo FROM star GROUP BY 1, 2, 3)),
 gs AS MATERIALIZED (SELECT g.*, star.sales, row_number() OVER (PARTITION BY g.unique_id ORDER BY g.date) AS i FROM g LEFT JOIN star ON star.unique_id = g.unique_id AND star.date = g.date),
 em AS MATERIALIZED (SELECT *, coalesce(sum(sales * pow(0.995, -i)) OVER v / sum(CASE WHEN sales IS NOT NULL THEN pow(0.995, -i) END) OVER v, 0) AS ema FROM gs
   WINDOW v AS (PARTITION BY unique_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 cs AS MATERIALIZED (SELECT common_name, warehouse, date, sum(ema) AS cn_sum FROM em GROUP BY 1, 2, 3),
 st AS MATERIALIZED (SELECT common_name, warehouse, avg(sales) AS mu, stddev_samp(sales) AS sd FROM em GROUP BY 1, 2)
SELECT em.unique_id, {s("em.date")} AS date, {r("em.ema", 5)} AS last_sales_ema005, {r("cs.cn_sum", 5)} AS "CN_sales_sum", {r("(em.ema - mu) / sd", 5)} AS last_sales_zs
FROM em JOIN cs USING (common_name, warehouse, date) JOIN st USING (common_name, warehouse) WHERE em.sales IS NOT NULL""",
)
def retail_target_features(spark, folder):
    sales, inventory, calendar = _star(spark, folder)
    base = retail.row_features(reliable_checkpoint(sales).join(reliable_checkpoint(inventory), "unique_id"))
    return shown(retail.target_features(base), 5)


@query(
    "weighted_error",
    f"""WITH w AS (SELECT p_brand AS k, avg(p_retailprice) AS weight FROM part GROUP BY 1), panel AS ({P.BRAND_DAY}),
 j AS (SELECT y, avg(y) OVER (PARTITION BY k) AS f, weight FROM panel LEFT JOIN w USING (k))
SELECT {r("sum(weight * abs(y - f)) / sum(weight)")} AS wmae FROM j""",
)
def weighted_error(spark, folder):
    from seriesloom.functions import metrics as M

    weights = table(spark, folder, "part").groupBy(F.col("p_brand").alias("unique_id")).agg(F.avg("p_retailprice").alias("weight"))
    panel = P.brand_day(spark, folder).withColumnRenamed("k", "unique_id")
    means = panel.groupBy("unique_id").agg(F.avg("y").alias("f"))
    rows = retail.with_weights(panel.join(means, "unique_id"), weights)
    return shown(rows.agg(M.weighted_mae(F.col("y"), F.col("f"), F.col("weight")).alias("wmae")))


# --- chart tables ----------------------------------------------------------------------


@query(
    "histogram_bins",
    f"""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT {n("least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29)")} AS bin, count(*) AS n FROM lineitem, b GROUP BY 1""",
)
def histogram_bins(spark, folder):
    return shown(chartdata.histogram(table(spark, folder, "lineitem"), "l_extendedprice").select("bin", "n"))


@query(
    "box_plot_numbers",
    f"""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT {r("q1")} AS q1, {r("median")} AS median, {r("q3")} AS q3, {r("min(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))")} AS whisker_low,
 {r("max(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))")} AS whisker_high,
 count(*) FILTER (o_totalprice NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outside FROM orders, q GROUP BY q1, median, q3""",
)
def box_plot_numbers(spark, folder):
    return shown(chartdata.box_numbers(table(spark, folder, "orders"), "o_totalprice"))


@query(
    "missing_grid",
    f"""{P.with_grid(P.USER_TYPE_DAY, "1 DAY", "k, t", None)}, o AS (SELECT *, row_number() OVER (ORDER BY k, t, d) - 1 AS p, count(*) OVER () AS n FROM filled),
 picks AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 499) AS BIGINT) AS p FROM range(500) t(i), (SELECT max(n) AS n FROM o))
SELECT k, t, {s("d")} AS d, {n("y IS NULL")} AS y_missing, {n("x IS NULL")} AS x_missing FROM o WHERE p IN (SELECT p FROM picks)""",
)
def missing_grid(spark, folder):
    return shown(chartdata.missing_grid(P.user_type_day_filled(spark, folder), ["k", "t", "d"], ["y", "x"], 500))


_MONTH_CELLS = ", ".join(f'{r(f"avg(l_quantity) FILTER (month(l_shipdate) = {m})")} AS "{m}"' for m in range(1, 13))


@query("calendar_heatmap", f"SELECT {n('year(l_shipdate)')} AS year, {_MONTH_CELLS} FROM lineitem GROUP BY 1")
def calendar_heatmap(spark, folder):
    return shown(chartdata.calendar_heatmap(table(spark, folder, "lineitem"), "l_shipdate", "l_quantity"))


@query(
    "seasonal_cycles",
    f"""{P.with_grid(P.BRAND_MONTH, "1 MONTH")}, p AS (SELECT k, y, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS i FROM filled)
SELECT k, {n("i % 12")} AS position, """
    + ", ".join(f'{r(f"max(y) FILTER (i // 12 = {c})")} AS "{c}"' for c in range(7))
    + " FROM p GROUP BY 1, 2",
)
def seasonal_cycles(spark, folder):
    return shown(chartdata.seasonal_cycle_table(P.brand_month_full(spark, folder), P.MONTHLY, 12, range(7)))


@query(
    "class_scatter",
    f"""{P.with_grid(P.CUSTOMER_WEEK)}, st AS (SELECT k, count(*) / nullif(CAST(count(*) FILTER (y <> 0) AS DOUBLE), 0) AS adi, pow(stddev_samp(y) FILTER (y <> 0) / avg(y) FILTER (y <> 0), 2) AS cv2 FROM filled GROUP BY k)
SELECT k, {r("adi")} AS adi, {r("cv2")} AS cv2, CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic' WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS sb_class, {s("k")} AS label
FROM st WHERE adi IS NOT NULL AND cv2 IS NOT NULL""",
)
def class_scatter(spark, folder):
    full = P.complete_panel(P.customer_week(spark, folder), P.WEEKLY)
    return shown(chartdata.class_scatter(demand.classify_all_series(full, P.WEEKLY), ["k"]))


@query(
    "split_sample",
    f"""{SUP}, e AS (SELECT max(d) AS hi FROM filled)
SELECT k, {s("d")} AS d, {r("y")} AS y, CASE WHEN d <= hi - 182 THEN 'train' WHEN d <= hi - 91 THEN 'val' ELSE 'test' END AS split FROM filled, e WHERE k IN (SELECT DISTINCT k FROM panel ORDER BY k LIMIT 4)""",
)
def split_sample(spark, folder):
    split = splits.holdout_horizon_split(P.supplier_week_full(spark, folder), P.WEEKLY, 13, 13)
    return shown(chartdata.split_sample(split, 4))


@query(
    "fold_spans",
    f"""WITH b AS (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem), f AS (SELECT i, lo, hi FROM b, range(3) t(i))
SELECT {n("i")} AS fold, 'train' AS part, {s("lo")} AS start, {s("hi - CAST((3 - i) * 30 AS INTEGER)")} AS "end" FROM f
UNION ALL SELECT i, 'valid', {s("hi - CAST((3 - i) * 30 - 1 AS INTEGER)")}, {s("hi - CAST((2 - i) * 30 AS INTEGER)")} FROM f""",
)
def fold_spans(spark, folder):
    panel = P.brand_day(spark, folder)
    return shown(chartdata.fold_spans(panel, splits.expanding_day_folds(panel, P.DAILY, 3, 30)))


@query(
    "outlier_points",
    f"""WITH panel AS ({P.BRAND_DAY}), q AS (SELECT *, quantile_cont(y, 0.25) OVER w AS q1, quantile_cont(y, 0.75) OVER w AS q3 FROM panel WINDOW w AS (PARTITION BY k))
SELECT k, {s("d")} AS d, {r("y")} AS y FROM q WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)""",
)
def outlier_points(spark, folder):
    return shown(chartdata.outlier_points(P.brand_day(spark, folder), P.DAILY))


def _horner(coef, x: str, tail: float | None = None) -> str:
    out = repr(coef[0])
    for c in coef[1:]:
        out = f"({out} * {x} + {c!r})"
    return out if tail is None else f"({out} * {x} + {tail!r})"


_CENTRE = f"{_horner(chartdata._A, 'sq')} * mid / {_horner(chartdata._B, 'sq', 1.0)}"
_EDGE = f"{_horner(chartdata._C, 'e')} / {_horner(chartdata._D, 'e', 1.0)}"


@query(
    "residual_quantile_points",
    f"""{_decomposition(True, "-")}, o AS (SELECT k, resid, row_number() OVER (PARTITION BY k ORDER BY resid) AS i, count(*) OVER (PARTITION BY k) AS n FROM dec WHERE resid IS NOT NULL),
 pl AS (SELECT *, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END AS p FROM o),
 z AS (SELECT *, p - 0.5 AS mid, (p - 0.5) * (p - 0.5) AS sq, sqrt(-2 * ln(least(p, 1 - p))) AS e FROM pl)
SELECT k, {r("resid", 4)} AS sample, {r(f"CASE WHEN p < {chartdata._SPLIT!r} THEN {_EDGE} WHEN p > 1 - {chartdata._SPLIT!r} THEN -({_EDGE}) ELSE {_CENTRE} END", 4)} AS theoretical FROM z""",
)
def residual_quantile_points(spark, folder):
    dec = tsstats.seasonal_decompose(P.brand_month_full(spark, folder), P.MONTHLY, 12)
    return shown(chartdata.residual_diagnostics(dec, P.MONTHLY, "resid")["qq"], 4)


@query(
    "nonzero_shares",
    f"""{P.with_grid(P.PART_WEEK)}, c AS (SELECT k, count(*) FILTER (y > 0) AS nonzero, count(*) AS periods FROM filled GROUP BY k)
SELECT k, nonzero, periods, nonzero || '/' || periods || ' non-zero periods (' || CAST(round_even(nonzero * 100.0 / periods, 0) AS INTEGER) || '%)' AS annotation FROM c""",
)
def nonzero_shares(spark, folder):
    return shown(chartdata.nonzero_share(P.complete_panel(P.part_week(spark, folder), P.WEEKLY), P.WEEKLY))


@query(
    "top_bars",
    f"""WITH panel AS ({P.PART_WEEK}) SELECT k, {r("sum(y)")} AS total FROM panel GROUP BY k ORDER BY sum(y) DESC, k LIMIT 15""",
)
def top_bars(spark, folder):
    totals = P.part_week(spark, folder).groupBy("k").agg(F.sum("y").alias("total"))
    return shown(chartdata.top_bars(totals, "total", "k", 15))


# --- workflows -------------------------------------------------------------------------


@query("univariate_workflow")
def univariate_workflow(spark, folder):
    models = ["naive", "seasonal_naive", "mean", "drift", "croston_sba", "tsb", "holt_damped", "holt_winters"]
    return shown(univariate.run_workflow(P.brand_month_full(spark, folder), P.MONTHLY, 12, 12, models).forecast.select("k", "d", "horizon", "model", "yhat"))


@query(
    "sampled_panel",
    f"""WITH panel AS (SELECT * FROM ({P.PART_WEEK}) WHERE d <= DATE '2000-06-30'), c AS (SELECT DISTINCT k, md5(concat_ws('|', k, 42)) AS h FROM panel ORDER BY h, k LIMIT 500)
SELECT k, {s("d")} AS d, {r("y")} AS y FROM panel WHERE k IN (SELECT k FROM c)""",
)
def sampled_panel(spark, folder):
    return shown(subset.sample_panel(P.part_week(spark, folder), P.WEEKLY, 500, ["k", "d", "y"], "2000-06-30"))


def _stored_panel(spark, folder):
    """Model fits pass over the panel many times, so it is written out once; features grow on parts of counted rows."""
    return dealt(reliable_checkpoint(P.supplier_week_full(spark, folder)), "k")


# Last 8 weeks: test; the 13 before: validation. Forecasts start at each key's last known week.
def _split(spark, folder):
    return splits.holdout_horizon_split(_stored_panel(spark, folder), P.WEEKLY, 8, 13)


@query("recursive_forecast")
def recursive_forecast(spark, folder):
    split = _split(spark, folder)
    known = split.frame.filter("split <> 'test'").drop("split")
    model = learners.RecursiveForecaster(BUILDER, TREE).fit(split.train, split.val)
    return shown(model.predict_recursive(known, 8).select("k", "d", "horizon", "yhat"))


@query("tweedie_forecast")
def tweedie_forecast(spark, folder):
    split = _split(spark, folder)
    known = split.frame.filter("split <> 'test'").drop("split")
    out = learners.RecursiveForecaster(BUILDER, LINEAR).fit(split.train).predict_recursive(known, 8)
    return shown(out.select("k", "d", "horizon", floor_zero(F.col("yhat")).alias("yhat")))


@query("direct_forecast")
def direct_forecast(spark, folder):
    split = _split(spark, folder)
    known = split.frame.filter("split <> 'test'").drop("split")
    model = learners.DirectMultiHorizonForecaster(BUILDER, range(1, 9), TREE).fit(split.train, split.val)
    return shown(model.predict(known, split.val_end).select("k", "d", "horizon", "yhat"))


@query("causal_forecast")
def causal_forecast(spark, folder):
    from dataclasses import replace

    split = _split(spark, folder)
    known = split.frame.filter("split <> 'test'").drop("split")
    # An exogenous column that is not known ahead is dropped by the causal rule.
    busy = lambda df: df.withColumn("busy", (F.col("y") > 100).cast("double"))
    builder = replace(BUILDER, exogenous=("busy",))
    model = learners.PurelyCausalForecaster(builder, range(1, 9), TREE).fit(busy(split.train), busy(split.val))
    return shown(model.predict(busy(known), split.val_end).select("k", "d", "horizon", "yhat"))


@query("quantile_forecast")
def quantile_forecast(spark, folder):
    split = _split(spark, folder)
    known = split.frame.filter("split <> 'test'").drop("split")
    model = learners.QuantileForecaster(BUILDER, (0.1, 0.5, 0.9), TREE).fit_ahead(split.train, split.val, 8)
    return shown(chartdata.quantile_bands(model.predict_ahead(known, 8), ["k", "d", "horizon", "q0_50"], ["q0_10", "q0_50", "q0_90"]))


@query("out_of_fold_predictions")
def out_of_fold_predictions(spark, folder):
    rows = BUILDER.transform(_stored_panel(spark, folder))
    oof, _ = learners.cross_validated_predictions(rows, BUILDER, "y", ["k", "d"], 3, TREE)
    return shown(oof.select("k", "d", "y", "fold", "yhat"))


def _additive(panel: str, changes: int, waves: str, extra: str, future: str = "") -> str:
    """SQL of the additive regression: rows with their regressors, normal equations with the ridge, one sweep per regressor."""
    terms = f"""[1.0, t] || list_transform(range(1, {changes + 1}), lambda i: greatest(t - 0.8 * i / {changes}, 0.0)) || {waves}{extra}"""
    sweep = """list_transform(range(0, m * m), lambda x: CASE WHEN x // m = p AND x % m = p THEN 1 / g[p * m + p + 1] WHEN x // m = p THEN g[x + 1] / g[p * m + p + 1]
  WHEN x % m = p THEN -g[x + 1] / g[p * m + p + 1] ELSE g[x + 1] - g[x // m * m + p + 1] * g[p * m + x % m + 1] / g[p * m + p + 1] END)"""
    return f"""{panel}, ends AS (SELECT k, min(epoch(d) / 86400.0) AS lo, max(epoch(d) / 86400.0) AS hi FROM known GROUP BY k),
 dated AS (SELECT k, d, y, epoch(d) / 86400.0 AS day FROM known{future}),
 placed AS (SELECT z.*, (day - lo) / greatest(hi - lo, 1.0) AS t FROM dated z JOIN ends ON ends.k = z.k),
 rows_ AS (SELECT *, {terms} AS x FROM placed),
 fit AS (SELECT k, d, x || [CAST(y AS DOUBLE)] AS v FROM rows_ WHERE y IS NOT NULL),
 long AS (SELECT k, d, len(v) AS m, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM fit),
 gram AS (SELECT a.k, a.m, a.i, b.i AS j, sum(a.x * b.x) + CASE WHEN a.i = b.i AND a.i < a.m THEN CASE WHEN a.i <= 2 THEN 1e-8 ELSE 0.01 END ELSE 0 END AS s FROM long a JOIN long b ON a.k = b.k AND a.d = b.d GROUP BY a.k, a.m, a.i, b.i),
 swept AS (SELECT k, m, CAST(0 AS BIGINT) AS p, list(s ORDER BY i, j) AS g FROM gram GROUP BY k, m UNION ALL SELECT k, m, p + 1, {sweep} FROM swept WHERE p < m - 1),
 beta AS (SELECT k, list_transform(range(0, m - 1), lambda i: g[i * m + m]) AS b FROM swept WHERE p = m - 1)"""


_WAVE = "list_transform(range(0, {n}), lambda i: CASE WHEN i % 2 = 0 THEN sin(2 * pi() * day / {period} * (i // 2 + 1)) ELSE cos(2 * pi() * day / {period} * (i // 2 + 1)) END)"
_YEARLY = _WAVE.format(n=6, period=365.25)
_MONTHLY_ADDITIVE = _additive(P.with_grid(P.BRAND_MONTH, "1 MONTH") + ", known AS (SELECT k, d, y FROM filled)", 10, _YEARLY, "")
_HOLIDAY = "[CASE WHEN strftime(d, '%m-%d') IN ('12-24', '12-25', '12-26', '01-01') THEN 1.0 ELSE 0.0 END]"


@query(
    "additive_forecast",
    _additive(
        f"WITH RECURSIVE known AS ({P.BRAND_DAY})", 10, f"{_WAVE.format(n=12, period=365.25)} || {_WAVE.format(n=6, period=7.0)}", f" || {_HOLIDAY}",
        " UNION ALL SELECT k, CAST(hi AS DATE), NULL, epoch(CAST(hi AS DATE)) / 86400.0 FROM (SELECT k, max(d) + CAST(unnest(range(1, 29)) AS INTEGER) AS hi FROM known GROUP BY k)",
    )
    + f""", made AS (SELECT z.k, d, y, list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * b[i])) AS f FROM rows_ z JOIN beta ON beta.k = z.k),
 off AS (SELECT k, quantile_cont(y - f, 0.1) AS lo, quantile_cont(y - f, 0.9) AS hi FROM made WHERE y IS NOT NULL GROUP BY k)
SELECT made.k, {s("d")} AS d, {r("greatest(f, 0)", 3)} AS yhat, {r("greatest(f + lo, 0)", 3)} AS yhat_lower, {r("greatest(f + hi, 0)", 3)} AS yhat_upper FROM made JOIN off ON off.k = made.k WHERE y IS NULL""",
)
def additive_forecast(spark, folder):
    daily = P.brand_day(spark, folder)
    flag = F.date_format("d", "MM-dd").isin("12-24", "12-25", "12-26", "01-01").cast("double")
    model = AdditiveModel(P.DAILY, holidays=("holiday",))
    future = future_dates(daily, P.DAILY, 28).withColumn("holiday", flag)
    return shown(model.predict(daily.withColumn("holiday", flag), future), 3)


@query(
    "additive_components",
    f"""{_MONTHLY_ADDITIVE} SELECT z.k, {s("d")} AS d, {r("y")} AS observed, {r("list_sum(list_transform(range(1, 13), lambda i: x[i] * b[i]))", 3)} AS trend,
 {r("list_sum(list_transform(range(13, 19), lambda i: x[i] * b[i]))", 3)} AS yearly, {r("greatest(list_sum(list_transform(range(1, 19), lambda i: x[i] * b[i])), 0)", 3)} AS yhat FROM rows_ z JOIN beta ON beta.k = z.k""",
)
def additive_components(spark, folder):
    monthly = P.brand_month_full(spark, folder)
    parts = AdditiveModel(P.MONTHLY, yearly_order=3).components(monthly)
    drawn = chartdata.components_with_actual(parts, monthly, P.MONTHLY)
    return shown(drawn.select("k", "d", "observed", "trend", "yearly", "yhat"), 3)


@query(
    "additive_coefficients",
    f"""{_MONTHLY_ADDITIVE} SELECT k, CASE WHEN i <= 12 THEN 'trend' ELSE 'yearly' END AS component, {n("CASE WHEN i <= 12 THEN i - 1 ELSE i - 13 END")} AS term, {r("v", 2)} AS value
FROM (SELECT k, unnest(b) AS v, generate_subscripts(b, 1) AS i FROM beta)""",
)
def additive_coefficients(spark, folder):
    return shown(AdditiveModel(P.MONTHLY, yearly_order=3).coefficients(P.brand_month_full(spark, folder)), 2)


@query("grid_search_scores")
def grid_search_scores(spark, folder):
    panel = _stored_panel(spark, folder)
    folds = splits.expanding_day_folds(panel, PanelSpec("d", "y", ("k",), frequency="D"), 4, 91)
    grid = {"max_depth": [2, 4], "learning_rate": [0.1, 0.3]}
    return shown(tuning.grid_search(panel, BUILDER, folds, {**TREE, "max_iter": 4}, grid))


@query("random_search_history")
def random_search_history(spark, folder):
    panel = _stored_panel(spark, folder)
    folds = splits.expanding_day_folds(panel, PanelSpec("d", "y", ("k",), frequency="D"), 4, 91)
    space = {"variance_power": {"type": "float", "low": 1.1, "high": 1.8}, "l2": {"type": "log_float", "low": 1e-3, "high": 1.0}}
    trials = tuning.sample_space(spark, space, 6)
    return shown(tuning.trial_history(tuning.search(panel, BUILDER, folds, LINEAR, trials), list(space)))


def _fitted(spark, folder, params):
    split = _split(spark, folder)
    rows = BUILDER.transform(split.frame)
    return learners.PanelRegressor(BUILDER, params).fit(rows.filter("split = 'train'"), "y"), rows.filter("split = 'test'")


@query("gain_and_split_importance")
def gain_and_split_importance(spark, folder):
    model, rows = _fitted(spark, folder, TREE)
    gain = explain.importance(rows, model, "gain").withColumn("kind", F.lit("gain"))
    return shown(gain.unionByName(explain.importance(rows, model, "split").withColumn("kind", F.lit("split"))))


@query("permutation_importance")
def permutation_importance(spark, folder):
    model, rows = _fitted(spark, folder, TREE)
    return shown(explain.permutation_importance(rows, model, ["k", "d"]).select("feature", "base", "shuffled", "increase"))


def _contributions(spark, folder):
    model, rows = _fitted(spark, folder, LINEAR)
    return explain.linear_contributions(rows, model, ["k", "d"])


@query("linear_attributions")
def linear_attributions(spark, folder):
    return shown(_contributions(spark, folder))


@query("local_attributions")
def local_attributions(spark, folder):
    last = splits.date_span(P.supplier_week(spark, folder), P.WEEKLY)[1]
    return shown(explain.local_attribution(_contributions(spark, folder), F.col("d") == F.lit(last)))


@query("attribution_totals")
def attribution_totals(spark, folder):
    return shown(explain.attribution_summary(_contributions(spark, folder)))


@query("dependence_on_week")
def dependence_on_week(spark, folder):
    return shown(explain.dependence(_contributions(spark, folder), "week"))


@query("bake_off_ranking")
def bake_off_ranking(spark, folder):
    panel = _stored_panel(spark, folder)
    return shown(bakeoff.run_bakeoff(panel, P.WEEKLY, BUILDER, 2, 52, {**TREE, "max_iter": 4}).ranking)
