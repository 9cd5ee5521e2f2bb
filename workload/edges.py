"""Series that are short, gappy or end early, values beyond a grid, and helpers of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import chartdata, demand, encode, recurrence, transforms, tsstats, tuning
from seriesloom.operators import forecast as FC
from seriesloom.operators.grid import complete_panel, dealt_by_periods, fill_time_gaps, to_panel
from seriesloom.spec import PanelSpec
from workload import panels as P
from workload.registry import n, query, r, s, shown, table

SUP = P.with_grid(P.SUPPLIER_WEEK)
KT = P.DAILY_BY_TYPE


@query(
    "short_series_reasons",
    f"""WITH panel AS ({P.USER_TYPE_DAY}), c AS (SELECT k, t, count(*) AS n, count(DISTINCT y) AS m FROM panel GROUP BY 1, 2)
SELECT k, t, CASE WHEN n < 2 THEN 1 ELSE least(3, n - 1) + 1 END AS acf_lags, {n("n < 2 OR m = 1")} AS no_acf,
 CASE WHEN n < 3 THEN 'fewer than 3 observations' WHEN m = 1 THEN 'constant series' END AS kpss_error,
 n AS decomposed_rows, CASE WHEN n < 8 THEN 'fewer than two periods of values' END AS decomposition_error, {n("n < 8")} AS no_seasonal_forecast, {n("n < 2")} AS no_trend_forecast FROM c""",
)
def short_series_reasons(spark, folder):
    """No operator loses a key that is too short for it."""
    panel, keys = P.user_type_day(spark, folder), ["k", "t"]
    acf = tsstats.autocorrelation(panel, KT, nlags=3).groupBy(*keys).agg(F.count("*").alias("acf_lags"), F.max(F.when(F.col("lag") == 0, F.col("acf").isNull())).alias("no_acf"))
    kpss = tsstats.kpss_test(panel, KT).select(*keys, F.col("error").alias("kpss_error"))
    parts = tsstats.seasonal_decompose(panel, KT, 4).groupBy(*keys).agg(F.count("*").alias("decomposed_rows"), F.max("error").alias("decomposition_error"))
    seasonal = FC.exponential_smoothing(panel, KT, 1, season_length=4).select(*keys, F.col("yhat").isNull().alias("no_seasonal_forecast"))
    trend = FC.exponential_smoothing(panel, KT, 1).select(*keys, F.col("yhat").isNull().alias("no_trend_forecast"))
    out = acf
    for part in (kpss, parts, seasonal, trend):
        out = out.join(part, keys, "full")
    return shown(out)


def _end_points(spark, folder):
    """First and last shipping day of each supplier with one unknown value for every day between."""
    lines = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d"), F.col("l_quantity").alias("q"))
    daily = to_panel(lines, P.DAILY, {"y": F.sum("q")})
    ends = daily.groupBy("k").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.min_by("y", "d").alias("y0"), F.max_by("y", "d").alias("y1"))
    two = ends.select("k", F.inline(F.array(F.struct(F.col("lo").alias("d"), F.col("y0").alias("y")), F.struct(F.col("hi").alias("d"), F.col("y1").alias("y")))))
    return fill_time_gaps(dealt_by_periods(two.distinct(), P.DAILY), P.DAILY, add_indicator=False)


_ENDS = """WITH panel AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2),
 e AS (SELECT k, min(d) AS lo, max(d) AS hi, arg_min(y, d) AS y0, arg_max(y, d) AS y1, pow(0.5, max(d) - min(d)) AS old FROM panel GROUP BY k),
 x AS (SELECT *, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM e)"""


@query("ewm_after_long_gap", f"""{_ENDS} SELECT k, {s("d")} AS d, {r("CASE WHEN d < hi OR lo = hi THEN y0 ELSE (old * y0 + 0.5 * y1) / (old + 0.5) END")} AS mean FROM x""")
def ewm_after_long_gap(spark, folder):
    """A value after years without any has all the weight."""
    out = recurrence.ewm_mean(_end_points(spark, folder), P.DAILY, F.col("y"), 0.5, "mean")
    return shown(out.select("k", "d", "mean"))


@query("adjusted_mean_after_long_gap", f"""{_ENDS} SELECT k, {s("d")} AS d, {r("CASE WHEN d < hi OR lo = hi THEN y0 ELSE (old * y0 + y1) / (old + 1) END")} AS mean FROM x""")
def adjusted_mean_after_long_gap(spark, folder):
    out = recurrence.ewm_mean(_end_points(spark, folder), P.DAILY, F.col("y"), 0.5, "mean", adjust=True)
    return shown(out.select("k", "d", "mean"))


_SKEWED = "SELECT l_suppkey AS k, pow(l_quantity / 50.0, 1.0 / 6) AS y FROM lineitem"
_BEYOND = """SELECT -2.0 + i * 0.1 AS lam FROM range(41) t(i) UNION ALL SELECT -2.0 - 0.5 * (pow(2, i) - 1) FROM range(1, 9) t(i) UNION ALL SELECT 2.0 + 0.5 * (pow(2, i) - 1) FROM range(1, 9) t(i)"""


@query(
    "boxcox_lambda_beyond_grid",
    f"""WITH panel AS ({_SKEWED}), g AS ({_BEYOND}),
 l AS (SELECT k, lam, count(*) AS n, var_pop(CASE WHEN abs(lam) < 1e-9 THEN ln(y) ELSE (pow(y, lam) - 1) / lam END) AS v, sum(ln(y)) AS j FROM panel, g GROUP BY k, lam)
SELECT k, {r("arg_max(lam, -n / 2.0 * ln(v) + (lam - 1) * j)", 4)} AS lambda FROM l GROUP BY k""",
)
def boxcox_lambda_beyond_grid(spark, folder):
    """Sixth roots of even quantities: the best exponent lies far above 2."""
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("k"), F.pow(F.col("l_quantity") / 50.0, F.lit(1.0 / 6)).alias("y"))
    return shown(transforms.fit_boxcox(rows, "y", ["k"], rounds=0).select("k", "lambda"), 4)


@query(
    "seasonal_cycles_long",
    f"""{P.with_grid(P.BRAND_MONTH, "1 MONTH")}, p AS (SELECT k, y, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS i FROM filled)
SELECT k, {n("i // 12")} AS cycle, {n("i % 12")} AS position, {r("y")} AS value FROM p""",
)
def seasonal_cycles_long(spark, folder):
    """Every cycle of every key, however many there are."""
    return shown(chartdata.seasonal_cycles(P.brand_month_full(spark, folder), P.MONTHLY, 12))


@query(
    "boxcox_and_back",
    f"""SELECT l_orderkey, {n("l_linenumber")} AS l_linenumber, l_partkey, l_suppkey, {r("(pow(l_quantity, 0.3) - 1) / 0.3")} AS y_bc, {r("l_quantity")} AS back, {r("exp(l_discount)")} AS from_log FROM lineitem""",
)
def boxcox_and_back(spark, folder):
    y = transforms.boxcox(F.col("l_quantity"), 0.3)
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", y.alias("y_bc"), transforms.inverse_boxcox(y, 0.3).alias("back"), transforms.inverse_boxcox(F.col("l_discount"), 0.0).alias("from_log")
    )
    return shown(rows)


@query(
    "yeo_johnson_values",
    f"""{SUP}, g AS (SELECT -2.0 + i * 0.15 AS lam FROM range(41) t(i)),
 l AS (SELECT k, lam, count(*) AS n, var_pop(CASE WHEN abs(lam) < 1e-9 THEN ln(1 + y) ELSE (pow(1 + y, lam) - 1) / lam END) AS v, sum(ln(1 + y)) AS j FROM filled, g GROUP BY k, lam),
 b AS (SELECT k, arg_max(lam, -n / 2.0 * ln(v) + (lam - 1) * j) AS lam FROM l GROUP BY k)
SELECT k, {s("d")} AS d, {r("y")} AS y, {r("lam", 4)} AS lambda, {r("CASE WHEN abs(lam) < 1e-9 THEN ln(1 + y) ELSE (pow(1 + y, lam) - 1) / lam END", 4)} AS y_yj FROM filled JOIN b USING (k)""",
)
def yeo_johnson_values(spark, folder):
    out = transforms.yj_transform(P.supplier_week_full(spark, folder), "y", ["k"], rounds=0)
    return shown(out.select("k", "d", "y", F.round("lambda", 4).alias("lambda"), F.round(F.col("y_yj") + 2e-8, 4).alias("y_yj")))


@query(
    "categories_as_codes",
    """WITH a AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)),
 f AS (SELECT o_orderstatus AS v, row_number() OVER (ORDER BY min((o_custkey, o_orderdate)), o_orderstatus) - 1 AS c FROM orders GROUP BY 1)
SELECT o_orderkey, a.c AS o_orderpriority, f.c AS o_orderstatus FROM orders JOIN a ON a.v = o_orderpriority JOIN f ON f.v = o_orderstatus""",
)
def categories_as_codes(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    spec = PanelSpec("o_orderdate", "", ("o_custkey",))
    coded = encode.encode_categoricals(orders, spec, ["o_orderpriority"], "category")
    return shown(encode.encode_categoricals(coded, spec, ["o_orderstatus"], "label").select("o_orderkey", "o_orderpriority", "o_orderstatus"))


@query(
    "target_means_of_training_rows",
    f"""SELECT o_orderkey, {r("(sum(o_totalprice) OVER (PARTITION BY o_custkey) + 10 * avg(o_totalprice) OVER ()) / (count(*) OVER (PARTITION BY o_custkey) + 10.0)", 3)} AS o_custkey_te FROM orders""",
)
def target_means_of_training_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return shown(encode.target_encode(orders, ["o_custkey"], "o_totalprice")[0].select("o_orderkey", "o_custkey_te"), 3)


_CASES = " ".join(f"WHEN '{c}' THEN '{o}'" for c, o in demand.OBJECTIVES.items())
_LOSS_ROWS = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in demand.LOSSES)


@query(
    "loss_per_series",
    f"""{P.with_grid(P.CUSTOMER_WEEK)}, st AS (SELECT k, count(*) / CAST(count(*) FILTER (y <> 0) AS DOUBLE) AS adi, pow(stddev_samp(y) FILTER (y <> 0) / avg(y) FILTER (y <> 0), 2) AS cv2 FROM filled GROUP BY k),
 c AS (SELECT k, CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic' WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS sb_class FROM st WHERE adi IS NOT NULL AND cv2 IS NOT NULL),
 l(loss, name, objective, domain, use_when, watch_out) AS (VALUES {_LOSS_ROWS})
SELECT k, sb_class, loss, name, l.objective, domain, use_when, watch_out FROM c JOIN l ON l.objective = CASE sb_class {_CASES} END""",
)
def loss_per_series(spark, folder):
    classes = demand.classify_all_series(P.complete_panel(P.customer_week(spark, folder), P.WEEKLY), P.WEEKLY)
    wanted = classes.select("k", "sb_class", demand.recommend_loss(F.col("sb_class")).alias("objective"))
    return shown(wanted.join(demand.loss_catalog(spark), "objective"))


# --- reports of a parameter search ------------------------------------------------------

_SCORES = f"""{SUP}, p AS (SELECT k, d, y, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM filled),
 e AS (SELECT a.k, a.d, abs(a.y - b.y) AS e, lag FROM p a JOIN (VALUES (1), (4), (13)) l(lag) ON true JOIN p b ON b.k = a.k AND b.i = a.i - lag),
 sc AS (SELECT CASE lag WHEN 1 THEN 0 WHEN 4 THEN 2 ELSE 4 END + q - 1 AS trial, lag, q AS power, (date_diff('day', DATE '1970-01-05', d) // 7) % 4 AS fold, CASE q WHEN 1 THEN avg(e) ELSE sqrt(avg(e * e)) END AS score
  FROM e, (VALUES (1), (2)) v(q) GROUP BY lag, q, (date_diff('day', DATE '1970-01-05', d) // 7) % 4),
 rk AS (SELECT trial, lag, power, avg(score) AS mean_score, stddev_pop(score) AS std_score, max(score) FILTER (fold = 0) AS fold0, max(score) FILTER (fold = 3) AS fold3 FROM sc GROUP BY trial, lag, power)"""


def _scores(spark, folder):
    """Errors of the value ``lag`` weeks back, as a search over lag and power on four folds of weeks."""
    panel = complete_panel(P.supplier_week(spark, folder), P.WEEKLY)
    grid = tuning.parameter_grid(spark, {"lag": [1, 4, 13], "power": [1, 2]})
    errors = panel.withColumns({f"_e{g}": F.abs(F.col("y") - F.lag("y", g).over(P.WEEKLY.in_order())) for g in (1, 4, 13)})
    week = F.pmod(P.WEEKLY.freq.index("d") - 1, F.lit(4)).cast("int")
    long = errors.select(week.alias("fold"), F.inline(F.array(*[F.struct(F.lit(g).alias("lag"), F.col(f"_e{g}").alias("e")) for g in (1, 4, 13)])))
    sums = long.groupBy("fold", "lag").agg(F.avg("e").alias("_1"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("_2"))
    scored = sums.select("fold", "lag", F.inline(F.array(*[F.struct(F.lit(q).alias("power"), F.col(f"_{q}").alias("score")) for q in (1, 2)])))
    return grid.join(scored, ["lag", "power"]).withColumn("state", F.lit("complete"))


@query("search_ranking", f"""{_SCORES} SELECT {n("trial")} AS trial, {n("lag")} AS lag, {n("power")} AS power, {r("mean_score", 4)} AS mean_score, {r("std_score", 4)} AS std_score, {r("fold0", 4)} AS fold0, {r("fold3", 4)} AS fold3 FROM rk""")
def search_ranking(spark, folder):
    ranked = tuning.ranking(_scores(spark, folder), ["lag", "power"], 4)
    return shown(ranked.drop("fold1", "fold2"), 4)


@query("search_score_matrix", f"""{_SCORES} SELECT {n("lag")} AS lag, {r("max(mean_score) FILTER (power = 1)", 4)} AS "1", {r("max(mean_score) FILTER (power = 2)", 4)} AS "2" FROM rk GROUP BY lag""")
def search_score_matrix(spark, folder):
    ranked = tuning.ranking(_scores(spark, folder), ["lag", "power"], 4)
    return shown(tuning.score_matrix(ranked, "lag", "power", [1, 2]), 4)


@query(
    "search_history",
    f"""{_SCORES} SELECT {n("trial")} AS trial, {r("mean_score", 4)} AS value, {r("min(mean_score) OVER (ORDER BY trial)", 4)} AS best_so_far FROM rk""",
)
def search_history(spark, folder):
    return shown(tuning.trial_history(_scores(spark, folder), ["lag", "power"]).select("trial", "value", "best_so_far"), 4)


@query("search_state_counts", f"""{_SCORES} SELECT 'complete' AS state, count(*) AS n FROM rk""")
def search_state_counts(spark, folder):
    return shown(tuning.state_counts(tuning.trial_history(_scores(spark, folder), ["lag", "power"])))


@query(
    "density_beside_residuals",
    f"""{P.with_grid(P.BRAND_MONTH, "1 MONTH")} SELECT k, {s("d")} AS d, {r("exp(-pow((y - avg(y) OVER w) / stddev_samp(y) OVER w, 2) / 2) / (stddev_samp(y) OVER w * sqrt(2 * pi()))", 8)} AS density FROM filled WINDOW w AS (PARTITION BY k)""",
)
def density_beside_residuals(spark, folder):
    w = P.MONTHLY.per_key()
    density = chartdata.normal_density(F.col("y"), F.avg("y").over(w), F.stddev_samp("y").over(w))
    return shown(P.brand_month_full(spark, folder).select("k", "d", density.alias("density")), 8)


@query(
    "dickey_fuller_tests",
    f"""{P.with_grid(P.BRAND_MONTH, "1 MONTH")}, p AS (SELECT k, y - lag(y) OVER w AS dy, lag(y) OVER w AS x FROM filled WINDOW w AS (PARTITION BY k ORDER BY d)),
 f AS (SELECT k, count(*) AS n, regr_slope(dy, x) AS b, regr_syy(dy, x) AS syy, regr_sxx(dy, x) AS sxx FROM p WHERE x IS NOT NULL GROUP BY k),
 t AS (SELECT *, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) AS t, -2.86154 - 2.8903 / n - 4.234 / pow(n, 2) - 40.040 / pow(n, 3) AS c FROM f)
SELECT k, {n("n")} AS n_obs, {r("t", 4)} AS statistic, {r("c", 4)} AS critical_5pct, {n("t < c")} AS stationary FROM t""",
)
def dickey_fuller_tests(spark, folder):
    """Without lagged differences the test is one regression that SQL can state."""
    out = tsstats.adf_test(P.brand_month_full(spark, folder), P.MONTHLY, max_lag=0)
    return shown(out.select("k", "n_obs", "statistic", "critical_5pct", "stationary"), 4)
