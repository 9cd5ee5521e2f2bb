"""Splits, folds, forecasters, metrics and series statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions import metrics as M
from seriesloom.operators import forecast as FC
from seriesloom.operators import scoring, splits, tsstats
from seriesloom.operators import walkforward as WF
from seriesloom.operators.grid import dealt_by_periods
from seriesloom.operators.impute import join_on_keys
from seriesloom.session import reliable_checkpoint
from workload import panels as P
from workload.registry import n, query, r, s, shown

SUP = P.with_grid(P.SUPPLIER_WEEK)
HORIZON, SEASON = 13, 52

# Last 13 weeks of the calendar are the test part of every supplier.
SPLIT = f"""{SUP}, e AS (SELECT max(d) AS hi FROM filled),
 train AS (SELECT k, d, y FROM filled, e WHERE d <= hi - 91), test AS (SELECT k, d, y FROM filled, e WHERE d > hi - 91)"""


def _train_test(spark, folder):
    full = P.supplier_week_full(spark, folder)
    split = splits.holdout_horizon_split(full, P.WEEKLY, HORIZON)
    return split.train, split.test


@query(
    "holdout_split_summary",
    f"""{SUP}, e AS (SELECT max(d) AS hi FROM filled),
 p AS (SELECT CASE WHEN d <= hi - 182 THEN 'train' WHEN d <= hi - 91 THEN 'val' ELSE 'test' END AS split, d FROM filled, e)
SELECT split, count(*) AS n_rows, {r("count(*) * 100.0 / (SELECT count(*) FROM p)")} AS pct, {s("min(d)")} AS start, {s('max(d)')} AS "end" FROM p GROUP BY 1""",
)
def holdout_split_summary(spark, folder):
    return shown(splits.holdout_horizon_split(P.supplier_week_full(spark, folder), P.WEEKLY, HORIZON, HORIZON).summary())


@query(
    "dated_split_summary",
    f"""WITH p AS (SELECT CASE WHEN d <= DATE '1998-06-30' THEN 'train' WHEN d <= DATE '2000-03-31' THEN 'val' ELSE 'test' END AS split, d FROM ({P.BRAND_DAY}) WHERE d <= DATE '2001-12-31')
SELECT split, count(*) AS n_rows, {r("count(*) * 100.0 / (SELECT count(*) FROM p)")} AS pct, {s("min(d)")} AS start, {s('max(d)')} AS "end" FROM p GROUP BY 1""",
)
def dated_split_summary(spark, folder):
    return shown(splits.time_based_split(P.brand_day(spark, folder), P.DAILY, "1998-06-30", "2000-03-31", "2001-12-31").summary())


@query(
    "cutoff_split_rows",
    f"""WITH p AS ({P.BRAND_DAY}) SELECT 'train' AS part, count(*) AS n, {r("sum(y)")} AS y FROM p WHERE d < DATE '2000-01-01'
UNION ALL SELECT 'test', count(*), {r("sum(y)")} FROM p WHERE d >= DATE '2000-01-01' AND d <= DATE '2000-06-30'""",
)
def cutoff_split_rows(spark, folder):
    train, test = splits.cutoff_split(P.brand_day(spark, folder), P.DAILY, "2000-01-01", "2000-06-30")
    agg = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.sum("y").alias("y"))
    return shown(agg(train, "train").unionByName(agg(test, "test")))


@query(
    "fractional_split_summary",
    f"""WITH p AS ({P.BRAND_DAY}), b AS (SELECT min(d) AS lo, max(d) AS hi FROM p),
 c AS (SELECT lo + CAST(floor((hi - lo) * 0.7) AS INTEGER) AS a, lo + CAST(floor((hi - lo) * (0.7 + 0.15)) AS INTEGER) AS v FROM b),
 x AS (SELECT CASE WHEN d <= a THEN 'train' WHEN d <= v THEN 'val' ELSE 'test' END AS split, d FROM p, c)
SELECT split, count(*) AS n_rows, {r("count(*) * 100.0 / (SELECT count(*) FROM x)")} AS pct, {s("min(d)")} AS start, {s('max(d)')} AS "end" FROM x GROUP BY 1""",
)
def fractional_split_summary(spark, folder):
    return shown(splits.fractional_split(P.brand_day(spark, folder), P.DAILY).summary())


@query(
    "leakage_check",
    f"""{SUP}, e AS (SELECT max(d) AS hi FROM filled)
SELECT {s("min(d)")} AS train_start, {s("max(d) FILTER (d <= hi - 182)")} AS train_end, {s("min(d) FILTER (d > hi - 182 AND d <= hi - 91)")} AS val_start,
 {s("max(d) FILTER (d > hi - 182 AND d <= hi - 91)")} AS val_end, {s("min(d) FILTER (d > hi - 91)")} AS test_start, {s("max(d)")} AS test_end, {n("1")} AS ok FROM filled, e""",
)
def leakage_check(spark, folder):
    split = splits.holdout_horizon_split(P.supplier_week_full(spark, folder), P.WEEKLY, HORIZON, HORIZON)
    return shown(splits.leakage_report(split.frame, P.WEEKLY))


def _folds_sql(panel: str, folds: str) -> str:
    return f"""WITH p AS ({panel}), b AS (SELECT min(d) AS lo, max(d) AS hi FROM p), f AS ({folds})
SELECT {n("fold")} AS fold, {s("ts")} AS train_start, {s("te")} AS train_end, {s("vs")} AS valid_start, {s("ve")} AS valid_end,
 (SELECT count(*) FROM p WHERE d BETWEEN ts AND te) AS n_train, (SELECT count(*) FROM p WHERE d BETWEEN vs AND ve) AS n_valid FROM f"""


@query("expanding_folds", _folds_sql(P.SUPPLIER_WEEK, "SELECT i AS fold, lo AS ts, DATE '1999-01-04' + CAST(i * 91 AS INTEGER) AS te, DATE '1999-01-11' + CAST(i * 91 AS INTEGER) AS vs, DATE '1999-04-05' + CAST(i * 91 AS INTEGER) AS ve FROM b, range(4) t(i)"))
def expanding_folds(spark, folder):
    panel = P.supplier_week(spark, folder)
    folds = splits.expanding_window_split(panel, P.WEEKLY, "1999-01-04", 13, 4)
    return shown(splits.describe_folds(panel, P.WEEKLY, folds))


@query("rolling_folds", _folds_sql(P.SUPPLIER_WEEK, "SELECT i AS fold, lo + CAST(i * 56 AS INTEGER) AS ts, lo + CAST(i * 56 + 103 * 7 AS INTEGER) AS te, lo + CAST(i * 56 + 104 * 7 AS INTEGER) AS vs, lo + CAST(i * 56 + 116 * 7 AS INTEGER) AS ve FROM b, range(5) t(i)"))
def rolling_folds(spark, folder):
    panel = P.supplier_week(spark, folder)
    folds = splits.rolling_window_split(panel, P.WEEKLY, 104, 13, 5, step=8)
    return shown(splits.describe_folds(panel, P.WEEKLY, folds))


@query("expanding_day_folds", _folds_sql(P.BRAND_DAY, "SELECT i AS fold, lo AS ts, hi - CAST((4 - i) * 28 + 7 AS INTEGER) AS te, hi - CAST((4 - i) * 28 - 1 AS INTEGER) AS vs, hi - CAST((3 - i) * 28 AS INTEGER) AS ve FROM b, range(4) t(i)"))
def expanding_day_folds(spark, folder):
    panel = P.brand_day(spark, folder)
    return shown(splits.describe_folds(panel, P.DAILY, splits.expanding_day_folds(panel, P.DAILY, 4, 28, 7)))


@query("sliding_day_folds", _folds_sql(P.BRAND_DAY, "SELECT i AS fold, lo + CAST(i * 28 AS INTEGER) AS ts, lo + CAST(i * 28 + 364 AS INTEGER) AS te, lo + CAST(i * 28 + 368 AS INTEGER) AS vs, lo + CAST(i * 28 + 395 AS INTEGER) AS ve FROM b, range(4) t(i)"))
def sliding_day_folds(spark, folder):
    panel = P.brand_day(spark, folder)
    return shown(splits.describe_folds(panel, P.DAILY, splits.sliding_day_folds(panel, P.DAILY, 4, 365, 28, 3)))


@query(
    "positional_split",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS b, count(*) OVER (PARTITION BY k) AS n FROM ({P.CUSTOMER_WEEK}))
SELECT k, count(*) FILTER (b > ceil(n * 0.2)) AS n_train, count(*) FILTER (b <= ceil(n * 0.2)) AS n_test, {s("min(d) FILTER (b <= ceil(n * 0.2))")} AS test_start FROM p GROUP BY k""",
)
def positional_split(spark, folder):
    out = splits.train_test_split_ts(P.customer_week(spark, folder), P.WEEKLY, 0.2)
    part = lambda p: F.count(F.when(F.col("split") == p, 1))
    return shown(out.groupBy("k").agg(part("train").alias("n_train"), part("test").alias("n_test"), F.min(F.when(F.col("split") == "test", F.col("d"))).alias("test_start")))


@query(
    "walk_forward_drift",
    f"""{SUP}, p AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY k) AS n, first_value(y) OVER w AS y0 FROM filled WINDOW w AS (PARTITION BY k ORDER BY d)),
 o AS (SELECT k, i, y, y0 FROM p WHERE i >= n - 26 AND i + 4 <= n AND (i - (n - 26)) % 2 = 0),
 f AS (SELECT o.k, o.i + h AS i, o.i AS src, CASE WHEN o.i < 2 THEN o.y ELSE o.y + (o.y - o.y0) / (o.i - 1) * h END AS v FROM o, range(1, 5) t(h)),
 g AS (SELECT k, i, arg_max(v, src) AS predicted FROM f GROUP BY k, i)
SELECT p.k, {s("p.d")} AS d, {r("p.y")} AS actual, {r("g.predicted")} AS predicted FROM g JOIN p ON p.k = g.k AND p.i = g.i""",
)
def walk_forward_drift(spark, folder):
    w = P.WEEKLY.in_order()
    i = F.row_number().over(w)
    state = {"_y": F.col("y"), "_slope": F.coalesce(F.try_divide(F.col("y") - F.first("y").over(w), i - 1), F.lit(0.0))}
    made = F.col("_y") + F.col("_slope") * F.col("horizon")
    out = splits.walk_forward_validation(P.supplier_week_full(spark, folder), P.WEEKLY, state, made, 26, 2, 4)
    return shown(out.select("k", "d", "actual", "predicted"))


# Origins every 3 weeks from 26 weeks before the end on, 4 weeks ahead; the latest origin of a date counts.
_WALK = f"""{SUP}, p AS (SELECT k, d, y, row_number() OVER (PARTITION BY k ORDER BY d) AS i, count(*) OVER (PARTITION BY k) AS n FROM filled)"""
_WALKED = f""", f AS (SELECT st.k, st.i + h AS i, st.i AS src, {{forecast}} AS v FROM st, range(1, 5) t(h) WHERE st.i >= st.n - 26 AND st.i + 4 <= st.n AND (st.i - (st.n - 26)) % 3 = 0 AND st.n > 26),
 g AS (SELECT k, i, arg_max(v, src) AS v, max(src) AS src FROM f WHERE v IS NOT NULL GROUP BY k, i)
SELECT p.k, {s("p.d")} AS d, {r("p.y")} AS actual, {r("g.v")} AS predicted, {s("q.d")} AS origin, {n("p.i - g.src")} AS horizon
FROM g JOIN p ON p.k = g.k AND p.i = g.i JOIN p q ON q.k = g.k AND q.i = g.src"""


def _walked(spark, folder, forecaster):
    return shown(WF.walk_forward(P.supplier_week_full(spark, folder), P.WEEKLY, forecaster, 26, 3, 4))


@query("walk_forward_seasonal_naive", f"{_WALK}, st AS (SELECT * FROM p)" + _WALKED.format(forecast="(SELECT y FROM p z WHERE z.k = st.k AND z.i = st.i - 13 + h AND st.i >= 13)"))
def walk_forward_seasonal_naive(spark, folder):
    return _walked(spark, folder, WF.seasonal_naive(13))


@query(
    "walk_forward_croston",
    f"""{_WALK}, st AS (
 SELECT k, i, n, CAST(y > 0 AS INT) AS m, CASE WHEN y > 0 THEN CAST(y AS DOUBLE) END AS z, CASE WHEN y > 0 THEN CAST(1 AS DOUBLE) END AS q, CASE WHEN y > 0 THEN 0 ELSE 1 END AS gap, CASE WHEN y > 0 THEN CAST(y AS DOUBLE) END AS last FROM p WHERE i = 1
 UNION ALL SELECT p.k, p.i, p.n, m + CAST(p.y > 0 AS INT), CASE WHEN p.y <= 0 THEN z WHEN m = 0 THEN p.y ELSE z + 0.2 * (p.y - z) END,
  CASE WHEN p.y <= 0 THEN q WHEN m = 0 THEN gap + 1 ELSE q + 0.2 * (gap + 1 - q) END, CASE WHEN p.y > 0 THEN 0 ELSE gap + 1 END, CASE WHEN p.y > 0 THEN p.y ELSE last END
  FROM st JOIN p ON p.k = st.k AND p.i = st.i + 1)"""
    + _WALKED.format(forecast="CASE WHEN m = 0 THEN 0 WHEN m = 1 THEN last / st.i ELSE z / q * 0.9 END"),
)
def walk_forward_croston(spark, folder):
    return _walked(spark, folder, WF.croston(0.2, "sba"))


@query(
    "walk_forward_holt",
    f"""{_WALK}, st AS (
 SELECT a.k, CAST(1 AS BIGINT) AS i, a.n, CAST(a.y AS DOUBLE) AS l, CAST(b.y - a.y AS DOUBLE) AS t FROM p a JOIN p b ON a.k = b.k AND a.i = 1 AND b.i = 2
 UNION ALL SELECT p.k, p.i, p.n, l + 0.9 * t + 0.3 * (p.y - l - 0.9 * t), 0.9 * t + 0.3 * 0.1 * (p.y - l - 0.9 * t) FROM st JOIN p ON p.k = st.k AND p.i = st.i + 1)"""
    + _WALKED.format(forecast="l + t * 0.9 * (1 - pow(0.9, h)) / (1 - 0.9)"),
)
def walk_forward_holt(spark, folder):
    return _walked(spark, folder, WF.smoothing(0.3, 0.1, 0.9))


# --- forecasters -----------------------------------------------------------------------

_BASE = f"""{SPLIT}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS b FROM train),
 st AS (SELECT k, max(d) AS hi, arg_max(y, d) AS y1, arg_min(y, d) AS y0, avg(y) AS mu, count(*) AS n FROM train GROUP BY k),
 fc AS (SELECT st.k, CAST(hi + CAST(h * 7 AS INTEGER) AS DATE) AS d, h AS horizon, m AS model,
   CASE m WHEN 'naive' THEN y1 WHEN 'mean' THEN mu WHEN 'drift' THEN y1 + coalesce((y1 - y0) / nullif(n - 1, 0), 0) * h
     ELSE (SELECT o.y FROM o WHERE o.k = st.k AND o.b = {SEASON} - (h - 1) % {SEASON}) END AS yhat
   FROM st, range(1, {HORIZON + 1}) t(h), (VALUES ('naive'), ('mean'), ('drift'), ('seasonal_naive')) v(m))"""
BASELINES = ["naive", "mean", "drift", "seasonal_naive"]


@query("baseline_forecasts", f"""{_BASE} SELECT k, {s("d")} AS d, {n("horizon")} AS horizon, model, {r("yhat")} AS yhat FROM fc""")
def baseline_forecasts(spark, folder):
    train, _ = _train_test(spark, folder)
    return shown(FC.forecast_all(train, P.WEEKLY, HORIZON, SEASON, BASELINES))


_REPORT = {
    "MAE": "avg(abs(y - f))", "RMSE": "sqrt(avg(pow(y - f, 2)))", "WAPE": "100 * sum(abs(y - f)) / sum(abs(y))",
    "sMAPE": "100 * avg(abs(y - f) / ((abs(y) + abs(f)) / 2 + 1e-8))", "MAPE": "100 * avg(abs((y - f) / y)) FILTER (abs(y) > 1e-8)",
    "Bias": "avg(y - f)", "PctBias": "100 * sum(y - f) / sum(abs(y))",
}
_SCALE = f"""sc AS (SELECT k, avg(abs(e)) AS scale, avg(e * e) AS sq FROM (SELECT k, y - lag(y, {SEASON}) OVER (PARTITION BY k ORDER BY d) AS e FROM train) GROUP BY k)"""
_COLS = ", ".join(f'{r(v)} AS "{k}"' for k, v in _REPORT.items())
_SCALED = f"""{r("avg(abs(y - f) / scale)")} AS "MASE", {r("sqrt(avg(pow(y - f, 2) / sq))")} AS "RMSSE" """


@query(
    "model_comparison",
    f"""{_BASE}, {_SCALE}, j AS (SELECT fc.model, t.y, fc.yhat AS f, scale, sq FROM test t JOIN fc ON fc.k = t.k AND fc.d = t.d JOIN sc ON sc.k = t.k)
SELECT model, {_COLS}, {_SCALED}, count(f) AS coverage_n FROM j GROUP BY model""",
)
def model_comparison(spark, folder):
    train, test = _train_test(spark, folder)
    fc = FC.forecast_all(train, P.WEEKLY, HORIZON, SEASON, BASELINES)
    return shown(scoring.compare_models(test, fc, train, P.WEEKLY, SEASON))


@query(
    "metrics_by_key_and_model",
    f"""{_BASE}, j AS (SELECT fc.model, t.k, t.y, fc.yhat AS f FROM test t JOIN fc ON fc.k = t.k AND fc.d = t.d)
SELECT k, model, {_COLS.replace("/ sum(abs(y))", "/ nullif(sum(abs(y)), 0)")} FROM j GROUP BY k, model""",
)
def metrics_by_key_and_model(spark, folder):
    train, test = _train_test(spark, folder)
    fc = FC.forecast_all(train, P.WEEKLY, HORIZON, SEASON, BASELINES)
    scored = scoring.align(test, fc, P.WEEKLY)
    return shown(scoring.metric_report(scored.filter("model IS NOT NULL"), "y", "yhat", ["k", "model"]))


@query(
    "univariate_metrics",
    f"""{_BASE}, {_SCALE}, j AS (SELECT fc.model, t.y, fc.yhat AS f, scale FROM test t JOIN fc ON fc.k = t.k AND fc.d = t.d JOIN sc ON sc.k = t.k)
SELECT model, {r("avg(abs(y - f))")} AS "MAE", {r("avg(pow(y - f, 2))")} AS "MSE", {r("sqrt(avg(pow(y - f, 2)))")} AS "RMSE",
 {r("100 * avg(abs((y - f) / y)) FILTER (y <> 0)")} AS "MAPE", {r("100 * avg(abs(y - f) / ((abs(y) + abs(f)) / 2)) FILTER (abs(y) + abs(f) <> 0)")} AS "sMAPE",
 {r("avg(f - y)")} AS "ME", {r("avg(abs(y - f) / scale)")} AS "MASE" FROM j GROUP BY model""",
)
def univariate_metrics(spark, folder):
    train, test = _train_test(spark, folder)
    fc = FC.forecast_all(train, P.WEEKLY, HORIZON, SEASON, BASELINES)
    scored = join_on_keys(scoring.align(test, fc, P.WEEKLY), scoring.naive_scale(train, P.WEEKLY, SEASON), ["k"])
    return shown(scoring.forecast_metrics(scored.filter("model IS NOT NULL"), "y", "yhat", ["model"], "scale"))


@query(
    "wape_by_horizon",
    f"""{_BASE} SELECT fc.model, {n("t.d - (SELECT hi - 91 FROM e)")} AS horizon, {r("100 * sum(abs(t.y - yhat)) / greatest(sum(abs(t.y)), 1)")} AS "WAPE"
FROM test t JOIN fc ON fc.k = t.k AND fc.d = t.d GROUP BY 1, 2""",
)
def wape_by_horizon(spark, folder):
    train, test = _train_test(spark, folder)
    fc = FC.forecast_all(train, P.WEEKLY, HORIZON, SEASON, BASELINES)
    anchor = train.agg(F.max("d").alias("anchor"))
    scored = scoring.align(test, fc, P.WEEKLY).filter("model IS NOT NULL").join(F.broadcast(anchor))
    return shown(scoring.wape_by_horizon(scored, "y", "yhat", "d", "anchor"))


@query(
    "other_losses",
    f"""{_BASE}, j AS (SELECT fc.model, t.y, fc.yhat AS f FROM test t JOIN fc ON fc.k = t.k AND fc.d = t.d)
SELECT model, {r("sum(y - f)")} AS cfe, {r("sqrt(avg(pow(ln(1 + y) - ln(1 + f), 2)))")} AS rmsle, {r("avg(greatest(0.9 * (y - f), -0.1 * (y - f)))")} AS pinball,
 {r("avg(CAST(y BETWEEN f * 0.5 AND f * 1.5 AS INTEGER))")} AS coverage, {r("sum((1 + y) * abs(y - f)) / sum(1 + y)")} AS wmae,
 {r("avg(f - y * ln(f)) FILTER (f > 0)")} AS poisson, {r("2 * avg(pow(y, 0.8) / (-0.2 * 0.8) - y * pow(f, -0.2) / -0.2 + pow(f, 0.8) / 0.8) FILTER (f > 0)")} AS tweedie FROM j
 WHERE model <> 'drift' GROUP BY 1""",
)
def other_losses(spark, folder):
    train, test = _train_test(spark, folder)
    fc = FC.forecast_all(train, P.WEEKLY, HORIZON, SEASON, ["naive", "mean", "seasonal_naive"])
    y, f = F.col("y"), F.col("yhat")
    scored = scoring.align(test, fc, P.WEEKLY).filter("model IS NOT NULL")
    return shown(
        scored.groupBy("model").agg(
            M.cfe(y, f).alias("cfe"), M.rmsle(y, f).alias("rmsle"), M.pinball_loss(y, f, 0.9).alias("pinball"),
            M.coverage(y, f * 0.5, f * 1.5).alias("coverage"), M.weighted_mae(y, f, 1 + y).alias("wmae"),
            M.poisson_loss(y, f).alias("poisson"), M.tweedie_deviance(y, f, 1.2).alias("tweedie"),
        )
    )


@query(
    "running_forecast_error",
    f"""{_BASE} SELECT t.k, {s("t.d")} AS d, {r("sum(t.y - yhat) OVER (PARTITION BY t.k ORDER BY t.d)")} AS cfe, {r("t.y - yhat")} AS residual
FROM test t JOIN fc ON fc.k = t.k AND fc.d = t.d WHERE model = 'mean'""",
)
def running_forecast_error(spark, folder):
    train, test = _train_test(spark, folder)
    res = scoring.residuals(test, FC.mean_forecast(train, P.WEEKLY, HORIZON), P.WEEKLY).filter("model IS NOT NULL")
    return shown(scoring.running_error(res, P.WEEKLY, "y", "yhat").select("k", "d", "cfe", "residual"))


@query(
    "unmatched_forecasts",
    f"""{_BASE}, f AS (SELECT k, d FROM fc WHERE model = 'naive')
SELECT {n("(SELECT count(*) FROM test t ANTI JOIN f USING (k, d))")} AS actual_only, {n("(SELECT count(*) FROM f ANTI JOIN test t USING (k, d))")} AS forecast_only,
 {n("(SELECT count(*) FROM f JOIN test t USING (k, d))")} AS matched""",
)
def unmatched_forecasts(spark, folder):
    train, test = _train_test(spark, folder)
    return shown(scoring.unmatched_rows(test, FC.naive_forecast(train, P.WEEKLY, HORIZON), P.WEEKLY))


@query(
    "ensemble_of_forecasts",
    f"""{_BASE} SELECT k, {s("d")} AS d, {r("avg(yhat)")} AS yhat, 'ensemble' AS model FROM fc WHERE model IN ('mean', 'seasonal_naive') GROUP BY k, d""",
)
def ensemble_of_forecasts(spark, folder):
    train, _ = _train_test(spark, folder)
    parts = [FC.mean_forecast(train, P.WEEKLY, HORIZON), FC.seasonal_naive_forecast(train, P.WEEKLY, HORIZON, SEASON)]
    return shown(scoring.average_forecasts(parts, P.WEEKLY))


@query(
    "best_model_refit",
    f"""{_BASE}, sc AS (SELECT t.k, fc.model, avg(abs(t.y - yhat)) AS mae FROM test t JOIN fc ON fc.k = t.k AND fc.d = t.d GROUP BY 1, 2),
 best AS (SELECT k, model FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CAST(printf('%.9e', mae * (1 + 2e-12)) AS DOUBLE), model) AS rn FROM sc WHERE mae IS NOT NULL) WHERE rn = 1),
 o2 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS b FROM filled),
 s2 AS (SELECT k, max(d) AS hi, arg_max(y, d) AS y1, arg_min(y, d) AS y0, avg(y) AS mu, count(*) AS n FROM filled GROUP BY k)
SELECT best.k, best.model, {n("h")} AS horizon, {s("CAST(hi + CAST(h * 7 AS INTEGER) AS DATE)")} AS d,
 {r(f"CASE best.model WHEN 'naive' THEN y1 WHEN 'mean' THEN mu WHEN 'drift' THEN y1 + coalesce((y1 - y0) / nullif(n - 1, 0), 0) * h ELSE (SELECT o2.y FROM o2 WHERE o2.k = best.k AND o2.b = {SEASON} - (h - 1) % {SEASON}) END")} AS yhat
FROM best JOIN s2 ON s2.k = best.k, range(1, 9) t(h)""",
)
def best_model_refit(spark, folder):
    train, test = _train_test(spark, folder)
    fc = FC.forecast_all(train, P.WEEKLY, HORIZON, SEASON, BASELINES)
    scored = scoring.metric_report(scoring.align(test, fc, P.WEEKLY).filter("model IS NOT NULL"), "y", "yhat", ["k", "model"])
    best = reliable_checkpoint(FC.best_model_per_key(scored, P.WEEKLY))
    full = P.supplier_week_full(spark, folder)
    return shown(FC.refit_best(full, best, P.WEEKLY, 8, SEASON, BASELINES))


_DAILY_USERS = P.with_grid(P.PART_WEEK)


@query(
    "croston_forecasts",
    f"""{_DAILY_USERS}, p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS i, count(*) OVER (PARTITION BY k) AS n FROM filled),
 v AS (SELECT k, i, n, y, row_number() OVER (PARTITION BY k ORDER BY i) AS j, count(*) OVER (PARTITION BY k) AS m, i - coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), 0) AS gap FROM p WHERE y > 0),
 c AS (SELECT k, j, m, n, i, y, CAST(y AS DOUBLE) AS z, CAST(gap AS DOUBLE) AS q, 1.0 / i AS pr FROM v WHERE j = 1
  UNION ALL SELECT v.k, v.j, v.m, v.n, v.i, v.y, 0.1 * v.y + 0.9 * c.z, 0.1 * v.gap + 0.9 * c.q, 0.2 + 0.8 * pow(0.8, v.gap - 1) * c.pr FROM c JOIN v ON v.k = c.k AND v.j = c.j + 1)
SELECT k, {r("CASE WHEN m = 1 THEN y / n ELSE z / q END")} AS classic, {r("CASE WHEN m = 1 THEN y / n ELSE z / q * 0.95 END")} AS sba, {r("z * pr * pow(0.8, n - i)")} AS tsb
FROM c WHERE j = m""",
)
def croston_forecasts(spark, folder):
    # Parts hold a bounded number of weeks: the grid has many times the rows of the exchange before it.
    full = P.complete_panel(dealt_by_periods(P.part_week(spark, folder), P.WEEKLY), P.WEEKLY)
    return shown(FC.intermittent_rates(full, P.WEEKLY, alpha=0.1, beta=0.2).drop("_last"))


@query(
    "holt_forecasts",
    f"""{P.with_grid(P.BRAND_MONTH, "1 MONTH")}, p AS (SELECT k, d, y, row_number() OVER (PARTITION BY k ORDER BY d) AS i, count(*) OVER (PARTITION BY k) AS n FROM filled),
 s0 AS (SELECT a.k, a.y AS l, b.y - a.y AS t FROM p a JOIN p b ON a.k = b.k AND a.i = 1 AND b.i = 2),
 g AS (SELECT * FROM (VALUES (0.1), (0.3), (0.5), (0.8)) a(al), (VALUES (0.05), (0.2)) b(be)),
 h AS (SELECT k, CAST(1 AS BIGINT) AS i, al, be, CAST(l AS DOUBLE) AS l, CAST(t AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS sse FROM s0, g
  UNION ALL SELECT p.k, p.i, al, be, h.l + h.t + al * (p.y - h.l - h.t), h.t + al * be * (p.y - h.l - h.t), sse + pow(p.y - h.l - h.t, 2) FROM h JOIN p ON p.k = h.k AND p.i = h.i + 1),
 f AS (SELECT h.*, row_number() OVER (PARTITION BY h.k ORDER BY sse, al, be) AS rn FROM h JOIN p ON p.k = h.k AND p.i = h.i AND p.i = p.n)
SELECT k, {n("x")} AS horizon, {r("l + x * t", 4)} AS yhat FROM f, range(1, 7) q(x) WHERE rn = 1""",
)
def holt_forecasts(spark, folder):
    fc = FC.exponential_smoothing(P.brand_month_full(spark, folder), P.MONTHLY, 6)
    return shown(fc.select("k", "horizon", "yhat"), 4)


@query(
    "holt_winters_forecasts",
    f"""{P.with_grid(P.BRAND_MONTH, "1 MONTH")}, p AS (SELECT k, d, CAST(y AS DOUBLE) AS y, row_number() OVER (PARTITION BY k ORDER BY d) AS i, count(*) OVER (PARTITION BY k) AS n FROM filled),
 s0 AS (SELECT k, avg(y) FILTER (i <= 12) AS l, (avg(y) FILTER (i > 12) - avg(y) FILTER (i <= 12)) / 12 AS t, list(y ORDER BY i) FILTER (i <= 12) AS v FROM p WHERE i <= 24 GROUP BY k),
 g AS (SELECT * FROM (VALUES (0.1), (0.3), (0.5), (0.8)) a(al), (VALUES (0.05), (0.2)) b(be), (VALUES (0.05), (0.2)) c(ga), (VALUES (0.9), (0.98)) e(ph)),
 h AS (SELECT k, CAST(12 AS BIGINT) AS i, CAST(al AS DOUBLE) AS al, CAST(be AS DOUBLE) AS be, CAST(ga AS DOUBLE) AS ga, CAST(ph AS DOUBLE) AS ph, l, t, list_transform(v, lambda x: x - l) AS se, CAST(0 AS DOUBLE) AS sse FROM s0, g
  UNION ALL SELECT k, i, al, be, ga, ph, l + t * ph + al * err, t * ph + al * be * err, list_append(se[2:12], se[1] + ga * err), sse + err * err
   FROM (SELECT h.k, p.i, al, be, ga, ph, l, t, se, sse, p.y - (h.l + h.t * h.ph + h.se[1]) AS err FROM h JOIN p ON p.k = h.k AND p.i = h.i + 1)),
 f AS (SELECT h.*, row_number() OVER (PARTITION BY h.k ORDER BY sse, al, be, ga, ph) AS rn FROM h JOIN p ON p.k = h.k AND p.i = h.i AND p.i = p.n)
SELECT k, {n("x")} AS horizon, {r("l + ph * (1 - pow(ph, x)) / (1 - ph) * t + se[x]", 4)} AS yhat FROM f, range(1, 13) q(x) WHERE rn = 1""",
)
def holt_winters_forecasts(spark, folder):
    fc = FC.exponential_smoothing(P.brand_month_full(spark, folder), P.MONTHLY, 12, damped=True, season_length=12)
    return shown(fc.select("k", "horizon", "yhat"), 4)


@query(
    "smoothing_parameters",
    f"""{P.with_grid(P.BRAND_MONTH, "1 MONTH")}, p AS (SELECT k, CAST(y AS DOUBLE) AS y, row_number() OVER (PARTITION BY k ORDER BY d) AS i, count(*) OVER (PARTITION BY k) AS n FROM filled),
 h AS (SELECT k, CAST(1 AS BIGINT) AS i, n, a, y AS l, CAST(0 AS DOUBLE) AS sse FROM p, range(1, 1000) g(a) WHERE i = 1
  UNION ALL SELECT p.k, p.i, p.n, a, h.l + a / 1000.0::DOUBLE * (p.y - h.l), sse + pow(p.y - h.l, 2) FROM h JOIN p ON p.k = h.k AND p.i = h.i + 1),
 f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sse, a) AS rn FROM h WHERE i = n)
SELECT k, {n("n")} AS n, {r("a / 1000.0", 3)} AS alpha, {r("sse", 2)} AS sse FROM f WHERE rn = 1""",
)
def smoothing_parameters(spark, folder):
    """Simple smoothing: the rate of least squared error among all thousandths."""
    found = FC.smoothing_parameters(P.brand_month_full(spark, folder), P.MONTHLY, FC.Smoothing(trend=False))
    return shown(found.select("k", "n", "alpha", F.round("sse", 2).alias("sse")), 3)


# --- series statistics -----------------------------------------------------------------

_MONTHS = P.with_grid(P.BRAND_MONTH, "1 MONTH")
_ACF = f"""{_MONTHS}, c AS (SELECT k, d, y - avg(y) OVER (PARTITION BY k) AS c, row_number() OVER (PARTITION BY k ORDER BY d) AS i, count(*) OVER (PARTITION BY k) AS n FROM filled),
 acf AS (SELECT a.k, a.n, a.i - b.i AS lag, sum(a.c * b.c) / (SELECT sum(z.c * z.c) FROM c z WHERE z.k = a.k) AS acf FROM c a JOIN c b ON a.k = b.k AND b.i <= a.i AND a.i - b.i <= 12 GROUP BY 1, 2, 3)"""


@query("autocorrelations", f"""{_ACF} SELECT k, n, lag, {r("acf")} AS acf FROM acf""")
def autocorrelations(spark, folder):
    return shown(tsstats.autocorrelation(P.brand_month_full(spark, folder), P.MONTHLY, nlags=12))


@query(
    "partial_autocorrelations",
    f"""{_ACF}, a1 AS (SELECT k, n, list(acf ORDER BY lag) AS r FROM acf GROUP BY 1, 2),
 dl AS (SELECT k, n, r, 1 AS j, [r[2]] AS phi, r[2] AS pacf FROM a1
  UNION ALL SELECT k, n, r, j + 1, list_concat([phi[x] - a * phi[j + 1 - x] for x in range(1, j + 1)], [a]), a FROM (
   SELECT *, (r[j + 2] - list_sum([phi[x] * r[j + 2 - x] for x in range(1, j + 1)])) / (1 - list_sum([phi[x] * r[x + 1] for x in range(1, j + 1)])) AS a FROM dl WHERE j < 12))
SELECT acf.k, acf.n, acf.lag, {r("acf.acf")} AS acf, {r("CASE WHEN acf.lag = 0 THEN 1 ELSE dl.pacf END")} AS pacf,
 {r("CASE WHEN acf.lag = 0 THEN 0 ELSE 1.959963984540054 * sqrt(1 + 2 * coalesce((SELECT sum(q.acf * q.acf) FROM acf q WHERE q.k = acf.k AND q.lag BETWEEN 1 AND acf.lag - 1), 0)) / sqrt(acf.n) END")} AS acf_half,
 {r("CASE WHEN acf.lag = 0 THEN 0 ELSE 1.959963984540054 / sqrt(acf.n) END")} AS pacf_half, {r("1.96 / sqrt(acf.n)")} AS white_half
FROM acf LEFT JOIN dl ON dl.k = acf.k AND dl.j = acf.lag""",
)
def partial_autocorrelations(spark, folder):
    return shown(tsstats.acf_pacf(P.brand_month_full(spark, folder), P.MONTHLY, nlags=12))


@query(
    "ljung_box_statistics",
    f"""{_ACF} SELECT k, lag, {r("n * (n + 2) * sum(acf * acf / (n - lag)) OVER (PARTITION BY k ORDER BY lag)")} AS lb_stat FROM acf WHERE lag BETWEEN 1 AND 10""",
)
def ljung_box_statistics(spark, folder):
    return shown(tsstats.ljung_box_statistic(P.brand_month_full(spark, folder), P.MONTHLY, lags=10))


# Chi-square tail as 1 minus the series of the lower incomplete gamma function.
_TAIL = "1 - list_sum(list_transform(range(400), lambda i: exp(-q / 2 + (a + i) * ln(q / 2) - lgamma(a + i + 1))))"


@query(
    "ljung_box_test",
    f"""{_ACF}, lb AS (SELECT k, lag, lag / 2.0 AS a, n * (n + 2) * sum(acf * acf / (n - lag)) OVER (PARTITION BY k ORDER BY lag) AS q FROM acf WHERE lag BETWEEN 1 AND 10),
 p AS (SELECT *, {_TAIL} AS p FROM lb)
SELECT k, lag, {r("q", 5)} AS lb_stat, {r("p", 5)} AS lb_pvalue, {n("min(p) OVER (PARTITION BY k) > 0.05")} AS white_noise FROM p""",
)
def ljung_box_test(spark, folder):
    return shown(tsstats.ljung_box_test(P.brand_month_full(spark, folder), P.MONTHLY, lags=10), 5)


@query(
    "cross_correlations",
    f"""WITH panel AS ({P.USER_DAY}), c AS (SELECT k, y - avg(y) OVER (PARTITION BY k) AS cy, x - avg(x) OVER (PARTITION BY k) AS cx, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM panel)
SELECT a.k, a.i - b.i AS lag, {r("sum(a.cx * b.cy) / (SELECT sqrt(sum(z.cx * z.cx)) * sqrt(sum(z.cy * z.cy)) FROM c z WHERE z.k = a.k)")} AS ccf
FROM c a JOIN c b ON a.k = b.k AND b.i <= a.i AND a.i - b.i <= 7 GROUP BY a.k, a.i - b.i""",
)
def cross_correlations(spark, folder):
    return shown(tsstats.cross_correlation(P.user_day(spark, folder), P.DAILY, "x", "y", 7).filter("ccf IS NOT NULL"))


_KPSS = f"""{_MONTHS}, c AS (SELECT k, y - avg(y) OVER (PARTITION BY k) AS e, row_number() OVER (PARTITION BY k ORDER BY d) AS i, count(*) OVER (PARTITION BY k) AS n FROM filled),
 s AS (SELECT k, n, sum(t * t) AS eta FROM (SELECT k, n, sum(e) OVER (PARTITION BY k ORDER BY i) AS t FROM c) GROUP BY 1, 2),
 g AS (SELECT a.k, a.i - b.i AS lag, sum(a.e * b.e) AS g FROM c a JOIN c b ON a.k = b.k AND b.i <= a.i GROUP BY 1, 2),
 h AS (SELECT s.k, s.n, s.eta, sum(CASE WHEN lag = 0 THEN g / s.n ELSE g / (s.n / 2.0) END) AS s0, sum(CASE WHEN lag > 0 THEN lag * g / (s.n / 2.0) ELSE 0 END) AS s1
   FROM s JOIN g ON g.k = s.k AND g.lag <= floor(pow(s.n, 2.0 / 9)) GROUP BY 1, 2, 3),
 b AS (SELECT *, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1) AS l FROM h)
SELECT b.k, n AS n_obs, {n("l")} AS n_lags, {r("max(eta) / (n * n * (sum(CASE WHEN lag = 0 THEN g ELSE 2 * (1 - lag / (l + 1)) * g END) / n))")} AS statistic
FROM b JOIN g ON g.k = b.k AND g.lag <= l GROUP BY b.k, n, l"""


@query("kpss_statistics", _KPSS)
def kpss_statistics(spark, folder):
    out = tsstats.kpss_test(P.brand_month_full(spark, folder), P.MONTHLY)
    return shown(out.select("k", "n_obs", "n_lags", "statistic"))


# A flat matrix of width m after predictor p has entered the regression.
_SWEEP = """list_transform(range(0, m * m), lambda x: CASE WHEN x // m = p AND x % m = p THEN 1 / g[p * m + p + 1] WHEN x // m = p THEN g[x + 1] / g[p * m + p + 1]
  WHEN x % m = p THEN -g[x + 1] / g[p * m + p + 1] ELSE g[x + 1] - g[x // m * m + p + 1] * g[p * m + x % m + 1] / g[p * m + p + 1] END)"""


def _products(rows: str) -> str:
    """Flat matrices g of width m per key, from rows (k, t, n, top, best, v) that hold a list of regressors and the target."""
    return f"""SELECT k, n, top, best, m, list(s ORDER BY i, j) AS g FROM (
   SELECT a.k, a.n, a.top, a.best, a.m, a.i, b.i AS j, sum(a.x * b.x) AS s FROM (SELECT k, t, n, top, best, len(v) AS m, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {rows}) a
   JOIN (SELECT k, t, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {rows}) b ON a.k = b.k AND a.t = b.t GROUP BY ALL) GROUP BY ALL"""


# Every lag order over common rows, then the one of smallest AIC over all of its own rows.
_ADF = f"""{_MONTHS}, p AS (SELECT k, y - avg(y) OVER (PARTITION BY k) AS l, row_number() OVER w - 1 AS t, lead(y) OVER w - y AS dy, count(*) OVER (PARTITION BY k) AS n FROM filled WINDOW w AS (PARTITION BY k ORDER BY d)),
 q AS (SELECT *, least(CAST(ceil(12 * pow(n / 100.0, 0.25)) AS BIGINT), n // 2 - 2) AS top FROM p WHERE dy IS NOT NULL),
 v AS (SELECT a.k, a.t, a.n, a.top, a.l, a.dy, coalesce(list(b.dy ORDER BY b.t DESC) FILTER (b.t IS NOT NULL), []) AS lags FROM q a LEFT JOIN q b ON a.k = b.k AND b.t BETWEEN a.t - a.top AND a.t - 1 GROUP BY ALL),
 v0 AS (SELECT k, t, n, top, 0 AS best, [1.0, l] || lags || [dy] AS v FROM v WHERE t >= top), g0 AS ({_products("v0")}),
 s0 AS (SELECT k, n, top, m, CAST(0 AS BIGINT) AS p, g FROM g0 UNION ALL SELECT k, n, top, m, p + 1, {_SWEEP} FROM s0 WHERE p < m - 1),
 aic AS (SELECT k, p - 2 AS lag, (n - 1 - top) * (ln(2 * pi() * g[m * m] / (n - 1 - top)) + 1) + 2 * p AS aic FROM s0 WHERE p >= 2),
 best AS (SELECT k, arg_min(lag, aic) AS best FROM aic GROUP BY k),
 v1 AS (SELECT v.k, t, n, top, best, [1.0, l] || lags[1:best] || [dy] AS v FROM v JOIN best ON best.k = v.k WHERE t >= best), g1 AS ({_products("v1")}),
 s1 AS (SELECT k, n, best, m, CAST(0 AS BIGINT) AS p, g FROM g1 UNION ALL SELECT k, n, best, m, p + 1, {_SWEEP} FROM s1 WHERE p < m - 1),
 adf AS (SELECT k, best AS used_lag, n - 1 - best AS n_obs, g[2 * m] / sqrt(g[m * m] / (n - 1 - best - best - 2) * g[m + 2]) AS statistic FROM s1 WHERE p = m - 1),
 verdict AS (SELECT *, -2.86154 - 2.8903 / n_obs - 4.234 / pow(n_obs, 2) - 40.040 / pow(n_obs, 3) AS c FROM adf)"""


@query("adf_tests", f"""{_ADF} SELECT k, {n("n_obs")} AS n_obs, {n("used_lag")} AS used_lag, {r("statistic", 5)} AS statistic, {r("c", 5)} AS critical_5pct, {n("statistic < c")} AS stationary FROM verdict""")
def adf_tests(spark, folder):
    out = tsstats.adf_test(P.brand_month_full(spark, folder), P.MONTHLY)
    return shown(out.select("k", "n_obs", "used_lag", "statistic", "critical_5pct", "stationary"), 5)


# Critical values of the KPSS test around a constant at 10, 5, 2.5 and 1 percent.
_KPSS_P = """CASE WHEN kpss <= 0.347 THEN 0.1 WHEN kpss <= 0.463 THEN 0.1 + (kpss - 0.347) * (0.05 - 0.1) / (0.463 - 0.347)
  WHEN kpss <= 0.574 THEN 0.05 + (kpss - 0.463) * (0.025 - 0.05) / (0.574 - 0.463) WHEN kpss <= 0.739 THEN 0.025 + (kpss - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END"""


@query(
    "kpss_p_values",
    f"""WITH kp AS ({_KPSS}) SELECT k, {r(_KPSS_P.replace("kpss", "statistic"), 5)} AS p_value, {n("statistic < 0.463")} AS stationary FROM kp""",
)
def kpss_p_values(spark, folder):
    out = tsstats.kpss_test(P.brand_month_full(spark, folder), P.MONTHLY)
    return shown(out.select("k", "p_value", "stationary"), 5)


@query(
    "stationarity_verdicts",
    f"""{_ADF}, kp AS (SELECT * FROM ({_KPSS}) z)
SELECT verdict.k, {r("verdict.statistic", 4)} AS adf_statistic, {r("kp.statistic", 4)} AS kpss_statistic,
 CASE WHEN verdict.statistic < c AND kp.statistic < 0.463 THEN 'stationary' WHEN verdict.statistic < c THEN 'difference-stationary' WHEN kp.statistic < 0.463 THEN 'trend-stationary' ELSE 'non-stationary' END AS verdict
FROM verdict JOIN kp ON kp.k = verdict.k""",
)
def stationarity_verdicts(spark, folder):
    out = tsstats.stationarity_report(P.brand_month_full(spark, folder), P.MONTHLY)
    return shown(out.select("k", "adf_statistic", "kpss_statistic", "verdict"), 4)


def _decomposed(extrapolate: bool) -> str:
    base = f"""{_MONTHS}, p AS (SELECT k, d, y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY k) AS n,
  CASE WHEN count(y) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
   (sum(y) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - (lag(y, 6) OVER w + lead(y, 6) OVER w) / 2) / 12 END AS t0 FROM filled WINDOW w AS (PARTITION BY k ORDER BY d))"""
    if extrapolate:
        base += """, q AS (SELECT p.*, CASE WHEN t0 IS NOT NULL THEN t0 WHEN i < 6 THEN h.s * i + h.c ELSE z.s * i + z.c END AS trend FROM p
  JOIN (SELECT k, regr_slope(t0, i) AS s, regr_intercept(t0, i) AS c FROM p WHERE t0 IS NOT NULL AND i < least(18, n - 7) GROUP BY k) h ON h.k = p.k
  JOIN (SELECT k, regr_slope(t0, i) AS s, regr_intercept(t0, i) AS c FROM p WHERE t0 IS NOT NULL AND i >= n - 19 AND i < n - 7 GROUP BY k) z ON z.k = p.k)"""
    else:
        base += ", q AS (SELECT *, t0 AS trend FROM p)"
    return base


def _decomposition(extrapolate: bool, op: str) -> str:
    comb = "y - trend" if op == "-" else "y / trend"
    seas = "m - avg(m) OVER (PARTITION BY k)" if op == "-" else "m / avg(m) OVER (PARTITION BY k)"
    res = "y - trend - seasonal" if op == "-" else "y / seasonal / trend"
    return f"""{_decomposed(extrapolate)}, sl AS (SELECT k, i % 12 AS slot, avg({comb}) AS m FROM q GROUP BY 1, 2), se AS (SELECT k, slot, {seas} AS seasonal FROM sl),
 dec AS (SELECT q.k, q.d, q.y, trend, seasonal, {res} AS resid FROM q JOIN se ON se.k = q.k AND se.slot = q.i % 12)"""


for _name, _model, _op, _ext in (("decomposition_additive", "additive", "-", True), ("decomposition_multiplicative_open", "multiplicative", "/", False)):

    @query(_name, f"""{_decomposition(_ext, _op)} SELECT k, {s("d")} AS d, {r("y")} AS y, {r("trend")} AS trend, {r("seasonal")} AS seasonal, {r("resid")} AS resid, {s("NULL")} AS error FROM dec""")
    def _decompose(spark, folder, model=_model, ext=_ext):
        return shown(tsstats.seasonal_decompose(P.brand_month_full(spark, folder), P.MONTHLY, 12, model, ext))


@query(
    "seasonal_strengths",
    f"""{_decomposition(True, "-")} SELECT k, {r("greatest(0, 1 - var_samp(resid) / var_samp(trend + resid))")} AS trend_strength,
 {r("greatest(0, 1 - var_samp(resid) / var_samp(seasonal + resid))")} AS seasonal_strength FROM dec GROUP BY k""",
)
def seasonal_strengths(spark, folder):
    dec = tsstats.seasonal_decompose(P.brand_month_full(spark, folder), P.MONTHLY, 12)
    return shown(tsstats.seasonal_strength(dec, P.MONTHLY))


@query("seasonally_adjusted", f"""{_decomposition(True, "-")} SELECT k, {s("d")} AS d, {r("y - seasonal")} AS adjusted FROM dec""")
def seasonally_adjusted(spark, folder):
    dec = tsstats.seasonal_decompose(P.brand_month_full(spark, folder), P.MONTHLY, 12)
    return shown(tsstats.seasonally_adjusted(dec, P.MONTHLY).select("k", "d", "adjusted"))


def _loess(src: str, span: int, beyond: int = 0) -> str:
    """Local lines of x over i per (k, c) of n values, at all positions a and ``beyond`` both ends: (k, c, a, f)."""
    return f"""SELECT k, c, a, any_value(n) AS n, sum(w * x) / sum(w) + CASE WHEN sqrt(greatest(sum(w * i * i) / sum(w) - pow(sum(w * i) / sum(w), 2), 0)) > 0.001 * (any_value(n) - 1)
   THEN (a - sum(w * i) / sum(w)) / (sum(w * i * i) / sum(w) - pow(sum(w * i) / sum(w), 2)) * (sum(w * i * x) / sum(w) - sum(w * i) / sum(w) * sum(w * x) / sum(w)) ELSE 0 END AS f
  FROM (SELECT z.k, z.c, z.n, a, i, x, CASE WHEN u <= 0.001 THEN 1 WHEN u < 0.999 THEN pow(1 - pow(u, 3), 3) ELSE 0 END AS w FROM (
   SELECT q.*, z.i, z.x, abs(z.i - a) / (greatest(a - first, first + span - 1 - a) + ({span} - span) // 2) AS u FROM (
    SELECT *, greatest(0, least(CAST(floor(a - (span - 1) / 2.0 + 0.5) AS BIGINT), n - span)) AS first FROM (
     SELECT k, c, n, least({span}, n) AS span, unnest(range(-{beyond}, n + {beyond})) AS a FROM (SELECT DISTINCT k, c, n FROM {src}))) q
   JOIN {src} z ON z.k = q.k AND z.c = q.c AND z.i BETWEEN first AND first + span - 1) z) GROUP BY k, c, a"""


def _stl_round(r_: int) -> str:
    after = lambda m: f"avg(f) OVER (PARTITION BY k ORDER BY q ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)"
    return f""", free{r_} AS MATERIALIZED (SELECT v.k, v.i % 12 AS c, v.i // 12 AS i, v.y - t.f AS x, count(*) OVER (PARTITION BY v.k, v.i % 12) AS n FROM v JOIN t{r_ - 1} t ON t.k = v.k AND t.a = v.i),
 cyc{r_} AS MATERIALIZED (SELECT z.k, (a + 1) * 12 + c AS q, f, len FROM ({_loess(f"free{r_}", 7, 1)}) z JOIN (SELECT k, count(*) AS len FROM v GROUP BY k) l ON l.k = z.k),
 one{r_} AS (SELECT k, q, len, {after(12)} AS f FROM cyc{r_} QUALIFY q <= len + 12), two{r_} AS (SELECT k, q, len, {after(12)} AS f FROM one{r_} QUALIFY q <= len + 1),
 low{r_} AS MATERIALIZED (SELECT k, 0 AS c, q AS i, len AS n, {after(3)} AS x FROM two{r_} QUALIFY q <= len - 1),
 sea{r_} AS MATERIALIZED (SELECT v.k, 0 AS c, v.i, v.n, v.y - (cyc.f - l.f) AS x, cyc.f - l.f AS s FROM v JOIN cyc{r_} cyc ON cyc.k = v.k AND cyc.q = v.i + 12 JOIN ({_loess(f"low{r_}", 13)}) l ON l.k = v.k AND l.a = v.i),
 t{r_} AS MATERIALIZED ({_loess(f"sea{r_}", 23)})"""


@query(
    "stl_decomposition",
    f"""{_MONTHS}, v AS (SELECT k, d, CAST(y AS DOUBLE) AS y, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM filled),
 t0 AS (SELECT k, i AS a, CAST(0 AS DOUBLE) AS f FROM v){"".join(map(_stl_round, range(1, 6)))}
SELECT v.k, {s("v.d")} AS d, {r("v.y", 3)} AS y, {r("t.f", 3)} AS trend, {r("z.s", 3)} AS seasonal, {r("v.y - t.f - z.s", 3)} AS resid, {s("NULL")} AS error FROM v JOIN t5 t ON t.k = v.k AND t.a = v.i JOIN sea5 z ON z.k = v.k AND z.i = v.i""",
)
def stl_decomposition(spark, folder):
    return shown(tsstats.stl_decompose(P.brand_month_full(spark, folder), P.MONTHLY, 12), 3)


@query(
    "interval_report",
    f"""{_BASE}, j AS (SELECT fc.model, t.y, fc.yhat AS f FROM test t JOIN fc ON fc.k = t.k AND fc.d = t.d),
 p AS (SELECT model, avg(greatest(0.1 * (y - f * 0.5), -0.9 * (y - f * 0.5))) AS a, avg(greatest(0.5 * (y - f), -0.5 * (y - f))) AS b,
  avg(greatest(0.9 * (y - f * 1.5), -0.1 * (y - f * 1.5))) AS c, avg(CAST(y BETWEEN f * 0.5 AND f * 1.5 AS INTEGER)) AS cov, avg(f * 1.5 - f * 0.5) AS w FROM j GROUP BY model)
SELECT model, {r("a")} AS pinball_0_10, {r("b")} AS pinball_0_50, {r("c")} AS pinball_0_90, {r("(a + b + c) / 3")} AS mean_pinball, {r("cov")} AS coverage, {r("w")} AS mean_width FROM p""",
)
def interval_report(spark, folder):
    train, test = _train_test(spark, folder)
    fc = FC.forecast_all(train, P.WEEKLY, HORIZON, SEASON, BASELINES)
    scored = scoring.align(test, fc, P.WEEKLY).filter("model IS NOT NULL").withColumns({"lo": F.col("yhat") * 0.5, "hi": F.col("yhat") * 1.5})
    return shown(scoring.probabilistic_report(scored, "y", {0.1: "lo", 0.5: "yhat", 0.9: "hi"}, ["model"]))


@query(
    "melted_columns",
    f"""SELECT o_orderkey, 'price' AS model, {r("o_totalprice")} AS yhat FROM orders
UNION ALL SELECT o_orderkey, 'customer', {r("o_custkey")} FROM orders""",
)
def melted_columns(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return shown(scoring.wide_to_long(orders, ["o_orderkey"], {"price": "o_totalprice", "customer": "o_custkey"}))
