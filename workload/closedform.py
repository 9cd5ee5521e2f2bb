"""Learned models in configurations that SQL can state: least squares on one or two lags, one split, residual quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import chartdata, explain, learners
from seriesloom.operators.features import FeatureBuilder
from workload import panels as P
from workload.pipelines import SUP, _split, _stored_panel
from workload.preparation import HL4
from workload.registry import n, query, r, s, shown

LAGS = FeatureBuilder(P.WEEKLY, lags=(1, 2), rolling_windows=(), ewm_halflives=())
STATE = FeatureBuilder(P.WEEKLY, lags=(1,), rolling_windows=(13,), rolling_stats=("mean", "skew", "kurt"), ewm_halflives=(4.0,), encode_keys=True)
OLS = {"objective": "least_squares"}

# Last 8 weeks: test; the 13 before: validation. Lags look back over all rows.
_ROWS = f"""{SUP}, e AS (SELECT max(d) AS hi FROM filled),
 x AS (SELECT k, d, CAST(y AS DOUBLE) AS y, CAST(lag(y) OVER w AS DOUBLE) AS l1, CAST(lag(y, 2) OVER w AS DOUBLE) AS l2, count(*) OVER (PARTITION BY k) AS n, row_number() OVER w AS i,
  CASE WHEN d > hi - 56 THEN 'test' WHEN d > hi - 147 THEN 'val' ELSE 'train' END AS part FROM filled, e WINDOW w AS (PARTITION BY k ORDER BY d)),
 line AS (SELECT regr_slope(y, l1) AS b, regr_intercept(y, l1) AS a FROM x WHERE part = 'train' AND l1 IS NOT NULL),
 last AS (SELECT k, max(d) AS d, arg_max(y, d) AS y, arg_max(l1, d) AS l1 FROM x WHERE part <> 'test' GROUP BY k)"""


@query(
    "least_squares_attributions",
    f"""{_ROWS}, m AS (SELECT avg(y) AS my, avg(l1) AS m1, avg(l2) AS m2, covar_pop(l1, l1) AS s11, covar_pop(l2, l2) AS s22, covar_pop(l1, l2) AS s12, covar_pop(l1, y) AS s1y, covar_pop(l2, y) AS s2y
  FROM x WHERE part = 'train' AND l2 IS NOT NULL),
 c AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m)
SELECT k, {s("d")} AS d, 'y_lag_' || j AS feature, {r("CASE WHEN j = 1 THEN l1 ELSE l2 END", 4)} AS value, {r("CASE WHEN j = 1 THEN b1 * (l1 - m1) ELSE b2 * (l2 - m2) END", 4)} AS contribution,
 {r("my", 4)} AS base_value, {r("my + b1 * (l1 - m1) + b2 * (l2 - m2)", 4)} AS link FROM x, c, range(1, 3) t(j) WHERE part = 'test'""",
)
def least_squares_attributions(spark, folder):
    rows = LAGS.transform(_split(spark, folder).frame)
    model = learners.PanelRegressor(LAGS, OLS, ["y_lag_1", "y_lag_2"]).fit(rows.filter("split = 'train' AND y_lag_2 IS NOT NULL"), "y")
    return shown(explain.linear_contributions(rows.filter("split = 'test'"), model, ["k", "d"]), 4)


@query(
    "least_squares_recursive",
    f"""{_ROWS}, f AS (SELECT k, d, CAST(0 AS BIGINT) AS h, y AS f FROM last UNION ALL SELECT k, d, h + 1, a + b * f FROM f, line WHERE h < 8)
SELECT k, {s("d + CAST(h * 7 AS INTEGER)")} AS d, {n("h")} AS horizon, {r("f", 4)} AS yhat FROM f WHERE h > 0""",
)
def least_squares_recursive(spark, folder):
    split = _split(spark, folder)
    known = split.frame.filter("split <> 'test'").drop("split")
    model = learners.RecursiveForecaster(LAGS, OLS, features=["y_lag_1"]).fit(split.train)
    return shown(model.predict_recursive(known, 8).select("k", "d", "horizon", "yhat"), 4)


@query(
    "least_squares_direct",
    f"""{_ROWS}, ahead AS (SELECT h, l1, lead(y, CAST(h AS INTEGER)) OVER w AS z, lead(part, CAST(h AS INTEGER)) OVER w AS p, part FROM x, range(1, 5) t(h) WINDOW w AS (PARTITION BY k, h ORDER BY d)),
 lines AS (SELECT h, regr_slope(z, l1) AS b, regr_intercept(z, l1) AS a FROM ahead WHERE part = 'train' AND p = 'train' AND l1 IS NOT NULL GROUP BY h)
SELECT k, {s("d + CAST(h * 7 AS INTEGER)")} AS d, {n("h")} AS horizon, {r("a + b * l1", 4)} AS yhat FROM last, lines WHERE l1 IS NOT NULL""",
)
def least_squares_direct(spark, folder):
    split = _split(spark, folder)
    known = split.frame.filter("split <> 'test'").drop("split")
    model = learners.DirectMultiHorizonForecaster(LAGS, range(1, 5), OLS, features=["y_lag_1"]).fit(split.train)
    two = known.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    return shown(model.predict(known.join(two, "k"), split.val_end).select("k", "d", "horizon", "yhat"), 4)


@query(
    "weighted_least_squares",
    f"""{_ROWS}, w AS (SELECT l1 AS x, y, CASE WHEN month(d) = 12 THEN 3.0 ELSE 1.0 END AS w FROM x WHERE part = 'train' AND l1 IS NOT NULL),
 m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w), c AS (SELECT sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b, any_value(mx) AS mx, any_value(my) AS my FROM w, m)
SELECT k, {s("d")} AS d, {r("my + b * (l1 - mx)", 4)} AS yhat FROM x, c WHERE part = 'test' AND l1 IS NOT NULL""",
)
def weighted_least_squares(spark, folder):
    rows = LAGS.transform(_split(spark, folder).frame).withColumn("w", F.when(F.month("d") == 12, 3.0).otherwise(1.0))
    model = learners.PanelRegressor(LAGS, OLS, ["y_lag_1"]).fit(rows.filter("split = 'train' AND y_lag_1 IS NOT NULL"), "y", weight="w")
    return shown(model.predict(rows.filter("split = 'test' AND y_lag_1 IS NOT NULL")).select("k", "d", "yhat"), 4)


@query(
    "one_split_forecast",
    f"""{_ROWS}, g AS (SELECT month(d) AS v, count(*) AS n, sum(y) AS s FROM x WHERE part = 'train' GROUP BY 1),
 cut AS (SELECT a.v, sum(g.n) FILTER (g.v <= a.v) AS nl, sum(g.s) FILTER (g.v <= a.v) AS sl, sum(g.n) FILTER (g.v > a.v) AS nr, sum(g.s) FILTER (g.v > a.v) AS sr FROM g a, g GROUP BY a.v),
 best AS (SELECT v, sl / nl AS lo, sr / nr AS hi FROM cut WHERE nr > 0 ORDER BY sl * sl / nl + sr * sr / nr DESC LIMIT 1)
SELECT k, {s("d")} AS d, {r("CASE WHEN month(d) <= v THEN lo ELSE hi END", 4)} AS yhat FROM x, best WHERE part = 'test'""",
)
def one_split_forecast(spark, folder):
    """One boosting round of depth one: the split of least squared error on the month."""
    rows = LAGS.transform(_split(spark, folder).frame)
    params = {"objective": "regression", "max_iter": 1, "max_depth": 1, "subsample": 1.0, "min_rows": 1, "max_bins": 32}
    model = learners.PanelRegressor(LAGS, params, ["month"]).fit(rows.filter("split = 'train'"), "y")
    return shown(model.predict(rows.filter("split = 'test'")).select("k", "d", "yhat"), 4)


@query(
    "least_squares_bands",
    f"""{_ROWS}, off AS (SELECT list_sort(list(y - a - b * l1)) AS o FROM x, line WHERE part = 'val' AND l1 IS NOT NULL),
 q AS (SELECT o[CAST(ceil(len(o) * 0.1) AS BIGINT)] AS q1, o[CAST(ceil(len(o) * 0.5) AS BIGINT)] AS q5, o[CAST(ceil(len(o) * 0.9) AS BIGINT)] AS q9 FROM off)
SELECT k, {s("d")} AS d, {r("a + b * l1 + q1", 4)} AS lower, {r("a + b * l1 + q5", 4)} AS q0_50, {r("a + b * l1 + q9", 4)} AS upper FROM x, line, q WHERE part = 'test' AND l1 IS NOT NULL""",
)
def least_squares_bands(spark, folder):
    """Quantiles of the validation errors around the forecast, one step ahead."""
    split = _split(spark, folder)
    # A key's first row has no lag; it would enter with the mean.
    rows = LAGS.transform(split.frame).filter("y_lag_1 IS NOT NULL").select("k", "d", "split")
    keep = lambda part: split.part(part).join(rows.filter(F.col("split") == part).drop("split"), ["k", "d"], "left_semi")
    model = learners.QuantileForecaster(LAGS, (0.1, 0.5, 0.9), OLS, features=["y_lag_1"]).fit(split.train, split.val)
    known = split.frame.filter("split <> 'test'").drop("split")
    made = model.predict(keep("test"), known)
    return shown(chartdata.quantile_bands(made, ["k", "d", "q0_50"], ["q0_10", "q0_50", "q0_90"]).select("k", "d", "lower", "q0_50", "upper"), 4)


@query(
    "least_squares_out_of_fold",
    f"""{_ROWS}, b AS (SELECT min(d) AS lo, max(d) - min(d) + 1 AS days FROM x WHERE l1 IS NOT NULL), z AS (SELECT k, d, y, l1, least((d - lo) * 3 // days, 2) AS fold FROM x, b WHERE l1 IS NOT NULL),
 c AS (SELECT f AS fold, regr_slope(sqrt(y), l1) AS b, regr_intercept(sqrt(y), l1) AS a FROM z, range(3) t(f) WHERE fold <> f GROUP BY f)
SELECT k, {s("d")} AS d, {n("z.fold")} AS fold, {r("y")} AS y, {r("pow(greatest(a + b * l1, 0), 2)", 4)} AS yhat FROM z JOIN c ON c.fold = z.fold""",
)
def least_squares_out_of_fold(spark, folder):
    rows = LAGS.transform(_stored_panel(spark, folder)).filter("y_lag_1 IS NOT NULL")
    oof, _ = learners.cross_validated_predictions(rows, LAGS, "y", ["k", "d"], 3, OLS, features=["y_lag_1"])
    return shown(oof.select("k", "d", "fold", "y", "yhat"), 4)


@query(
    "rollout_features",
    f"""{_ROWS}, f AS (SELECT k, d, CAST(0 AS BIGINT) AS h, y AS f FROM last UNION ALL SELECT k, d, h + 1, a + b * f FROM f, line WHERE h < 8),
 whole AS (SELECT k, d, y, CAST(0 AS BIGINT) AS h FROM x WHERE part <> 'test' UNION ALL SELECT k, d + CAST(h * 7 AS INTEGER), f, h FROM f WHERE h > 0),
 o AS (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d) AS i, lag(y) OVER (PARTITION BY k ORDER BY d) AS prev FROM whole),
 ew AS (SELECT k, i, d, CAST(NULL AS DOUBLE) AS m FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, o.d, CASE WHEN ew.m IS NULL THEN o.prev ELSE (1 - {HL4!r}) * ew.m + {HL4!r} * o.prev END FROM ew JOIN o ON o.k = ew.k AND o.i = ew.i + 1),
 g AS (SELECT k, d, y, h, count(y) OVER w AS n, avg(y) OVER w AS mu, skewness(y) OVER w AS sk, kurtosis(y) OVER w AS ku, var_pop(y) OVER w AS v FROM whole WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)),
 codes AS (SELECT k, row_number() OVER (ORDER BY CAST(k AS VARCHAR)) - 1 AS code FROM (SELECT DISTINCT k FROM x WHERE part = 'train'))
SELECT g.k, {s("g.d")} AS d, {n("g.h")} AS horizon, {r("g.y", 4)} AS yhat, {r("g.mu", 4)} AS y_roll_mean_13, {r("CASE WHEN g.n > 2 THEN CASE WHEN g.v > 0 THEN g.sk ELSE 0 END END", 4)} AS y_roll_skew_13,
 {r("CASE WHEN g.n > 3 THEN CASE WHEN g.v > 0 THEN g.ku ELSE -3 END END", 4)} AS y_roll_kurt_13, {r("ew.m", 4)} AS y_ewm_hl4, {r("coalesce(c.code, -1)", 4)} AS k_code
FROM g JOIN ew ON ew.k = g.k AND ew.d = g.d LEFT JOIN codes c ON c.k = g.k WHERE g.h > 0""",
)
def rollout_features(spark, folder):
    """Features at every step of a roll-out equal those of the panel completed with the forecasts; codes are the training rows'."""
    split = _split(spark, folder)
    known = split.frame.filter("split <> 'test'").drop("split")
    model = learners.RecursiveForecaster(STATE, OLS, features=["y_lag_1"]).fit(split.train)
    seen = ["y_roll_mean_13", "y_roll_skew_13", "y_roll_kurt_13", "y_ewm_hl4", "k_code"]
    return shown(model.predict_recursive(known, 8, show=seen).select("k", "d", "horizon", "yhat", *seen), 4)
