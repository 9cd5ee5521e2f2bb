"""Imputation, outliers, window and calendar features, transforms, encodings, joins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seriesloom.functions import calendar as C
from seriesloom.operators import encode, impute, outliers, select, transforms, windows
from seriesloom.operators.grid import extend_to_last_date, future_dates, keys_by_dates
from seriesloom.operators.recurrence import add_ewm_features, long_ema
from seriesloom.spec import PanelSpec
from workload import panels as P
from workload.registry import n, query, r, s, shown, table

GAPPY = P.with_grid(P.USER_TYPE_DAY, "1 DAY", "k, t", None)
W = "PARTITION BY k, t ORDER BY d"
PREV = f"last_value(y IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
NEXT = f"first_value(y IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _gappy(spark, folder):
    return P.user_type_day_filled(spark, folder)


def _imputed(method: str, sql: str, name: str | None = None, **options):
    @query(name or f"impute_{method}", f"{GAPPY} SELECT k, t, {s('d')} AS d, {r(sql)} AS y FROM filled")
    def run(spark, folder):
        out = impute.impute_missing(_gappy(spark, folder), P.DAILY_BY_TYPE, "y", method, **options)
        return shown(out.select("k", "t", "d", "y"))

    return run


_imputed("mean", "coalesce(y, avg(y) OVER (PARTITION BY k, t))")
_imputed("median", "coalesce(y, quantile_cont(y, 0.5) OVER (PARTITION BY k, t))")
_imputed("mean", "coalesce(y, (SELECT avg(y) FROM filled))", "impute_global_mean", group=False)
_imputed("median", "coalesce(y, (SELECT quantile_cont(y, 0.5) FROM filled))", "impute_global_median", group=False)
_imputed("zero", "coalesce(y, 0)")
_imputed("constant", "coalesce(y, 1.5)", constant_value=1.5)
_imputed("ffill", PREV)
_imputed("bfill", NEXT)
_imputed("rolling_mean", f"coalesce(y, avg(y) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))")
_imputed("rolling_median", f"coalesce(y, quantile_cont(y, 0.5) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))")


@query(
    "impute_mode",
    f"""{GAPPY}, c AS (SELECT k, t, floor(y / 20) * 20 AS v, count(*) AS n FROM filled WHERE y IS NOT NULL GROUP BY 1, 2, 3),
 m AS (SELECT *, row_number() OVER (PARTITION BY k, t ORDER BY n DESC, v) AS rn FROM c)
SELECT f.k, f.t, {s("f.d")} AS d, {r("coalesce(floor(f.y / 20) * 20, m.v)")} AS y FROM filled f LEFT JOIN m ON f.k = m.k AND f.t = m.t AND m.rn = 1""",
)
def impute_mode(spark, folder):
    coarse = _gappy(spark, folder).withColumn("y", (F.floor(F.col("y") / 20) * 20).cast("double"))
    return shown(impute.impute_missing(coarse, P.DAILY_BY_TYPE, "y", "mode").select("k", "t", "d", "y"))


def _line(at: str) -> str:
    return f"""{GAPPY}, x AS (SELECT *, {at} AS a FROM filled),
 b AS (SELECT *, {PREV} AS y0, {NEXT} AS y1,
  max(CASE WHEN y IS NOT NULL THEN a END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a0,
  min(CASE WHEN y IS NOT NULL THEN a END) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a1 FROM x)
SELECT k, t, {s("d")} AS d, {r("coalesce(y, y0 + (y1 - y0) * (a - a0) / CAST(nullif(a1 - a0, 0) AS DOUBLE), y0, y1)")} AS y FROM b"""


@query("impute_linear", _line(f"row_number() OVER ({W})"))
def impute_linear(spark, folder):
    return shown(impute.impute_missing(_gappy(spark, folder), P.DAILY_BY_TYPE, "y", "linear").select("k", "t", "d", "y"))


@query("impute_time", _line("epoch(d)"))
def impute_time(spark, folder):
    return shown(impute.impute_missing(_gappy(spark, folder), P.DAILY_BY_TYPE, "y", "time").select("k", "t", "d", "y"))


@query(
    "impute_seasonal_naive",
    f"""{GAPPY}, l AS (SELECT k, t, d, coalesce(y, lag(y, 7) OVER ({W})) AS y FROM filled)
SELECT k, t, {s("d")} AS d, {r(f"coalesce({PREV}, {NEXT})")} AS y FROM l""",
)
def impute_seasonal_naive(spark, folder):
    out = impute.impute_missing(_gappy(spark, folder), P.DAILY_BY_TYPE, "y", "seasonal_naive_7")
    return shown(out.select("k", "t", "d", "y"))


@query(
    "static_fill",
    f"""{GAPPY}, z AS (SELECT k, t, d, CASE WHEN extract(day FROM d) % 2 = 0 THEN x END AS y FROM filled)
SELECT k, t, {s("d")} AS d, {n(PREV)} AS f, {n(NEXT)} AS b, {n(f"coalesce({PREV}, {NEXT})")} AS fb FROM z""",
)
def static_fill(spark, folder):
    sparse = F.when(F.day("d") % 2 == 0, F.col("x"))
    base = _gappy(spark, folder).select("k", "t", "d", "y", *[sparse.alias(c) for c in ("f", "b", "fb")])
    spec = P.DAILY_BY_TYPE
    out = impute.ffill_static(base, spec, ["f"])
    out = impute.bfill_static(out, spec, ["b"])
    return shown(impute.ffill_bfill_static(out, spec, ["fb"]).drop("y"))


@query(
    "imputer_comparison",
    f"""WITH panel AS ({P.BRAND_DAY}), p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS i FROM panel),
 m AS (SELECT k, d, y AS truth, i, i >= 100 AND i < 130 AS hid, CASE WHEN NOT (i >= 100 AND i < 130) THEN y END AS y FROM p),
 f AS (SELECT *, coalesce(y, avg(y) OVER (PARTITION BY k)) AS mean, coalesce(y, quantile_cont(y, 0.5) OVER (PARTITION BY k)) AS median,
  last_value(y IGNORE NULLS) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill,
  first_value(y IGNORE NULLS) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM m),
 l AS (SELECT *, coalesce(ffill + (nxt - ffill) * (i - 99) / 31.0, ffill) AS linear FROM f),
 u AS (SELECT 'mean' AS method, truth - mean AS e FROM l WHERE hid UNION ALL SELECT 'median', truth - median FROM l WHERE hid
  UNION ALL SELECT 'ffill', truth - ffill FROM l WHERE hid UNION ALL SELECT 'linear', truth - linear FROM l WHERE hid)
SELECT method, count(*) AS n, {r("avg(abs(e))")} AS mae, {r("sqrt(avg(e * e))")} AS rmse FROM u GROUP BY 1""",
)
def imputer_comparison(spark, folder):
    return shown(impute.compare_imputers(P.brand_day(spark, folder), P.DAILY, "y", ["mean", "median", "ffill", "linear"], 100, 30))


# --- outliers --------------------------------------------------------------------------

FLAGS = f"""WITH panel AS ({P.BRAND_DAY}),
 q AS (SELECT *, quantile_cont(y, 0.25) OVER w AS q1, quantile_cont(y, 0.75) OVER w AS q3, quantile_cont(y, 0.5) OVER w AS med,
  avg(y) OVER w AS mu, stddev_samp(y) OVER w AS sd FROM panel WINDOW w AS (PARTITION BY k)),
 m AS (SELECT *, quantile_cont(abs(y - med), 0.5) OVER (PARTITION BY k) AS mad FROM q),
 flags AS (SELECT *, y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) AS f_iqr,
  coalesce(abs(y - mu) / nullif(sd, 0) > 3, false) AS f_z, coalesce(0.6745 * abs(y - med) / nullif(mad, 0) > 3.5, false) AS f_mz FROM m)"""


@query(
    "outlier_rows",
    f"""{FLAGS} SELECT k, {s("d")} AS d, {r("y")} AS y, {n("f_iqr")} AS iqr, {n("f_z")} AS zscore, {n("f_mz")} AS modified
FROM flags WHERE f_iqr OR f_z OR f_mz""",
)
def outlier_rows(spark, folder):
    df = P.brand_day(spark, folder)
    for name, detect in (("iqr", outliers.detect_outliers_iqr), ("zscore", outliers.detect_outliers_zscore), ("modified", outliers.detect_outliers_modified_zscore)):
        df = detect(df, P.DAILY, "y", name)
    return shown(df.filter("iqr OR zscore OR modified"))


@query(
    "outlier_counts",
    f"""{FLAGS} SELECT k, count(*) AS n_obs, count(*) FILTER (f_iqr) AS n_outliers, {r("count(*) FILTER (f_iqr) * 100.0 / count(*)")} AS outlier_pct FROM flags GROUP BY k""",
)
def outlier_counts(spark, folder):
    return shown(outliers.outlier_summary(P.brand_day(spark, folder), P.DAILY, "iqr"))


@query(
    "outlier_method_comparison",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS method, count(*) FILTER ({f}) AS n_outliers, {r(f"count(*) FILTER ({f}) * 100.0 / count(*)")} AS outlier_pct FROM flags"""
        for m, f in (("iqr", "f_iqr"), ("zscore", "f_z"), ("modified_zscore", "f_mz"))
    ).join([FLAGS + " ", ""]),
)
def outlier_method_comparison(spark, folder):
    return shown(outliers.compare_detectors(P.brand_day(spark, folder), P.DAILY))


@query(
    "winsorized_by_key",
    f"""WITH panel AS ({P.BRAND_DAY}) SELECT k, {s("d")} AS d,
 {r("least(greatest(y, quantile_cont(y, 0.01) OVER (PARTITION BY k)), quantile_cont(y, 0.99) OVER (PARTITION BY k))")} AS y FROM panel""",
)
def winsorized_by_key(spark, folder):
    return shown(outliers.winsorize(P.brand_day(spark, folder), P.DAILY, "y"))


@query(
    "winsorized_globally",
    f"""WITH panel AS ({P.BRAND_DAY}), b AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM panel)
SELECT k, {s("d")} AS d, {r("least(greatest(y, lo), hi)")} AS y FROM panel, b""",
)
def winsorized_globally(spark, folder):
    return shown(outliers.winsorize(P.brand_day(spark, folder), P.DAILY, "y", group=False))


@query(
    "outliers_replaced",
    f"""{FLAGS} SELECT k, {s("d")} AS d, {r("CASE WHEN f_mz THEN mu ELSE y END")} AS by_mean, {r("CASE WHEN f_mz THEN med ELSE y END")} AS by_median FROM flags""",
)
def outliers_replaced(spark, folder):
    df = P.brand_day(spark, folder).select("k", "d", F.col("y").alias("by_mean"), F.col("y").alias("by_median"))
    detect = outliers.detect_outliers_modified_zscore
    df = outliers.replace_outliers_with(df, P.DAILY, "by_mean", detect, "mean")
    return shown(outliers.replace_outliers_with(df, P.DAILY, "by_median", detect, "median"))


@query(
    "outliers_reimputed_effect",
    f"""{FLAGS}, x AS (SELECT k, d, y AS before, CASE WHEN NOT f_iqr THEN y END AS y, row_number() OVER (PARTITION BY k ORDER BY d) AS a FROM flags),
 b AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y0,
  first_value(y IGNORE NULLS) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y1,
  max(CASE WHEN y IS NOT NULL THEN a END) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a0,
  min(CASE WHEN y IS NOT NULL THEN a END) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a1 FROM x),
 z AS (SELECT before, coalesce(y, y0 + (y1 - y0) * (a - a0) / CAST(nullif(a1 - a0, 0) AS DOUBLE), y0, y1) AS after FROM b)
SELECT count(*) AS n_rows, count(*) FILTER (before <> after) AS n_changed, {r("avg(abs(after - before))")} AS mean_abs_change FROM z""",
)
def outliers_reimputed_effect(spark, folder):
    df = P.brand_day(spark, folder).withColumn("before", F.col("y"))
    return shown(outliers.treatment_effect(outliers.reimpute_outliers(df, P.DAILY, "y"), "before", "y"))


# --- window features -------------------------------------------------------------------

SUP = P.with_grid(P.SUPPLIER_WEEK)


def _roll(stat: str, size: int, shift: int = 1) -> str:
    f = {"mean": "avg(y)", "std": "stddev_samp(y)", "min": "min(y)", "max": "max(y)", "median": "quantile_cont(y, 0.5)", "sum": "sum(y)", "var": "var_samp(y)"}[stat]
    return f"{f} OVER (PARTITION BY k ORDER BY d ROWS BETWEEN {shift + size - 1} PRECEDING AND {shift} PRECEDING)"


@query(
    "lag_and_rolling_features",
    f"{SUP} SELECT k, {s('d')} AS d, "
    + ", ".join(f"{r(f'lag(y, {k}) OVER (PARTITION BY k ORDER BY d)')} AS y_lag_{k}" for k in (1, 4, 13, 52))
    + ", "
    + ", ".join(f"{r(_roll(a, b))} AS y_roll_{a}_{b}" for b in (4, 13) for a in ("mean", "std", "min", "max", "median", "sum", "var"))
    + " FROM filled",
)
def lag_and_rolling_features(spark, folder):
    df = P.supplier_week_full(spark, folder)
    df = windows.add_lag_features(df, P.WEEKLY, lags=(1, 4, 13, 52))
    df = windows.add_rolling_features(df, P.WEEKLY, windows=(4, 13), stats=("mean", "std", "min", "max", "median", "sum", "var"))
    return shown(df.drop("y"))


@query(
    "rolling_shape_features",
    f"""{SUP}, c AS (SELECT *, count(y) OVER w AS n, skewness(y) OVER w AS sk, kurtosis(y) OVER w AS ku, var_pop(y) OVER w AS v
 FROM filled WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 27 PRECEDING AND 2 PRECEDING))
SELECT k, {s("d")} AS d, {r("CASE WHEN n >= 10 THEN CASE WHEN v > 0 THEN sk ELSE 0 END END", 5)} AS y_roll_skew_26, {r("CASE WHEN n >= 10 THEN CASE WHEN v > 0 THEN ku ELSE -3 END END", 5)} AS y_roll_kurt_26 FROM c""",
)
def rolling_shape_features(spark, folder):
    df = windows.add_rolling_features(P.supplier_week_full(spark, folder), P.WEEKLY, windows=(26,), stats=("skew", "kurt"), shift=2, min_periods=10)
    return shown(df.drop("y"), 5)


@query(
    "rolling_features_by_blocks",
    f"""{P.with_grid(P.PART_WEEK)}, f AS (SELECT k, d, lag(y, 4) OVER (PARTITION BY k ORDER BY d) AS lag4, {_roll("mean", 13)} AS mean13 FROM filled)
SELECT k, count(*) AS n, {r("sum(lag4 * (d - DATE '1990-01-01'))", 3)} AS lag_sum, {r("sum(mean13 * (d - DATE '1990-01-01'))", 3)} AS mean_sum FROM f GROUP BY k""",
)
def rolling_features_by_blocks(spark, folder):
    full = P.complete_panel(P.part_week(spark, folder), P.WEEKLY)

    def build(df, spec):
        return windows.add_rolling_features(windows.add_lag_features(df, spec, lags=(4,)), spec, windows=(13,), stats=("mean",))

    age = F.datediff("d", F.lit("1990-01-01").cast("date"))
    out = windows.by_blocks(full, P.WEEKLY, 13, 104, build)
    return shown(
        out.groupBy("k").agg(
            F.count("*").alias("n"), F.sum(F.col("y_lag_4") * age).alias("lag_sum"), F.sum(F.col("y_roll_mean_13") * age).alias("mean_sum")
        ),
        3,
    )


def _ewm_sql(alpha: str, source: str = "prev") -> str:
    return f"""e AS (SELECT k, i, d, prev, CAST(NULL AS DOUBLE) AS m FROM o WHERE i = 1
  UNION ALL SELECT o.k, o.i, o.d, o.prev, CASE WHEN e.m IS NULL THEN o.prev ELSE (1 - {alpha}) * e.m + {alpha} * o.prev END
  FROM e JOIN o ON o.k = e.k AND o.i = e.i + 1)"""


HL4 = 1.0 - math.exp(-math.log(2.0) / 4.0)


@query(
    "ewm_features",
    f"""{SUP}, o AS (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d) AS i, lag(y) OVER (PARTITION BY k ORDER BY d) AS prev FROM filled),
 {_ewm_sql(repr(HL4))} SELECT k, {s("d")} AS d, {r("m")} AS y_ewm_hl4 FROM e""",
)
def ewm_features(spark, folder):
    return shown(add_ewm_features(P.supplier_week_full(spark, folder), P.WEEKLY, halflives=(4.0,)).drop("y"))


@query(
    "ewm_of_gappy_series",
    f"""{GAPPY}, o AS (SELECT k, t, d, y, row_number() OVER ({W}) AS i, count(y) OVER ({W}) AS c FROM filled),
 v AS (SELECT k, t, i, y, i - lag(i) OVER (PARTITION BY k, t ORDER BY i) AS gap, row_number() OVER (PARTITION BY k, t ORDER BY i) AS j FROM o WHERE y IS NOT NULL),
 e AS (SELECT k, t, j, y AS m FROM v WHERE j = 1
  UNION ALL SELECT v.k, v.t, v.j, (pow(0.8, v.gap) * e.m + 0.2 * v.y) / (pow(0.8, v.gap) + 0.2) FROM e JOIN v ON v.k = e.k AND v.t = e.t AND v.j = e.j + 1)
SELECT o.k, o.t, {s("o.d")} AS d, {r("e.m")} AS m FROM o LEFT JOIN e ON o.k = e.k AND o.t = e.t AND o.c = e.j""",
)
def ewm_of_gappy_series(spark, folder):
    from seriesloom.operators.recurrence import ewm_mean

    out = ewm_mean(_gappy(spark, folder), P.DAILY_BY_TYPE, F.col("y"), 0.2, "m")
    return shown(out.select("k", "t", "d", "m"))


@query(
    "long_average_demand",
    f"""{SUP}, o AS (SELECT k, d, y, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM filled)
SELECT a.k, {s("a.d")} AS d, {r("sum(b.y * pow(1 - 1.0 / 56, a.i - b.i)) / sum(pow(1 - 1.0 / 56, a.i - b.i))")} AS ema
FROM o a JOIN o b ON a.k = b.k AND b.i <= a.i GROUP BY a.k, a.d""",
)
def long_average_demand(spark, folder):
    return shown(long_ema(P.supplier_week_full(spark, folder), P.WEEKLY, "y", 1 / 56, "ema").drop("y"))


@query(
    "time_range_features",
    f"""WITH panel AS ({P.BRAND_DAY}) SELECT k, {s("d")} AS d,
 count(*) OVER (PARTITION BY k ORDER BY d RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS days_seen,
 {r("avg(y) OVER (PARTITION BY k ORDER BY d RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW)")} AS mean_14d FROM panel""",
)
def time_range_features(spark, folder):
    out = windows.add_time_range_features(
        P.brand_day(spark, folder), ["k"], "d", {"days_seen": ("d", "count", -28, -1), "mean_14d": ("y", "mean", -13, 0)}
    )
    return shown(out.drop("y"))


@query(
    "differences_and_leads",
    f"""{SUP}, a AS (SELECT k, d, y, y - lag(y) OVER w AS d1, y - lag(y, 52) OVER w AS d52, lead(y, 4) OVER w AS lead4, row_number() OVER w - 1 AS i FROM filled WINDOW w AS (PARTITION BY k ORDER BY d))
SELECT k, {s("d")} AS d, {r("d1")} AS d1, {r("d52")} AS d52, {r("d1 - lag(d1, 52) OVER (PARTITION BY k ORDER BY d)")} AS d1_52, {r("lead4")} AS lead4,
 {n("i // 52")} AS cycle, {n("i % 52")} AS position FROM a""",
)
def differences_and_leads(spark, folder):
    df, spec = P.supplier_week_full(spark, folder), P.WEEKLY
    for name, lags in (("d1", (1,)), ("d52", (52,)), ("d1_52", (1, 52))):
        df = windows.difference(df, spec, "y", lags, name)
    cycle, position = windows.cycle_position(spec, 52)
    return shown(df.withColumns({"lead4": windows.lead_target(spec, 4), "cycle": cycle, "position": position}).drop("y"))


@query(
    "rolling_statistics",
    f"""{SUP} SELECT k, {s("d")} AS d, {r("CASE WHEN count(y) OVER w = 12 THEN avg(y) OVER w END")} AS rolling_mean,
 {r("CASE WHEN count(y) OVER w = 12 THEN stddev_samp(y) OVER w END")} AS rolling_std FROM filled WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
)
def rolling_statistics(spark, folder):
    return shown(windows.rolling_statistics(P.supplier_week_full(spark, folder), P.WEEKLY, 12).drop("y"))


@query(
    "lag_pairs",
    " UNION ALL ".join(f"SELECT k, {s('d')} AS d, {k} AS lag, {r(f'lag(y, {k}) OVER (PARTITION BY k ORDER BY d)')} AS y_before, {r('y')} AS y_now FROM filled" for k in (1, 2)).join([P.with_grid(P.BRAND_MONTH, "1 MONTH") + " ", ""]).replace("1 AS lag", "CAST(1 AS BIGINT) AS lag").replace("2 AS lag", "CAST(2 AS BIGINT) AS lag"),
)
def lag_pairs(spark, folder):
    return shown(windows.lag_pairs(P.brand_month_full(spark, folder), P.MONTHLY, (1, 2)))


@query(
    "leaking_and_causal_mean",
    f"""{SUP} SELECT k, {s("d")} AS d, {r(_roll("mean", 7, 0))} AS leaking, {r(_roll("mean", 7, 1))} AS causal FROM filled""",
)
def leaking_and_causal_mean(spark, folder):
    df = P.supplier_week_full(spark, folder)
    cols = {"leaking": 0, "causal": 1}
    built = {k: next(iter(windows.rolling_columns(P.WEEKLY, "y", (7,), ("mean",), v).values())) for k, v in cols.items()}
    return shown(df.withColumns(built).drop("y"))


# --- grids, calendar -------------------------------------------------------------------


@query(
    "grid_to_global_end",
    f"""WITH panel AS ({P.CUSTOMER_WEEK}), e AS (SELECT max(d) AS hi FROM panel),
 g AS (SELECT k, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS d FROM (SELECT k, min(d) AS lo FROM panel GROUP BY k), e)
SELECT g.k, {s("max(g.d)")} AS d, count(*) AS n, {r("sum(coalesce(p.y, 0))", 2)} AS y FROM g LEFT JOIN panel p ON g.k = p.k AND g.d = p.d GROUP BY g.k""",
)
def grid_to_global_end(spark, folder):
    full = extend_to_last_date(P.customer_week(spark, folder), P.WEEKLY, fill_value=0.0)
    return shown(full.groupBy("k").agg(F.max("d").alias("d"), F.count("*").alias("n"), F.sum("y").alias("y")), 2)


@query(
    "future_periods",
    f"""WITH panel AS ({P.BRAND_MONTH}), l AS (SELECT k, max(d) AS hi FROM panel GROUP BY k)
SELECT k, {n("h")} AS horizon, {s("CAST(hi + h * INTERVAL 1 MONTH AS DATE)")} AS d FROM l, range(1, 13) t(h)""",
)
def future_periods(spark, folder):
    return shown(future_dates(P.brand_month(spark, folder), P.MONTHLY, 12))


@query(
    "keys_by_dates",
    "SELECT k, d FROM (SELECT DISTINCT user_id AS k FROM events), (VALUES ('2024-02-01'), ('2024-02-02'), ('2024-02-05')) t(d)",
)
def keys_with_dates(spark, folder):
    return shown(keys_by_dates(P.user_day(spark, folder), P.DAILY, ["2024-02-01", "2024-02-02", "2024-02-05"]))


@query(
    "calendar_features",
    f"""WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT {s("d")} AS d, {n("year(d)")} AS year, {n("quarter(d)")} AS quarter, {n("month(d)")} AS month, {n("weekofyear(d)")} AS week, {n("day(d)")} AS day,
 {n("isodow(d) - 1")} AS dayofweek, {n("dayofyear(d)")} AS dayofyear, {n("isodow(d) >= 6")} AS is_weekend, {n("day(d) = 1")} AS is_month_start,
 {n("d = last_day(d)")} AS is_month_end, {n("day(d) = 1 AND month(d) % 3 = 1")} AS is_quarter_start, {n("d = last_day(d) AND month(d) % 3 = 0")} AS is_quarter_end,
 {n("day(d) = 1 AND month(d) = 1")} AS is_year_start, {n("d = last_day(d) AND month(d) = 12")} AS is_year_end,
 {r("sin(2 * pi() * month(d) / 12)")} AS month_sin, {r("cos(2 * pi() * month(d) / 12)")} AS month_cos,
 {r("sin(2 * pi() * (isodow(d) - 1) / 7)")} AS dayofweek_sin, {r("cos(2 * pi() * (isodow(d) - 1) / 7)")} AS dayofweek_cos,
 {r("sin(2 * pi() * dayofyear(d) / 365)")} AS dayofyear_sin, {r("cos(2 * pi() * dayofyear(d) / 365)")} AS dayofyear_cos FROM x""",
)
def calendar_features(spark, folder):
    days = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return shown(C.add_date_features(days, PanelSpec("d", "", ())))


@query(
    "forecasting_calendar_features",
    f"""WITH x AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT {s("d")} AS d, {n("year(d)")} AS year, {n("quarter(d)")} AS quarter, {n("month(d)")} AS month, {n("weekofyear(d)")} AS week, {n("day(d)")} AS day,
 {n("isodow(d) - 1")} AS day_of_week, {n("dayofyear(d)")} AS day_of_year, {n("isodow(d) >= 6")} AS is_weekend, {n("day(d) = 1")} AS is_month_start,
 {n("d = last_day(d)")} AS is_month_end, {n("d = last_day(d) AND month(d) % 3 = 0")} AS is_quarter_end,
 {r("sin(2 * pi() * (isodow(d) - 1) / 7)")} AS dow_sin, {r("cos(2 * pi() * (isodow(d) - 1) / 7)")} AS dow_cos,
 {r("sin(2 * pi() * month(d) / 12)")} AS month_sin, {r("cos(2 * pi() * month(d) / 12)")} AS month_cos,
 {r("sin(2 * pi() * dayofyear(d) / 365.25)")} AS doy_sin, {r("cos(2 * pi() * dayofyear(d) / 365.25)")} AS doy_cos,
 {n("d - DATE '2020-01-01'")} AS days_since_2020, dayname(d) AS day_name, strftime(d, '%b') AS month_name FROM x""",
)
def forecasting_calendar_features(spark, folder):
    days = table(spark, folder, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    out = C.add_calendar_features(days, "d").withColumns(
        {"days_since_2020": C.days_since("d", "2020-01-01"), "day_name": C.day_name("d"), "month_name": C.month_abbreviation("d")}
    )
    return shown(out)


@query(
    "season_lengths",
    f"""WITH p AS ({P.SUPPLIER_WEEK}),
 s AS (SELECT k, d - lag(d) OVER (PARTITION BY k ORDER BY d) AS st FROM p),
 c AS (SELECT k, st, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, st) AS rn FROM s WHERE st > 0 GROUP BY k, st)
SELECT k, {n("st")} AS step_days, {n("CASE WHEN st = 1 THEN 7 WHEN st = 7 THEN 52 WHEN st BETWEEN 28 AND 31 THEN 12 WHEN st BETWEEN 89 AND 92 THEN 4 ELSE 1 END")} AS season_length FROM c WHERE rn = 1""",
)
def season_lengths(spark, folder):
    return shown(C.infer_season_length(P.supplier_week(spark, folder), P.WEEKLY))


@query(
    "part_family_names",
    f"""SELECT p_partkey, split_part(p_name, ' ', 1) AS family, try_cast(split_part(p_brand, '#', 2) AS BIGINT) AS brand_number,
 {n("starts_with(p_type, 'S')")} AS s_type, p_brand || '_' || p_type AS brand_type FROM part""",
)
def part_family_names(spark, folder):
    part = table(spark, folder, "part")
    return shown(
        part.select(
            "p_partkey", F.substring_index("p_name", " ", 1).alias("family"),
            F.split("p_brand", "#")[1].try_cast("bigint").alias("brand_number"),
            F.startswith("p_type", F.lit("S")).alias("s_type"), select.composite_key(["p_brand", "p_type"]).alias("brand_type"),
        )
    )


# --- transforms and encodings ----------------------------------------------------------


@query(
    "simple_transforms",
    f"""SELECT l_orderkey, {n("l_linenumber")} AS l_linenumber, l_partkey, l_suppkey, {r("ln(1 + l_quantity)")} AS log1p, {r("ln(l_extendedprice)")} AS log,
 {r("pow(greatest(sqrt(l_extendedprice), 0), 2)", 3)} AS back, {r("(pow(l_quantity, 0.3) - 1) / 0.3")} AS boxcox,
 {r("CASE WHEN l_discount - 0.05 >= 0 THEN (pow(l_discount - 0.05 + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - (l_discount - 0.05), 1.5) - 1) / 1.5 END")} AS yj FROM lineitem""",
)
def simple_transforms(spark, folder):
    x = table(spark, folder, "lineitem")
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    return shown(
        x.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            transforms.log_transform(qty).alias("log1p"), transforms.log_transform(price, False).alias("log"),
            F.round(transforms.invert_power_target(transforms.power_target(price)) + 2e-8, 3).alias("back"),
            transforms.boxcox(qty, 0.3).alias("boxcox"), transforms.yeo_johnson(F.col("l_discount") - 0.05, 0.5).alias("yj"),
        )
    )


_LL = "-n / 2.0 * ln(v) + (lam - 1) * j"


@query(
    "boxcox_lambda",
    f"""WITH panel AS ({P.SUPPLIER_WEEK}), g AS (SELECT -2.0 + i * 0.1 AS lam FROM range(41) t(i)),
 l AS (SELECT k, lam, count(*) AS n, var_pop(CASE WHEN abs(lam) < 1e-9 THEN ln(y) ELSE (pow(y, lam) - 1) / lam END) AS v, sum(ln(y)) AS j FROM panel, g GROUP BY k, lam)
SELECT k, {r("arg_max(lam, " + _LL + ")", 4)} AS lambda FROM l GROUP BY k""",
)
def boxcox_lambda(spark, folder):
    fit = transforms.fit_boxcox(P.supplier_week(spark, folder), "y", ["k"], rounds=0)
    return shown(fit.select("k", "lambda"), 4)


@query(
    "yeo_johnson_lambda",
    f"""{SUP}, g AS (SELECT -2.0 + i * 0.15 AS lam FROM range(41) t(i)),
 l AS (SELECT k, lam, count(*) AS n, var_pop(CASE WHEN abs(lam) < 1e-9 THEN ln(1 + y) ELSE (pow(1 + y, lam) - 1) / lam END) AS v, sum(ln(1 + y)) AS j FROM filled, g GROUP BY k, lam)
SELECT k, {r("arg_max(lam, " + _LL + ")", 4)} AS lambda FROM l GROUP BY k""",
)
def yeo_johnson_lambda(spark, folder):
    fit = transforms.fit_yeo_johnson(P.supplier_week_full(spark, folder), "y", ["k"], rounds=0)
    return shown(fit.select("k", "lambda"), 4)


def _lambda_pass(name: str, grid: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT k, arg_max(lam, {_LL}) AS lam FROM (SELECT k, lam, count(*) AS n, sum(ln(y)) AS j,
  var_pop(CASE WHEN abs(lam) < 1e-12 THEN ln(y) ELSE (pow(y, lam) - 1) / lam END) AS v FROM ({grid}) GROUP BY k, lam) GROUP BY k)"""


@query(
    "boxcox_refined_transform",
    f"""WITH panel AS ({P.SUPPLIER_WEEK}), {_lambda_pass("l1", "SELECT k, y, -2.0 + i * 0.1 AS lam FROM panel, range(41) t(i)")},
 {_lambda_pass("l2", "SELECT k, y, lam + i * CAST(0.02 AS DOUBLE) AS lam FROM panel JOIN l1 USING (k), range(-5, 6) t(i)")},
 {_lambda_pass("l3", "SELECT k, y, lam + i * CAST(0.004 AS DOUBLE) AS lam FROM panel JOIN l2 USING (k), range(-5, 6) t(i)")}
SELECT k, {s("d")} AS d, {r("y")} AS y, {r("lam", 4)} AS lambda, {r("(pow(y, lam) - 1) / lam", 3)} AS y_bc FROM panel JOIN l3 USING (k)""",
)
def boxcox_refined_transform(spark, folder):
    out = transforms.boxcox_transform(P.supplier_week(spark, folder), "y", ["k"])
    return shown(out.select("k", "d", "y", F.round(F.col("lambda") + 2e-8, 4).alias("lambda"), F.round(F.col("y_bc") + 2e-8, 3).alias("y_bc")))


_FIT = "l_shipdate < TIMESTAMP '1998-01-01'"


@query(
    "scaled_columns",
    f"""WITH a AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd, min(l_discount) AS lo, max(l_discount) AS hi,
  quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem WHERE {_FIT})
SELECT l_orderkey, {n("l_linenumber")} AS l_linenumber, l_partkey, l_suppkey, {r("(l_quantity - m) / sd")} AS l_quantity_scaled, {r("(l_discount - lo) / (hi - lo)")} AS l_discount_scaled,
 {r("(l_extendedprice - med) / iqr")} AS l_extendedprice_scaled FROM lineitem, a""",
)
def scaled_columns(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_shipdate")
    train = lines.filter(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    for col, method in (("l_quantity", "standard"), ("l_discount", "minmax"), ("l_extendedprice", "robust")):
        lines = transforms.apply_scaler(lines, transforms.fit_scaler(train, [col], method), [col])
    return shown(lines.drop("l_quantity", "l_discount", "l_extendedprice", "l_shipdate"))


@query(
    "detrended_price",
    f"""WITH j AS (SELECT l_partkey, l_orderkey, {n("l_linenumber")} AS l_linenumber, l_suppkey, CAST(l_shipdate AS DATE) AS d, ln(l_extendedprice) AS p FROM lineitem),
 z AS (SELECT *, CASE WHEN stddev_samp(p) OVER w = 0 THEN 0 ELSE (p - avg(p) OVER w) / stddev_samp(p) OVER w END AS zs FROM j WINDOW w AS (PARTITION BY l_partkey))
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, {s("d")} AS d, {r("zs - avg(zs) OVER (PARTITION BY d)", 5)} AS detrended FROM z""",
)
def detrended_price(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_shipdate").cast("date").alias("d"), F.ln("l_extendedprice").alias("p")
    )
    z = transforms.z_score_per_key(lines, PanelSpec("d", "p", ("l_partkey",)), "p", "zs")
    return shown(transforms.remove_group_mean(z, ["d"], "zs", "detrended").drop("p", "zs"), 5)


@query(
    "label_encoding",
    """WITH l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_name AS v FROM part WHERE p_partkey % 2 = 0))
SELECT p_partkey, coalesce(l.code, -1) AS p_name FROM part LEFT JOIN l ON p_name = l.v""",
)
def label_encoding(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    # Labels are fitted on the even keys and applied to the whole table, unseen ones included.
    fits = {"p_name": encode.fit_labels(part.filter(F.col("p_partkey") % 2 == 0), "p_name")}
    return shown(encode.apply_label_encoding(part, fits))


@query(
    "shared_label_levels",
    """WITH l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT c_mktsegment AS v FROM customer UNION SELECT p_type FROM part))
SELECT 'customer' AS part, c_custkey AS id, code FROM customer JOIN l ON v = c_mktsegment UNION ALL SELECT 'part', p_partkey, code FROM part JOIN l ON v = p_type""",
)
def shared_label_levels(spark, folder):
    a = table(spark, folder, "customer").select(F.lit("customer").alias("part"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("code"))
    b = table(spark, folder, "part").select(F.lit("part").alias("part"), F.col("p_partkey").alias("id"), F.col("p_type").alias("code"))
    (a, b), _ = encode.shared_levels([a, b], "code")
    return shown(a.unionByName(b))


@query(
    "first_appearance_codes",
    f"""WITH f AS (SELECT o_orderpriority AS v, min((o_custkey, o_orderdate)) AS o FROM orders GROUP BY 1), c AS (SELECT v, row_number() OVER (ORDER BY o, v) - 1 AS code FROM f)
SELECT o_orderkey, code FROM orders JOIN c ON v = o_orderpriority""",
)
def first_appearance_codes(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    spec = PanelSpec("o_orderdate", "", ("o_custkey",))
    return shown(encode.factorize(orders, spec, "o_orderpriority", "code").select("o_orderkey", "code"))


@query(
    "one_hot_encoding",
    f"""SELECT o_orderkey, {n("o_orderstatus = 'O'")} AS "o_orderstatus_O", {n("o_orderstatus = 'P'")} AS "o_orderstatus_P" FROM orders""",
)
def one_hot_encoding(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return shown(encode.one_hot_encode(orders, ["o_orderstatus"], drop_first=True))


@query("one_hot_vectors", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) AS slot FROM part")
def one_hot_vectors(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    out = encode.one_hot_vector(part, ["p_brand"])
    from pyspark.ml.functions import vector_to_array

    return shown(out.select("p_partkey", F.array_position(vector_to_array("p_brand_vec"), 1.0).alias("slot")))


@query(
    "frequency_encoding",
    "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS p_brand_freq, count(*) OVER (PARTITION BY p_name) AS p_name_freq FROM part",
)
def frequency_encoding(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name")
    return shown(encode.frequency_encode(part, ["p_brand", "p_name"]).select("p_partkey", "p_brand_freq", "p_name_freq"))


@query(
    "target_encoding",
    f"""WITH t AS (SELECT l_partkey, l_quantity FROM lineitem WHERE {_FIT}), g AS (SELECT avg(l_quantity) AS g FROM t),
 e AS (SELECT l_partkey, (sum(l_quantity) + 10 * (SELECT g FROM g)) / (count(*) + 10.0) AS te FROM t GROUP BY 1)
SELECT l.l_orderkey, {n("l.l_linenumber")} AS l_linenumber, l.l_suppkey, l.l_partkey, {r("coalesce(te, g)")} AS l_partkey_te FROM lineitem l CROSS JOIN g LEFT JOIN e ON l.l_partkey = e.l_partkey""",
)
def target_encoding(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate")
    train = lines.filter(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    fits = encode.fit_target_encoding(train, ["l_partkey"], "l_quantity")
    return shown(encode.apply_target_encoding(lines, fits).drop("l_quantity", "l_shipdate"))


