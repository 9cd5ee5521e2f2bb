"""Profiles, quality reports and demand classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import demand, profile, quality, select
from seriesloom.operators.grid import collapse_duplicates, complete_panel, fill_time_gaps
from seriesloom.spec import PanelSpec
from workload import panels as P
from workload.registry import n, query, r, s, shown, table

ADI = "CASE WHEN count(y) = 0 THEN NULL WHEN count(*) FILTER (y <> 0) = 0 THEN CAST('inf' AS DOUBLE) ELSE count(y) / CAST(count(*) FILTER (y <> 0) AS DOUBLE) END"
CV2 = "pow(stddev_samp(y) FILTER (y <> 0) / nullif(avg(y) FILTER (y <> 0), 0), 2)"
CLASS = """CASE WHEN adi = CAST('inf' AS DOUBLE) THEN 'no_demand' WHEN adi IS NULL OR cv2 IS NULL THEN 'undefined'
  WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic'
  WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END"""


def _classes(panel: str, step: str = "7 DAY", keys: str = "k") -> str:
    return f"""{P.with_grid(panel, step, keys)},
 stats AS (SELECT {keys}, count(y) AS n_obs, count(*) FILTER (y = 0) / CAST(count(*) AS DOUBLE) AS zero_share,
   {ADI} AS adi, {CV2} AS cv2 FROM filled GROUP BY {keys}),
 classes AS (SELECT *, {CLASS} AS sb_class FROM stats)"""


@query(
    "supplier_week_class_summary",
    f"""{_classes(P.SUPPLIER_WEEK)}
SELECT sb_class, count(*) AS n_series, {r("count(*) * 100.0 / (SELECT count(*) FROM classes)")} AS pct
FROM classes GROUP BY 1""",
)
def supplier_week_class_summary(spark, folder):
    return shown(demand.classification_summary(demand.classify_all_series(P.supplier_week_full(spark, folder), P.WEEKLY)))


@query(
    "part_week_demand_classes",
    f"""{_classes(P.PART_WEEK)}
SELECT k, n_obs, {r("zero_share")} AS zero_share, {r("adi")} AS adi, {r("cv2")} AS cv2, sb_class FROM classes""",
)
def part_week_demand_classes(spark, folder):
    full = complete_panel(P.part_week(spark, folder), P.WEEKLY)
    return shown(demand.classify_all_series(full, P.WEEKLY))


@query(
    "customer_week_demand_pattern",
    f"""{P.with_grid(P.CUSTOMER_WEEK)},
 st AS (SELECT k, count(*) FILTER (y > 0) AS m, count(*) AS n, count(*) FILTER (y = 0) AS z, avg(y) AS mean_demand,
   stddev_pop(y) FILTER (y > 0) AS sd, avg(y) FILTER (y > 0) AS mu FROM filled GROUP BY k),
 st2 AS (SELECT k, mean_demand, z / CAST(n AS DOUBLE) AS zero_share,
   CASE WHEN m = 0 THEN CAST('inf' AS DOUBLE) ELSE n / CAST(m AS DOUBLE) END AS adi,
   coalesce(pow(sd / nullif(mu, 0), 2), 0) AS cv2 FROM st)
SELECT k, {r("adi")} AS "ADI", {r("cv2")} AS "CV2", {r("mean_demand")} AS mean_demand, {r("zero_share")} AS zero_share,
 CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'Smooth' WHEN adi < 1.32 THEN 'Erratic' WHEN cv2 < 0.49 THEN 'Intermittent' ELSE 'Lumpy' END AS pattern
FROM st2""",
)
def customer_week_demand_pattern(spark, folder):
    full = complete_panel(P.customer_week(spark, folder), P.WEEKLY)
    return shown(demand.classify_demand(full, P.WEEKLY))


@query(
    "user_type_day_sbc_category",
    f"""{P.with_grid(P.USER_TYPE_DAY, "1 DAY", "k, t")},
 st AS (SELECT k, t, count(y) AS n_obs, count(*) FILTER (y > 0) AS n_nonzero, count(*) FILTER (y < 0) AS neg,
   stddev_samp(y) FILTER (y > 0) / avg(y) FILTER (y > 0) AS cv FROM filled GROUP BY k, t),
 m AS (SELECT k, t, n_obs, n_nonzero,
   CASE WHEN neg > 0 THEN NULL WHEN n_nonzero >= 2 THEN n_obs / CAST(n_nonzero AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END AS adi,
   CASE WHEN neg = 0 AND n_nonzero >= 2 THEN cv * cv END AS cv2,
   CASE WHEN neg = 0 THEN (n_obs - n_nonzero) * 100.0 / n_obs END AS pct_zero,
   CASE WHEN neg > 0 THEN 'negative demand' END AS error FROM st)
SELECT k, t, n_obs, n_nonzero, {r("adi")} AS "ADI", {r("cv2")} AS "CV2", {r("pct_zero")} AS pct_zero, error,
 CASE WHEN error IS NOT NULL THEN NULL WHEN n_nonzero < 2 THEN 'insufficient_data'
  WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic' WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS category
FROM m""",
)
def user_type_day_sbc_category(spark, folder):
    full = complete_panel(P.user_type_day(spark, folder), P.DAILY_BY_TYPE)
    return shown(demand.classify_demand_pattern(full, P.DAILY_BY_TYPE))


@query(
    "class_strategy_and_objective",
    f"""{_classes(P.USER_TYPE_DAY, "1 DAY", "k, t")}
SELECT k, t, sb_class, CASE sb_class WHEN 'smooth' THEN 'regression' WHEN 'erratic' THEN 'huber'
  WHEN 'intermittent' THEN 'tweedie' WHEN 'lumpy' THEN 'tweedie' END AS objective,
 CASE sb_class
  WHEN 'smooth' THEN 'exponential smoothing or regression; score with MAE and RMSE'
  WHEN 'erratic' THEN 'variance-stabilising transform, robust or quantile regression'
  WHEN 'intermittent' THEN 'Croston family or compound counts; do not score with MAPE'
  WHEN 'lumpy' THEN 'bias-corrected Croston or TSB; consider forecasting at a coarser level'
  WHEN 'no_demand' THEN 'forecast zero until outside information says otherwise'
  WHEN 'undefined' THEN 'too few demands to choose' ELSE 'unknown class' END AS strategy
FROM classes""",
)
def class_strategy_and_objective(spark, folder):
    full = complete_panel(P.user_type_day(spark, folder), P.DAILY_BY_TYPE)
    classes = demand.classify_all_series(full, P.DAILY_BY_TYPE)
    return classes.select(
        "k", "t", "sb_class",
        demand.recommend_loss(F.col("sb_class")).alias("objective"),
        demand.recommend_strategy(F.col("sb_class")).alias("strategy"),
    )


@query(
    "persona_keys",
    f"""WITH panel AS ({P.CUSTOMER_WEEK}),
 g AS (SELECT k, count(d) AS n_obs, count(*) FILTER (y < 150000) AS n_low FROM panel GROUP BY k),
 o AS (SELECT k, row_number() OVER (ORDER BY n_obs, k) AS rn, count(*) OVER () AS n FROM g)
SELECT 'longest' AS persona, (SELECT k FROM g ORDER BY n_obs DESC, k LIMIT 1) AS k
UNION ALL SELECT 'most_zeros', (SELECT k FROM g ORDER BY n_low DESC, k LIMIT 1)
UNION ALL SELECT 'median_length', (SELECT k FROM o WHERE rn = n // 2 + 1)""",
)
def persona_keys(spark, folder):
    panel = P.customer_week(spark, folder)
    summary = panel.groupBy("k").agg(
        F.count("d").alias("n_obs"), F.count(F.when(F.col("y") < 150000, 1)).alias("n_low")
    )
    return demand.pick_personas(summary, ["k"], "n_obs", "n_low")


@query(
    "median_length_key_per_class",
    f"""{_classes(P.CUSTOMER_WEEK)},
 o AS (SELECT sb_class, n_obs, k, row_number() OVER (PARTITION BY sb_class ORDER BY n_obs) AS rn,
        count(*) OVER (PARTITION BY sb_class) AS n FROM classes),
 c AS (SELECT sb_class, n_obs FROM o WHERE rn = n // 2 + 1)
SELECT c.sb_class, c.n_obs, min(x.k) AS k FROM c JOIN classes x ON x.sb_class = c.sb_class AND x.n_obs = c.n_obs GROUP BY 1, 2""",
)
def median_length_key_per_class(spark, folder):
    full = complete_panel(P.customer_week(spark, folder), P.WEEKLY)
    return demand.median_length_per_class(demand.classify_all_series(full, P.WEEKLY), ["k"])


@query(
    "column_overview",
    "WITH c AS (SELECT * FROM customer), t AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS missing,
 {r(f"(count(*) - count({c})) * 100.0 / count(*)")} AS missing_pct, count(DISTINCT {c}) AS n_unique,
 {r(f"count(DISTINCT {c}) * 100.0 / count(*)")} AS unique_pct, min({s(c)}) AS example FROM c"""
        for c, t in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))
    )
    + ") SELECT * FROM t",
)
def column_overview(spark, folder):
    return shown(profile.inspect_data(table(spark, folder, "customer")))


@query(
    "key_summary",
    f"""WITH panel AS ({P.USER_TYPE_DAY})
SELECT k, t, count(d) AS n_obs, {s("min(d)")} AS date_min, {s("max(d)")} AS date_max, {r("avg(y)")} AS target_mean,
 {r("stddev_samp(y)")} AS target_std, {r("min(y)")} AS target_min, {r("max(y)")} AS target_max, {r("sum(y)", 4)} AS target_sum,
 count(*) FILTER (y = 0) AS n_zeros, count(*) - count(y) AS n_missing, {n("max(d) - min(d)")} AS span_days,
 {r("count(*) FILTER (y = 0) * 100.0 / count(d)")} AS zero_pct, {r("(count(*) - count(y)) * 100.0 / count(d)")} AS missing_pct
FROM panel GROUP BY k, t""",
)
def key_summary(spark, folder):
    out = profile.summarize_keys(P.user_type_day(spark, folder), P.DAILY_BY_TYPE)
    return shown(out.withColumn("target_sum", F.round("target_sum", 4)))


ORDER_SPEC = PanelSpec("o_orderdate", "o_totalprice", ("o_custkey", "o_orderpriority"))


@query(
    "coverage",
    f"""SELECT count(*) AS rows, count(DISTINCT (o_custkey, o_orderpriority)) AS n_forecast_keys,
 {s("CAST(min(o_orderdate) AS DATE)")} AS min_date, {s("CAST(max(o_orderdate) AS DATE)")} AS max_date,
 {n("date_diff('day', min(o_orderdate), max(o_orderdate)) + 1")} AS total_days,
 {r("count(*) / CAST(count(DISTINCT (o_custkey, o_orderpriority)) AS DOUBLE)")} AS avg_rows_per_key FROM orders""",
)
def coverage(spark, folder):
    orders = table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return shown(profile.coverage_report(orders, ORDER_SPEC))


@query(
    "missing_by_column",
    f"""{P.with_grid(P.USER_TYPE_DAY, "1 DAY", "k, t", None)}
"""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, {r(f"(count(*) - count({c})) * 100.0 / count(*)")} AS missing_pct,
 count({c}) AS non_null, '{t}' AS dtype FROM filled"""
        for c, t in (("k", "bigint"), ("t", "string"), ("d", "date"), ("y", "double"), ("x", "bigint"))
    ),
)
def missing_by_column(spark, folder):
    return shown(quality.missing_value_report(P.user_type_day_filled(spark, folder).drop("_was_imputed")))


@query(
    "missing_by_series",
    f"""{P.with_grid(P.USER_TYPE_DAY, "1 DAY", "k, t", None)}
SELECT k, t, count(*) AS n_obs, count(*) - count(y) AS missing, {r("(count(*) - count(y)) * 100.0 / count(*)")} AS missing_pct
FROM filled GROUP BY k, t""",
)
def missing_by_series(spark, folder):
    return shown(quality.missing_by_series(P.user_type_day_filled(spark, folder), P.DAILY_BY_TYPE))


GAPS = P.with_grid(P.USER_TYPE_DAY, "1 DAY", "k, t", None)


@query(
    "time_gaps",
    f"""{GAPS}
SELECT k, t, {n("count(*) - count(*) FILTER (inserted)")} AS n_obs, count(*) AS expected_obs,
 count(*) FILTER (inserted) AS missing_dates, {s("min(d) FILTER (inserted)")} AS first_gap, {s("max(d) FILTER (inserted)")} AS last_gap,
 {r("count(*) FILTER (inserted) * 100.0 / count(*)")} AS gap_pct FROM filled GROUP BY k, t""",
)
def time_gaps(spark, folder):
    return shown(quality.detect_time_gaps(P.user_type_day(spark, folder), P.DAILY_BY_TYPE))


@query(
    "keys_mostly_missing",
    f"""{GAPS}
SELECT k, t, count(*) FILTER (inserted) AS missing_dates, {r("count(*) FILTER (inserted) * 100.0 / count(*)")} AS gap_pct
FROM filled GROUP BY k, t HAVING count(*) FILTER (inserted) * 100.0 / count(*) > 40""",
)
def keys_mostly_missing(spark, folder):
    gaps = quality.detect_time_gaps(P.user_type_day(spark, folder), P.DAILY_BY_TYPE)
    return shown(quality.keys_above(gaps, "gap_pct", 40.0).select("k", "t", "missing_dates", "gap_pct"))


@query(
    "gap_examples",
    f"""{GAPS}
SELECT k, t, {s("d")} AS missing_date, dayname(d) AS weekday FROM (
 SELECT *, row_number() OVER (PARTITION BY k, t ORDER BY d) AS rn FROM filled WHERE inserted) WHERE rn <= 5""",
)
def gap_examples(spark, folder):
    return shown(quality.gap_examples(P.user_type_day(spark, folder), P.DAILY_BY_TYPE, max_examples=5))


@query(
    "gap_weekdays",
    f"""{GAPS} SELECT dayname(d) AS weekday, count(*) AS n FROM filled WHERE inserted GROUP BY 1""",
)
def gap_weekdays(spark, folder):
    return quality.gap_weekdays(P.user_type_day(spark, folder), P.DAILY_BY_TYPE)


@query(
    "panel_audit",
    f"""WITH panel AS ({P.CUSTOMER_WEEK})
SELECT k, count(*) AS n_obs, {s("min(d)")} AS first_date, {s("max(d)")} AS last_date,
 {n("(max(d) - min(d)) // 7 + 1 - count(DISTINCT d)")} AS missing_dates, count(*) FILTER (y = 0) AS n_zeros,
 count(*) FILTER (y < 0) AS n_negatives, count(*) - count(y) AS n_nans FROM panel GROUP BY k""",
)
def panel_audit(spark, folder):
    return shown(quality.validate_panel(P.customer_week(spark, folder), P.WEEKLY))


@query(
    "panel_audit_totals",
    f"""WITH panel AS ({P.CUSTOMER_WEEK}),
 a AS (SELECT k, (max(d) - min(d)) // 7 + 1 - count(DISTINCT d) AS missing_dates, count(*) FILTER (y = 0) AS z,
 count(*) FILTER (y < 0) AS g, count(*) - count(y) AS u FROM panel GROUP BY k)
SELECT count(*) AS n_keys, {n("sum(missing_dates)")} AS missing_dates, {n("sum(z)")} AS n_zeros, {n("sum(g)")} AS n_negatives, {n("sum(u)")} AS n_nans FROM a""",
)
def panel_audit_totals(spark, folder):
    return shown(quality.panel_totals(quality.validate_panel(P.customer_week(spark, folder), P.WEEKLY)))


ORDER_DAY = PanelSpec("d", "o_totalprice", ("o_custkey", "o_orderpriority"))
_ORDERS_BY_DAY = "SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders"


def _orders_by_day(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("d"), "o_totalprice"
    )


@query(
    "duplicate_rows",
    f"""WITH o AS ({_ORDERS_BY_DAY}), c AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority, d) AS n FROM o)
SELECT o_orderkey, o_custkey, o_orderpriority, {s("d")} AS d, {r("o_totalprice")} AS o_totalprice FROM c WHERE n > 1""",
)
def duplicate_rows(spark, folder):
    return shown(quality.detect_duplicates(_orders_by_day(spark, folder), ORDER_DAY))


@query(
    "duplicates_resolved_by_sum",
    f"""WITH o AS ({_ORDERS_BY_DAY})
SELECT o_custkey, o_orderpriority, {s("d")} AS d, {r("sum(o_totalprice)", 2)} AS o_totalprice, min(o_orderkey) AS o_orderkey
FROM o GROUP BY o_custkey, o_orderpriority, d""",
)
def duplicates_resolved_by_sum(spark, folder):
    return shown(collapse_duplicates(_orders_by_day(spark, folder), ORDER_DAY, "sum"), 2)


@query(
    "duplicates_resolved_by_first",
    f"""WITH o AS ({_ORDERS_BY_DAY}), c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, d ORDER BY o_orderkey) AS rn FROM o)
SELECT o_orderkey, o_custkey, o_orderpriority, {s("d")} AS d, {r("o_totalprice")} AS o_totalprice FROM c WHERE rn = 1""",
)
def duplicates_resolved_by_first(spark, folder):
    return shown(collapse_duplicates(_orders_by_day(spark, folder), ORDER_DAY, "first"))


@query(
    "target_signs",
    f"""SELECT count(c_acctbal) AS n_total, count(*) FILTER (c_acctbal < 0) AS n_negative, count(*) FILTER (c_acctbal = 0) AS n_zero,
 count(*) FILTER (c_acctbal > 0) AS n_positive, {r("count(*) FILTER (c_acctbal < 0) * 100.0 / count(c_acctbal)")} AS pct_negative,
 {r("count(*) FILTER (c_acctbal = 0) * 100.0 / count(c_acctbal)")} AS pct_zero FROM customer""",
)
def target_signs(spark, folder):
    return shown(quality.target_sign_check(table(spark, folder, "customer"), PanelSpec("", "c_acctbal", ("c_custkey",))))


@query(
    "static_consistency",
    f"""WITH j AS (SELECT l_partkey, p_brand, p_type, l_returnflag, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey),
 v AS (SELECT l_partkey, count(DISTINCT p_brand) > 1 AS a, count(DISTINCT p_type) > 1 AS b, count(DISTINCT l_returnflag) > 1 AS c FROM j GROUP BY 1)
SELECT * FROM (VALUES ('p_brand', (SELECT count(*) FILTER (a) FROM v)), ('p_type', (SELECT count(*) FILTER (b) FROM v)),
 ('l_returnflag', (SELECT count(*) FILTER (c) FROM v))) AS t("column", n_inconsistent_keys),
 LATERAL (SELECT count(*) AS n_keys, {r("n_inconsistent_keys * 100.0 / count(*)")} AS inconsistent_pct FROM v) u""",
)
def static_consistency(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_returnflag", "l_quantity")
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    spec = PanelSpec("d", "l_quantity", ("l_partkey",), ("p_brand", "p_type", "l_returnflag"))
    return shown(quality.static_feature_consistency(lines.join(part, "l_partkey"), spec))


@query(
    "numeric_description",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f"avg({c})", 4)} AS mean, {r(f"stddev_samp({c})", 4)} AS std, {r(f"min({c})", 4)} AS min,
 {r(f"quantile_cont({c}, 0.25)", 4)} AS p25, {r(f"quantile_cont({c}, 0.5)", 4)} AS median, {r(f"quantile_cont({c}, 0.75)", 4)} AS p75, {r(f"max({c})", 4)} AS max,
 {r(f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", 4)} AS iqr, {r(f"skewness({c})", 4)} AS skewness, {r(f"kurtosis({c})", 4)} AS kurtosis,
 {r(f"stddev_samp({c}) / avg({c})", 4)} AS cv, {r(f"count(*) FILTER ({c} = 0) * 100.0 / count({c})", 4)} AS zero_pct FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def numeric_description(spark, folder):
    lines = table(spark, folder, "lineitem")
    return shown(profile.describe_numeric(lines, ["l_quantity", "l_extendedprice", "l_discount"]), 4)


def _cat(c: str, t: str) -> str:
    return f"""(WITH v AS (SELECT coalesce({c}, 'null') AS l, count(*) AS n FROM {t} GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, l) AS rn FROM v)
 SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {t}) AS n_unique, (SELECT count(*) - count({c}) FROM {t}) AS missing,
 (SELECT l FROM o WHERE rn = 1) AS mode, (SELECT {r(f"n * 100.0 / (SELECT count(*) FROM {t})")} FROM o WHERE rn = 1) AS mode_share_pct,
 (SELECT string_agg(l || '(' || n || ')', ', ' ORDER BY rn) FROM o WHERE rn <= 5) AS top_values)"""


@query("categorical_description", f"""SELECT * FROM {_cat("o_orderstatus", "orders")} UNION ALL SELECT * FROM {_cat("o_orderpriority", "orders")}""")
def categorical_description(spark, folder):
    return shown(profile.describe_categorical(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query(
    "series_stats",
    f"""{P.with_grid(P.SUPPLIER_WEEK)}
SELECT k, count(*) AS n_obs, {r("avg(y)")} AS mean, {r("stddev_samp(y)")} AS std, {r("stddev_samp(y) / nullif(avg(y), 0)")} AS cv,
 {r("stddev_samp(y) FILTER (y <> 0) / nullif(avg(y) FILTER (y <> 0), 0)")} AS cv_nonzero,
 {r("count(*) FILTER (y = 0) / CAST(count(*) AS DOUBLE)")} AS zero_share, {r(ADI)} AS adi, {r(CV2)} AS cv2 FROM filled GROUP BY k""",
)
def series_stats(spark, folder):
    return shown(profile.per_series_stats(P.supplier_week_full(spark, folder), P.WEEKLY))


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


@query("pearson_correlation", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})')} AS corr FROM lineitem" for a, b in _PAIRS))
def pearson_correlation(spark, folder):
    return shown(profile.correlation_matrix(table(spark, folder, "lineitem"), _NUM))


def _ranked(a: str, b: str, t: str) -> str:
    rk = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return f"SELECT '{a}' AS x, '{b}' AS y, {r('corr(ra, rb)')} AS corr FROM (SELECT {rk(a)} AS ra, {rk(b)} AS rb FROM {t})"


@query("spearman_correlation", " UNION ALL ".join(_ranked(a, b, "lineitem") for a, b in (("l_quantity", "l_discount"), ("l_quantity", "l_extendedprice"), ("l_discount", "l_extendedprice"))))
def spearman_correlation(spark, folder):
    return shown(profile.correlation_matrix(table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], "spearman"))


@query(
    "kendall_correlation",
    f"""WITH c AS (SELECT l_quantity AS a, l_discount AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
 p AS (SELECT sum(CAST(x.n * z.n AS DOUBLE) * sign(x.a - z.a) * sign(x.b - z.b)) / 2 AS s FROM c x, c z),
 t AS (SELECT sum(n) AS n FROM c),
 ta AS (SELECT sum(m * (m - 1) / 2.0) AS v FROM (SELECT sum(n) AS m FROM c GROUP BY a)),
 tb AS (SELECT sum(m * (m - 1) / 2.0) AS v FROM (SELECT sum(n) AS m FROM c GROUP BY b))
SELECT 'l_quantity' AS x, 'l_discount' AS y,
 {r("s / (sqrt(t.n * (t.n - 1) / 2.0 - ta.v) * sqrt(t.n * (t.n - 1) / 2.0 - tb.v))")} AS corr FROM p, t, ta, tb""",
)
def kendall_correlation(spark, folder):
    return shown(profile.correlation_matrix(table(spark, folder, "lineitem"), ["l_quantity", "l_discount"], "kendall"))


@query("value_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def value_counts(spark, folder):
    return profile.value_counts(table(spark, folder, "lineitem"), "l_returnflag")


@query(
    "group_description",
    f"""{_classes(P.CUSTOMER_WEEK)}
SELECT sb_class, count(*) AS count, {r("avg(adi)")} AS mean, {r("stddev_samp(adi)")} AS std, {r("min(adi)")} AS min,
 {r("quantile_cont(adi, 0.25)")} AS p25, {r("quantile_cont(adi, 0.5)")} AS median, {r("quantile_cont(adi, 0.75)")} AS p75, {r("max(adi)")} AS max
FROM classes GROUP BY 1""",
)
def group_description(spark, folder):
    full = complete_panel(P.customer_week(spark, folder), P.WEEKLY)
    return shown(profile.describe_by_group(demand.classify_all_series(full, P.WEEKLY), "sb_class", "adi"))


@query(
    "monthly_resample",
    f"""WITH panel AS ({P.SUPPLIER_WEEK}) SELECT k, {s("CAST(date_trunc('month', d) AS DATE)")} AS d, {r("sum(y)")} AS y FROM panel GROUP BY 1, 2""",
)
def monthly_resample(spark, folder):
    return shown(profile.resample(P.supplier_week(spark, folder), P.WEEKLY, "month"))


@query(
    "quarterly_resample_mean",
    f"""WITH panel AS ({P.SUPPLIER_WEEK}) SELECT k, {s("CAST(date_trunc('quarter', d) AS DATE)")} AS d, {r("avg(y)")} AS y FROM panel GROUP BY 1, 2""",
)
def quarterly_resample_mean(spark, folder):
    return shown(profile.resample(P.supplier_week(spark, folder), P.WEEKLY, "quarter", "mean"))


@query(
    "series_of_one_key",
    f"""WITH panel AS ({P.USER_TYPE_DAY}) SELECT k, t, {s("d")} AS d, y, x FROM panel WHERE t = 'click' AND k = 7""",
)
def series_of_one_key(spark, folder):
    return shown(select.get_series(P.user_type_day(spark, folder), P.DAILY_BY_TYPE, {"t": "click", "k": 7}))


@query(
    "top_keys_rows",
    f"""WITH panel AS ({P.PART_WEEK}), top AS (SELECT k FROM panel GROUP BY k ORDER BY sum(y) DESC, k LIMIT 20)
SELECT k, {s("d")} AS d, {r("y")} AS y FROM panel WHERE k IN (SELECT k FROM top)""",
)
def top_keys_rows(spark, folder):
    panel = P.part_week(spark, folder)
    return shown(select.keep_keys(panel, select.top_keys(panel, P.WEEKLY, 20), P.WEEKLY))


@query("first_keys", "SELECT DISTINCT l_suppkey AS k FROM lineitem ORDER BY 1 LIMIT 10")
def first_keys(spark, folder):
    return select.first_keys(P.supplier_week(spark, folder), P.WEEKLY, 10)


@query(
    "head_and_tail_per_key",
    f"""WITH panel AS ({P.SUPPLIER_WEEK}), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS a, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS b FROM panel)
SELECT k, {s("d")} AS d, {r("y")} AS y, 'head' AS part FROM o WHERE a <= 3 UNION ALL SELECT k, {s("d")}, {r("y")}, 'tail' FROM o WHERE b <= 3""",
)
def head_and_tail_per_key(spark, folder):
    panel = P.supplier_week(spark, folder)
    head = select.head_per_key(panel, P.WEEKLY, 3).withColumn("part", F.lit("head"))
    return shown(head.unionByName(select.tail_per_key(panel, P.WEEKLY, 3).withColumn("part", F.lit("tail"))))


@query(
    "evenly_spaced_rows",
    f"""WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders),
 picks AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 299) AS BIGINT) AS p FROM range(300) t(i), (SELECT max(n) AS n FROM o))
SELECT o_orderkey, o_custkey FROM o WHERE p IN (SELECT p FROM picks)""",
)
def evenly_spaced_rows(spark, folder):
    return select.evenly_spaced(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 300)


@query(
    "row_maximum_and_clip",
    f"""SELECT l_orderkey, {n("l_linenumber")} AS l_linenumber, {r("greatest(l_discount, l_tax)")} AS best, {r("greatest(l_discount - 0.05, 0)")} AS clipped,
 CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'single' END AS size, l_returnflag || '_' || l_linestatus AS combo FROM lineitem""",
)
def row_maximum_and_clip(spark, folder):
    lines = table(spark, folder, "lineitem")
    return shown(
        lines.select(
            "l_orderkey", "l_linenumber",
            select.strongest(["l_discount", "l_tax"]).alias("best"),
            select.not_below(F.col("l_discount") - 0.05).alias("clipped"),
            F.when(F.col("l_quantity") > 25, "bulk").otherwise("single").alias("size"),
            select.composite_key(["l_returnflag", "l_linestatus"]).alias("combo"),
        )
    )


@query(
    "sampled_keys_rows",
    f"""WITH panel AS ({P.PART_WEEK}), c AS (SELECT DISTINCT k, md5(concat_ws('|', k, 42)) AS h FROM panel ORDER BY h, k LIMIT 500)
SELECT k, {s("d")} AS d, {r("y")} AS y FROM panel WHERE k IN (SELECT k FROM c)""",
)
def sampled_keys_rows(spark, folder):
    return shown(select.sample_keys(P.part_week(spark, folder), P.WEEKLY, 500))


@query(
    "sampled_rows",
    f"""SELECT l_orderkey, {n("l_linenumber")} AS l_linenumber, l_partkey, l_suppkey, {r("l_quantity")} AS l_quantity FROM lineitem
ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, 42)), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 2000""",
)
def sampled_rows(spark, folder):
    identity = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return shown(select.sample_rows(table(spark, folder, "lineitem"), 2000, identity).select(*identity, "l_quantity"))


@query("distinct_keys", "SELECT DISTINCT user_id AS k, event_type AS t FROM events")
def distinct_keys(spark, folder):
    return P.user_type_day(spark, folder).select("k", "t").distinct()


@query(
    "filled_time_gaps",
    f"""{GAPS} SELECT k, t, {s("d")} AS d, y, x, {n("inserted")} AS "_was_imputed" FROM filled""",
)
def filled_time_gaps(spark, folder):
    return shown(fill_time_gaps(P.user_type_day(spark, folder), P.DAILY_BY_TYPE))


@query(
    "completed_part_weeks",
    f"""{P.with_grid(P.PART_WEEK)} SELECT k, count(*) AS n_rows, count(*) FILTER (y = 0) AS n_zero, {r("sum(y)")} AS total, {s("max(d)")} AS last_d FROM filled GROUP BY k""",
)
def completed_part_weeks(spark, folder):
    full = complete_panel(P.part_week(spark, folder), P.WEEKLY)
    return shown(
        full.groupBy("k").agg(
            F.count("*").alias("n_rows"), F.count(F.when(F.col("y") == 0, 1)).alias("n_zero"),
            F.sum("y").alias("total"), F.max("d").alias("last_d"),
        )
    )
