"""Quantile models: coefficients, forecasts and held-out coverage, with the same rounds in recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators.pinball import PinballRegressor
from workload.closedform import _ROWS, LAGS
from workload.pipelines import _split
from workload.registry import n, query, r, s, shown

ROUNDS = 12
FEATURES = ["y_lag_1", "y_lag_2"]

# Centred sums of one weighted problem with two features give both slopes; `tilt` moves the right side by the share of q.
_SOLVE = """(s22 * (s1y + t1) - s12 * (s2y + t2)) / (s11 * s22 - s12 * s12) AS b1, (s11 * (s2y + t2) - s12 * (s1y + t1)) / (s11 * s22 - s12 * s12) AS b2"""
_FIT = f"""{_ROWS}, u AS MATERIALIZED (SELECT y, l1, l2 FROM x WHERE part = 'train' AND l2 IS NOT NULL), dev AS (SELECT 0.001 * stddev_pop(y) AS eps FROM u),
 s0 AS (SELECT avg(y) AS my, avg(l1) AS m1, avg(l2) AS m2, covar_pop(l1, l1) AS s11, covar_pop(l2, l2) AS s22, covar_pop(l1, l2) AS s12, covar_pop(l1, y) AS s1y, covar_pop(l2, y) AS s2y, 0 AS t1, 0 AS t2 FROM u),
 c0 AS (SELECT my, m1, m2, {_SOLVE} FROM s0),
 it AS (SELECT q, 1 AS i, my - b1 * m1 - b2 * m2 AS a, b1, b2 FROM c0, (VALUES (0.1::DOUBLE), (0.5), (0.9)) v(q) UNION ALL
  SELECT q, i, my + tilt / sw - b1 * m1 - b2 * m2, b1, b2 FROM (SELECT *, {_SOLVE} FROM (
   SELECT q, i, sw, tilt, swy / sw AS my, sw1 / sw AS m1, sw2 / sw AS m2, w11 - sw1 * sw1 / sw AS s11, w22 - sw2 * sw2 / sw AS s22, w12 - sw1 * sw2 / sw AS s12,
    w1y - sw1 * swy / sw AS s1y, w2y - sw2 * swy / sw AS s2y, (2 * q - 1) * (x1 - n * sw1 / sw) AS t1, (2 * q - 1) * (x2 - n * sw2 / sw) AS t2
   FROM (SELECT q, i + 1 AS i, count(*) AS n, (2 * q - 1) * count(*) AS tilt, sum(l1) AS x1, sum(l2) AS x2, sum(w) AS sw, sum(w * y) AS swy, sum(w * l1) AS sw1, sum(w * l2) AS sw2,
     sum(w * l1 * l1) AS w11, sum(w * l2 * l2) AS w22, sum(w * l1 * l2) AS w12, sum(w * l1 * y) AS w1y, sum(w * l2 * y) AS w2y
    FROM (SELECT q, i, y, l1, l2, 1 / (eps + abs(y - a - b1 * l1 - b2 * l2)) AS w FROM it, u, dev WHERE i < {ROUNDS}) GROUP BY q, i)))),
 fit AS (SELECT q, a, b1, b2 FROM it WHERE i = {ROUNDS})"""


def _model(rows):
    train = rows.filter("split = 'train' AND y_lag_2 IS NOT NULL")
    return PinballRegressor(LAGS, (0.1, 0.5, 0.9), FEATURES, max_iter=ROUNDS, tolerance=0.0).fit(train, "y")


@query(
    "pinball_coefficients",
    f"""{_FIT} SELECT q AS quantile, unnest(['intercept', 'y_lag_1', 'y_lag_2']) AS term, unnest([{r("a", 3)}, {r("b1", 3)}, {r("b2", 3)}]) AS value FROM fit""",
)
def pinball_coefficients(spark, folder):
    """Twelve rounds of the models of three quantiles on two lags."""
    model = _model(LAGS.transform(_split(spark, folder).frame))
    cells = [(q, t, v) for q, terms in model.coefficients().items() for t, v in terms.items()]
    return shown(spark.createDataFrame(cells, "quantile double, term string, value double"), 3)


@query(
    "pinball_coverage",
    f"""{_FIT}, p AS (SELECT k, part, y, (SELECT list_sort(list(a + b1 * l1 + b2 * l2)) FROM fit) AS f FROM x WHERE l2 IS NOT NULL)
SELECT k, part AS split, {n("count(*)")} AS n, {r("avg(f[1])", 3)} AS q0_10, {r("avg(f[2])", 3)} AS q0_50, {r("avg(f[3])", 3)} AS q0_90,
 {n("count(*) FILTER (y <= f[1])")} AS below_10, {n("count(*) FILTER (y <= f[2])")} AS below_50, {n("count(*) FILTER (y <= f[3])")} AS below_90 FROM p GROUP BY k, part""",
)
def pinball_coverage(spark, folder):
    """Mean quantiles and numbers of rows at or below them, per key and part; test rows are held out."""
    rows = LAGS.transform(_split(spark, folder).frame)
    made = _model(rows).predict(rows.filter("y_lag_2 IS NOT NULL"))
    names = ["q0_10", "q0_50", "q0_90"]
    below = [F.count(F.when(F.col("y") <= F.col(c), 1)).alias(f"below_{c[3:]}") for c in names]
    return shown(made.groupBy("k", "split").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names], *below), 3)
