"""The grid of power exponents: one aggregate for all its values, with the same maximum per key."""

import numpy as np
import pytest

from seriesloom.operators import transforms


def best(y, grid):
    lik = []
    for lam in grid:
        t = np.log1p(y) if abs(lam) < 1e-12 else ((1 + y) ** lam - 1) / lam
        lik.append(-len(y) / 2 * np.log(t.var()) + (lam - 1) * np.log1p(y).sum())
    return grid[int(np.argmax(lik))]


def test_grid_values_share_one_aggregate(spark):
    rng = np.random.default_rng(4)
    series = {k: rng.gamma(2.0, k, 80) for k in (1, 3, 9)}
    rows = [(k, float(v)) for k, vs in series.items() for v in vs] + [(0, 2.0)] * 5 + [(None, float(v)) for v in series[3]]
    df = spark.createDataFrame(rows, "k int, y double")
    fit = transforms.fit_yeo_johnson(df, "y", ["k"], rounds=0)
    assert fit._jdf.queryExecution().optimizedPlan().toString().count("var_pop") <= 2
    got = {r["k"]: r["lambda"] for r in fit.collect()}
    assert set(got) == {0, 1, 3, 9, None} and got[0] is None and got[None] == got[3]
    for k, y in series.items():
        assert got[k] == pytest.approx(best(y, [-2.0 + 0.15 * i for i in range(41)]))
    whole = transforms.fit_yeo_johnson(df.filter("k = 9"), "y", [], rounds=0).collect()
    assert [r["lambda"] for r in whole] == [got[9]]
    assert [tuple(r) for r in transforms.fit_yeo_johnson(df.filter("k = 77"), "y", [], rounds=2).collect()] == [(None, None)]
