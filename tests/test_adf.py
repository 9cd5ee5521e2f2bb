"""ADF from aggregates and sweeps against least squares on explicit designs."""

import datetime as dt
import math

import numpy as np
import pytest

from seriesloom.operators import tsstats
from seriesloom.spec import PanelSpec

SPEC = PanelSpec("d", "y", ("k",), frequency="D")


def by_least_squares(y, regression, max_lag):
    """(statistic, lag, rows): every lag order is fitted on its own design over common rows, the best one over all of its own."""
    n, extra = len(y), {"n": 0, "c": 1, "ct": 2}[regression]
    top = max_lag if max_lag is not None else math.ceil(12 * (n / 100) ** 0.25)
    top = max(min(top, n // 2 - extra - 1), 0)
    dy = np.diff(y)

    def fit(lag, start):
        rows = np.arange(start, len(dy))
        x = np.column_stack([y[rows], *[dy[rows - k] for k in range(1, lag + 1)], *[np.ones(len(rows)), rows + 1.0][:extra]])
        beta, *_ = np.linalg.lstsq(x, dy[rows], rcond=None)
        return x, beta, float(((dy[rows] - x @ beta) ** 2).sum())

    scores = {}
    for lag in range(top + 1):
        x, _, rss = fit(lag, top)
        if rss > 0 and len(x) > x.shape[1]:
            scores[lag] = len(x) * (math.log(2 * math.pi * rss / len(x)) + 1) + 2 * x.shape[1]
    best = min(scores, key=scores.get) if scores else 0
    x, beta, rss = fit(best, best)
    dof = len(x) - x.shape[1]
    return beta[0] / math.sqrt(rss / dof * np.linalg.pinv(x.T @ x)[0, 0]), best, len(x)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(12)
    out = {"walk": np.cumsum(rng.normal(size=300)) + 1000, "noise": rng.normal(size=240) + 5, "trend": np.arange(150) * 0.3 + rng.normal(size=150)}
    wave = np.zeros(400)
    for t in range(8, 400):
        wave[t] = 0.5 * wave[t - 1] - 0.3 * wave[t - 5] + 0.4 * wave[t - 7] + rng.normal()
    out["lags"] = wave
    out |= {f"short{n}": rng.normal(size=n) for n in (10, 11, 12, 15, 20)}
    out["large"] = 1e6 + np.cumsum(rng.normal(size=200))
    return out


@pytest.mark.parametrize("regression,max_lag", [("c", None), ("ct", None), ("n", None), ("c", 0), ("c", 3)])
def test_equals_least_squares(spark, series, regression, max_lag):
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=2 * i + e), float(v) if e == 0 else None) for k, y in series.items() for i, v in enumerate(y) for e in (0, 1)]
    rows += [("constant", dt.date(2020, 1, 1) + dt.timedelta(days=i), 3.0) for i in range(40)] + [("few", dt.date(2020, 1, 1), 1.0), ("none", dt.date(2020, 1, 1), None)]
    rows += [(None, *r[1:]) for r in rows if r[0] == "walk"]
    df = spark.createDataFrame(rows, "k string, d date, y double").repartition(5)
    found = tsstats.adf_test(df, SPEC, regression=regression, max_lag=max_lag)
    assert "Pandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r for r in found.collect()}
    assert got.keys() == {*series, "constant", "few", "none", None}
    assert (got["constant"].error, got["constant"].statistic, got["constant"].n_obs) == ("constant series", None, 40)
    assert (got["few"].error, got["few"].n_obs, got["none"].n_obs) == ("fewer than 10 observations", 1, 0)
    for k, y in series.items():
        if regression == "n" and k in ("large", "walk"):
            continue  # without a constant the level cannot be shifted, and its square swamps the rest
        # A constant takes up any shift; without one, numpy would lose small moves beside a large level.
        stat, lag, n = by_least_squares(y if regression == "n" else y - y.mean(), regression, max_lag)
        assert (k, got[k].used_lag, got[k].n_obs) == (k, lag, n)
        assert got[k].statistic == pytest.approx(stat, rel=1e-6)
        assert got[k].stationary == (got[k].statistic < got[k].critical_5pct)
    assert got[None].statistic == pytest.approx(got["walk"].statistic)
