"""STL as array expressions against the arrays of numpy."""

import datetime as dt

import numpy as np
import pytest

from seriesloom.operators import tsstats
from seriesloom.spec import PanelSpec

SPEC = PanelSpec("d", "y", ("k",), frequency="D")


@pytest.mark.parametrize("period,seasonal,trend", [(7, 7, None), (4, 13, None), (12, 7, 15)])
def test_equals_numpy(spark, period, seasonal, trend):
    rng = np.random.default_rng(period)
    series = {n: 10 + 0.1 * np.arange(n) + 3 * np.sin(2 * np.pi * np.arange(n) / period) + rng.normal(size=n) for n in (2 * period, 2 * period + 1, 5 * period + 2, 90, 131)}
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for k, y in series.items() for i, v in enumerate(y)]
    rows += [(1, dt.date(2024, 1, 1), 5.0), (2, dt.date(2024, 1, 1), None)] + [(None, d, y) for k, d, y in rows if k == 90]
    out = tsstats.stl_decompose(spark.createDataFrame(rows, "k long, d date, y double").repartition(3), SPEC, period, seasonal, trend)
    assert "Pandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.orderBy("k", "d").collect():
        got.setdefault(r.k, []).append(r)
    assert {r.error for k in (1, 2) for r in got[k]} == {"fewer than two periods of values"} and got[1][0].y == 5.0
    for k, y in [*series.items(), (None, series[90])]:
        t, s = tsstats.stl_arrays(y, period, seasonal, trend)
        np.testing.assert_allclose([r.trend for r in got[k]], t, atol=1e-8)
        np.testing.assert_allclose([r.seasonal for r in got[k]], s, atol=1e-8)
        np.testing.assert_allclose([r.resid for r in got[k]], y - t - s, atol=1e-8)
