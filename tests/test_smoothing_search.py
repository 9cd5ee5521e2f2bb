"""Refined smoothing parameters against plain loops over the same lattice."""

import datetime as dt

import numpy as np
import pytest

from seriesloom import make_spec
from seriesloom.operators.forecast import Smoothing, exponential_smoothing, smoothing_parameters

SPEC = make_spec("d", "y", ["k"], frequency="D")
START = dt.date(2024, 1, 1)


def errors(ys, m, trend, par):
    """Squared error and final state in plain Python."""
    a, b, g, p = par
    if m > 1:
        level, season = np.mean(ys[:m]), [v - np.mean(ys[:m]) for v in ys[:m]]
        slope, rest = ((np.mean(ys[m : 2 * m]) - level) / m if trend else 0.0), ys[m:]
    else:
        level, slope, season, rest = ys[0], (ys[1] - ys[0] if trend else 0.0), [0.0], ys[1:]
    total = 0.0
    for v in rest:
        err = v - (level + slope * p + season[0])
        level, slope = level + slope * p + a * err, slope * p + a * b * err
        season = season[1:] + [season[0] + g * err] if m > 1 else season
        total += err * err
    return total, level, slope


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    made = {
        "trend": [10 + 0.7 * i + rng.normal(0, 2) for i in range(50)],
        "walk": list(np.cumsum(rng.normal(0, 1, 50)) + 30),
        "week": [20 + 5 * (i % 7) + 0.1 * i + rng.normal(0, 1) for i in range(50)],
        "flat": [4.0] * 20,
        "two": [1.0, 5.0],
        "one": [3.0],
    }
    rows = [(k, START + dt.timedelta(i), float(v)) for k, ys in made.items() for i, v in enumerate(ys)] + [("none", START, None), ("trend", START + dt.timedelta(50), None)]
    return spark.createDataFrame(rows, "k string, d date, y double"), made


@pytest.mark.parametrize("kind", [Smoothing(trend=False), Smoothing(), Smoothing(damped=True), Smoothing(season_length=7)])
def test_no_neighbour_and_no_set_of_the_grid_is_better(panel, kind):
    df, made = panel
    found = {r.k: r for r in smoothing_parameters(df, SPEC, kind).collect()}
    assert found.keys() == {*made, "none"}
    need = 14 if kind.seasonal else 2 if kind.trend else 1
    for key, row in found.items():
        ys = made.get(key, [])
        assert row.n == len(ys)
        if len(ys) < need:
            assert row.alpha is None and row.sse is None
            continue
        best = (row.alpha, row.beta, row.gamma, row.phi)
        least = errors(ys, kind.season_length, kind.trend, best)[0]
        assert row.sse == pytest.approx(least, rel=1e-9, abs=1e-9)
        assert all(least <= errors(ys, kind.season_length, kind.trend, s)[0] + 1e-9 for s in kind.sets)
        free = [0, *([1] if kind.trend else []), *([2] if kind.seasonal else []), *([3] if kind.damped else [])]
        for c in free:
            for by in (-0.001, 0.001):
                near = list(best)
                near[c] = min(max(near[c] + by, 0.001), 0.999)
                assert least <= errors(ys, kind.season_length, kind.trend, near)[0] * (1 + 1e-9) + 1e-9


def test_forecasts_follow_the_refined_parameters(panel):
    df, made = panel
    found = {r.k: r for r in smoothing_parameters(df, SPEC).collect()}
    made_ahead = {(r.k, r.horizon): r.yhat for r in exponential_smoothing(df, SPEC, 3, refine=100).collect()}
    assert len(made_ahead) == 3 * (len(made) + 1)
    for key, ys in made.items():
        if len(ys) < 2:
            assert made_ahead[key, 1] is None
            continue
        row = found[key]
        _, level, slope = errors(ys, 1, True, (row.alpha, row.beta, row.gamma, row.phi))
        assert [made_ahead[key, h] for h in (1, 2, 3)] == pytest.approx([level + h * slope for h in (1, 2, 3)])
