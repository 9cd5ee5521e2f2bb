"""Walk-forward validation against a plain loop that refits every origin from its whole history."""

import datetime as dt
import random

import pytest

from seriesloom.operators import walkforward as WF
from seriesloom.spec import PanelSpec

SPEC = PanelSpec("d", "y", ("k",), frequency="D")
DAY = dt.date(2024, 1, 1)


def croston(ys, h, alpha, factor):
    z = p = y = None
    m, gap = 0, 0
    for v in ys:
        gap += 1
        if v is not None and v > 0:
            z, p = (v, gap) if m == 0 else (z + alpha * (v - z), p + alpha * (gap - p))
            m, gap, y = m + 1, 0, v
    return 0.0 if m == 0 else y / len(ys) if m == 1 else z / p * factor


def tsb(ys, h, alpha, beta):
    z, c = None, 0.0
    for i, v in enumerate(ys, 1):
        if v is not None and v > 0:
            z, c = (v, 1 / i) if z is None else (z + alpha * (v - z), c + beta * (1 - c))
        else:
            c *= 1 - beta
    return 0.0 if z is None else z * c


def holt(ys, h, alpha, beta, phi):
    known = [v for v in ys if v is not None]
    if len(known) < (1 if beta is None else 2):
        return None
    level, trend = known[0], 0.0
    for i, v in enumerate(known[1:]):
        if i == 0 and beta is not None:
            trend = v - level
        error = v - level - phi * trend
        level, trend = level + phi * trend + alpha * error, phi * trend + alpha * (beta or 0) * error
    return level + sum(phi**j for j in range(1, h + 1)) * trend


def drift(ys, h):
    at = [i for i, v in enumerate(ys) if v is not None]
    if not at:
        return None
    slope = (ys[at[-1]] - ys[at[0]]) / (at[-1] - at[0]) if len(at) > 1 else 0.0
    return ys[at[-1]] + slope * (len(ys) - 1 - at[-1] + h)


def known(ys):
    return [v for v in ys if v is not None]


FORMS = {
    "naive": (lambda: WF.naive(), lambda ys, h: known(ys)[-1] if known(ys) else None),
    "mean": (lambda: WF.mean(), lambda ys, h: sum(known(ys)) / len(known(ys)) if known(ys) else None),
    "drift": (lambda: WF.drift(), drift),
    "seasonal": (lambda: WF.seasonal_naive(7), lambda ys, h: ys[len(ys) - 7 + (h - 1) % 7] if len(ys) >= 7 else None),
    "one": (lambda: WF.seasonal_naive(1), lambda ys, h: ys[-1] if ys else None),
    "ses": (lambda: WF.smoothing(0.4), lambda ys, h: holt(ys, h, 0.4, None, 1.0)),
    "holt": (lambda: WF.smoothing(0.4, 0.2), lambda ys, h: holt(ys, h, 0.4, 0.2, 1.0)),
    "damped": (lambda: WF.smoothing(0.4, 0.2, 0.9), lambda ys, h: holt(ys, h, 0.4, 0.2, 0.9)),
    "croston": (lambda: WF.croston(0.2), lambda ys, h: croston(ys, h, 0.2, 1.0)),
    "sba": (lambda: WF.croston(0.2, "sba"), lambda ys, h: croston(ys, h, 0.2, 0.9)),
    "tsb": (lambda: WF.tsb(0.2, 0.3), lambda ys, h: tsb(ys, h, 0.2, 0.3)),
}


@pytest.fixture(scope="module")
def series():
    rng = random.Random(8)
    out = {}
    for k, size in enumerate((1, 2, 9, 10, 11, 12, 40, 40)):
        out[k] = [rng.choice([0.0, 0.0, rng.uniform(1, 9), None if k != 7 else 3.0]) for _ in range(size)]
    out[None] = [rng.uniform(0, 5) for _ in range(25)]
    out[20] = [None] * 15
    return out


@pytest.mark.parametrize("name", sorted(FORMS))
def test_equals_a_refit_at_every_origin(spark, series, name):
    make, plain = FORMS[name]
    form = make()
    rows = [(k, DAY + dt.timedelta(days=i), y) for k, ys in series.items() for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "k long, d date, y double").repartition(4)
    want = {}
    for k, ys in series.items():
        for origin in range(len(ys) - 10, len(ys) - 3 + 1, 2) if len(ys) > 10 else ():
            for h in (1, 2, 3):
                made = plain(ys[:origin], h)
                if made is not None:
                    want[k, DAY + dt.timedelta(days=origin + h - 1)] = (ys[origin + h - 1], made, DAY + dt.timedelta(days=origin - 1), h)
    got = {(r.k, r.d): r for r in WF.walk_forward(df, SPEC, form, 10, 2, 3).collect()}
    assert got.keys() == want.keys()
    for at, (actual, made, origin, h) in want.items():
        assert (got[at].actual, got[at].origin, got[at].horizon) == (actual, origin, h)
        assert got[at].predicted == pytest.approx(made)


def test_one_exchange_and_no_python(spark, series):
    rows = [(k, DAY + dt.timedelta(days=i), y) for k, ys in series.items() for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "k long, d date, y double")
    plan = WF.walk_forward(df, SPEC, WF.smoothing(0.3, 0.1), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Pandas" not in plan


def test_bad_sizes_are_refused(spark, series):
    df = spark.createDataFrame([(1, DAY, 1.0)], "k long, d date, y double")
    with pytest.raises(ValueError):
        WF.walk_forward(df, SPEC, WF.naive(), 0)
    assert WF.walk_forward(df, SPEC, WF.naive(), 5).count() == 0
