"""Results of learned models: complete frames, finite and ordered values, parts that make the whole, order among trials."""

import math

import pytest

from __spark_entry__ import queries

FOLDER = "/root/testdata/sf0.001"


def finite(*values):
    return all(v is not None and math.isfinite(v) for v in values)


def forecasts(rows, horizon=8):
    per = {}
    for r in rows:
        assert finite(r.yhat)
        per.setdefault(r.k, []).append(r.horizon)
    assert per and all(sorted(h) == list(range(1, horizon + 1)) for h in per.values())


def not_constant(rows):
    forecasts(rows)
    assert len({round(r.yhat, 3) for r in rows}) > 3


def tweedie(rows):
    not_constant(rows)
    assert all(r.yhat >= 0 for r in rows)


def quantiles(rows):
    assert all(finite(r.lower, r.upper, r.q0_50) and r.lower <= r.q0_50 <= r.upper for r in rows)
    assert any(r.lower < r.upper for r in rows)


def out_of_fold(rows):
    assert {r.fold for r in rows} == {0, 1, 2}
    assert all(finite(r.yhat) and r.yhat >= 0 for r in rows)
    mean = sum(r.y for r in rows) / len(rows)
    assert sum((r.y - r.yhat) ** 2 for r in rows) < 1.5 * sum((r.y - mean) ** 2 for r in rows)


def grid(rows):
    assert {(r.max_depth, round(r.learning_rate, 1)) for r in rows} == {(2, 0.1), (2, 0.3), (4, 0.1), (4, 0.3)}
    for r in rows:
        assert r.mean_score == pytest.approx(sum(r[f"fold{i}"] for i in range(4)) / 4, abs=1e-5) and r.mean_score > 0


def history(rows):
    rows = sorted(rows, key=lambda r: r.trial)
    assert [r.trial for r in rows] == list(range(6))
    for i, r in enumerate(rows):
        assert 1.1 <= r.variance_power <= 1.8 and 1e-3 <= r.l2 <= 1.0
        assert r.best_so_far == pytest.approx(min(x.value for x in rows[: i + 1]), abs=1e-5)


def importance(rows):
    for kind in ("gain", "split"):
        own = [r for r in rows if r.kind == kind]
        assert sum(r.importance_pct for r in own) == pytest.approx(100, abs=1e-3) and all(r.importance >= 0 for r in own)


def permutation(rows):
    assert all(r.base > 0 and r.shuffled > 0 and r.increase == pytest.approx(r.shuffled - r.base, abs=1e-5) for r in rows)
    assert max(r.increase for r in rows) > 0


def attributions(rows):
    per = {}
    for r in rows:
        per.setdefault((r.k, r.d), []).append(r)
    for own in per.values():
        assert own[0].base_value + sum(r.contribution for r in own) == pytest.approx(own[0].link, abs=1e-3)


def totals(rows):
    assert all(abs(r["mean"]) <= r.mean_abs + 1e-6 for r in rows) and max(r.mean_abs for r in rows) > 0


def dependence(rows):
    # One coefficient: contributions lie on a line over the week.
    points = sorted({(r.week, round(r.contribution, 4)) for r in rows})
    assert len(points) > 1
    (x0, y0), (x1, y1) = points[0], points[-1]
    assert all(y == pytest.approx(y0 + (y1 - y0) * (x - x0) / (x1 - x0), abs=1e-3) for x, y in points)


def ranking(rows):
    assert {r.model for r in rows} == {"seasonal_naive", "recursive", "direct", "quantile", "additive"}
    assert all(finite(r.MAE, r.RMSE) and 0 < r.MAE <= r.RMSE for r in rows)


def workflow(rows):
    forecasts(rows, 12)
    assert len({r.model for r in rows}) > 1


CHECKS = {
    "recursive_forecast": not_constant, "direct_forecast": not_constant, "causal_forecast": not_constant, "tweedie_forecast": tweedie, "quantile_forecast": quantiles,
    "out_of_fold_predictions": out_of_fold, "grid_search_scores": grid, "random_search_history": history, "gain_and_split_importance": importance,
    "permutation_importance": permutation, "linear_attributions": attributions, "local_attributions": attributions, "attribution_totals": totals,
    "dependence_on_week": dependence, "bake_off_ranking": ranking, "univariate_workflow": workflow,
}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_results_of(spark, name):
    rows = queries()[name](spark, FOLDER).collect()
    assert rows
    CHECKS[name](rows)
