"""Ties of sums that differ in their last digits."""

from __future__ import annotations

from seriesloom.operators import forecast as FC
from workload import panels as P


def test_equal_scores_tie_whatever_the_order_of_their_sums(spark):
    """Scores that differ in the last digits of a double are equal: the model name decides. True differences still count."""
    a = 0.1 + 0.2 + 0.3
    b = 0.3 + 0.2 + 0.1
    assert a > b
    rows = [(1, "mean", a), (1, "naive", b), (2, "mean", a + 1e-8), (2, "naive", b), (3, "mean", 3e-9), (3, "naive", 2e-9), (4, "mean", None), (4, "naive", 5e12), (5, "mean", None)]
    scored = spark.createDataFrame(rows, "k long, model string, MAE double")
    best = {r.k: r.model for r in FC.best_model_per_key(scored, P.WEEKLY).collect()}
    assert best == {1: "mean", 2: "naive", 3: "naive", 4: "naive", 5: None}


def test_parts_follow_counted_rows(spark, monkeypatch):
    """Rows that grow behind an exchange are dealt by their number; adaptive execution does not merge these parts."""
    from seriesloom import session

    monkeypatch.setattr(session, "ROWS_PER_PART", 100)
    rows = spark.range(5000).selectExpr("id % 500 AS k", "id AS v")
    parts = session.dealt(rows, "k").selectExpr("k", "spark_partition_id() AS p").groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 5000
    assert len(parts) > 40 and max(r["count"] for r in parts) < 500


def test_a_fold_learns_its_key_means_once_for_all_sets(spark, monkeypatch):
    from seriesloom.operators import learners, splits, tuning
    from seriesloom.operators.features import FeatureBuilder

    rows = spark.range(400).selectExpr("id % 4 AS k", "date_add(DATE'2024-01-01', CAST(id div 4 * 7 AS INT)) AS d", "CAST(id % 7 AS DOUBLE) AS y")
    builder = FeatureBuilder(P.WEEKLY, lags=(1,), rolling_windows=(), ewm_halflives=())
    calls = []
    learn = learners.PanelRegressor._learn_encodings
    monkeypatch.setattr(learners.PanelRegressor, "_learn_encodings", lambda self, *a: (calls.append(1), learn(self, *a))[1])
    folds = splits.expanding_day_folds(rows, P.DAILY, 2, 70)
    base = {"objective": "least_squares"}
    scored = tuning.grid_search(rows, builder, folds, base, {"l2": [0.0, 0.5, 5.0]}).collect()
    assert len(calls) == len(folds) and len(scored) == 3
    assert len({r["fold0"] for r in scored}) == 3


def test_parts_follow_the_periods_to_come(spark, monkeypatch):
    """Two rows a key that become years of days are dealt by the days."""
    from seriesloom import session
    from seriesloom.operators.grid import dealt_by_periods, fill_time_gaps

    monkeypatch.setattr(session, "ROWS_PER_PART", 1000)
    ends = spark.range(200).selectExpr("id div 2 AS k", "date_add(DATE'2024-01-01', CAST(id % 2 * 999 AS INT)) AS d", "1.0D AS y")
    full = fill_time_gaps(dealt_by_periods(ends, P.DAILY), P.DAILY)
    parts = full.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 100_000
    assert len(parts) > 40 and max(r["count"] for r in parts) < 10_000
