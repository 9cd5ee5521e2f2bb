"""Tweedie models of a search: those of MLlib, in few rounds that all sets share."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import learners, reweighted, splits, tuning
from seriesloom.operators.features import FeatureBuilder
from workload import panels as P


def test_sets_share_rounds_and_meet_mllib(spark, monkeypatch):
    """Weekly rows have calendar columns that never vary. Three sets of a fold share its passes; MLlib took 25 rounds a set."""
    rows = spark.range(1200).selectExpr("id % 4 AS k", "date_add(DATE'2020-01-06', CAST(id div 4 * 7 AS INT)) AS d", "CAST(id * id % 17 + (id % 4) * 3 AS DOUBLE) AS y")
    builder = FeatureBuilder(P.WEEKLY, lags=(1, 2), rolling_windows=(), ewm_halflives=(4.0,))
    passes, add = [], reweighted.sums
    monkeypatch.setattr(reweighted, "sums", lambda *a: (passes.append(1), add(*a))[1])
    folds = splits.expanding_day_folds(rows, P.DAILY, 2, 70)
    base = {"objective": "tweedie", "variance_power": 1.3}
    out = tuning.grid_search(rows, builder, folds, base, {"l2": [0.01, 0.1, 1.0]}).collect()
    assert len(passes) < 2 * 14
    full = builder.transform(rows)
    for r in out:
        for f in folds:
            train, valid = folds.pair(full, P.WEEKLY, f.fold)
            model = learners.PanelRegressor(builder, {**base, "l2": r.l2}).fit(train, "y")
            alone = model.predict(valid).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)))).first()[0]
            assert r[f"fold{f.fold}"] == pytest.approx(alone, rel=2e-5)


def test_negative_labels_are_an_error(spark):
    rows = spark.range(400).selectExpr("id % 4 AS k", "date_add(DATE'2020-01-06', CAST(id div 4 * 7 AS INT)) AS d", "CAST(id % 7 - 1 AS DOUBLE) AS y")
    builder = FeatureBuilder(P.WEEKLY, lags=(1,), rolling_windows=(), ewm_halflives=())
    folds = splits.expanding_day_folds(rows, P.DAILY, 1, 70)
    with pytest.raises(ValueError, match="negative"):
        tuning.grid_search(rows, builder, folds, {"objective": "tweedie"}, {"l2": [0.1]})
