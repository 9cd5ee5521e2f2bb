"""Boosted trees over stored blocks: the splits of least error, shared passes, draws and stops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import boosting, learners, splits, tuning
from seriesloom.operators.blocks import Blocks
from seriesloom.operators.features import FeatureBuilder
from workload import panels as P

TREE = {"objective": "regression", "subsample": 1.0, "learning_rate": 0.5, "max_iter": 3, "max_depth": 2, "min_rows": 5, "max_bins": 400}


def grown(x, y, depth, fewest):
    """Values of one tree by brute force: the best cut of all, again in both halves."""
    best = None
    for j in range(x.shape[1]):
        for cut in (np.unique(x[:, j])[1:] + np.unique(x[:, j])[:-1]) / 2:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= fewest:
                error = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
                if best is None or error < best[0] - 1e-9:
                    best = error, left
    if not depth or best is None or best[0] >= ((y - y.mean()) ** 2).sum() - 1e-9:
        return np.full(len(y), y.mean())
    out = np.empty(len(y))
    for side in (best[1], ~best[1]):
        out[side] = grown(x[side], y[side], depth - 1, fewest)
    return out


def table(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = 4 * (x[:, 0] > 0.3) + 2 * (x[:, 1] > x[:, 0]) + rng.normal(size=n)
    rows = [(i, *map(float, x[i]), float(y[i]), 1 if i % 3 else 2) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "i long, a double, b double, c double, y double, part int").withColumn("w", F.lit(1.0)).withColumnRenamed("w", "_weight").repartition(5, "i")


def test_trees_are_those_of_brute_force(spark):
    x, y, df = table(spark)
    store = Blocks.of(df.withColumn("all", F.lit(1)), ["a", "b", "c", "y", "all", "_weight"], ["i"])
    (model,), _ = boosting.boost(store, ["a", "b", "c"], [boosting.Job(TREE, "y", "all", ["a", "b", "c"])])
    store.drop()
    want = grown(x, y, 2, 5)
    for _ in range(2):
        want = want + 0.5 * grown(x, 2 * (y - want), 2, 5)
    got = [r.p for r in df.withColumn("p", model.expression(F.col)).orderBy("i").collect()]
    assert got == pytest.approx(want, abs=1e-9)


def test_draws_do_not_depend_on_the_layout(spark):
    """Two thirds of the rows learn, the others end the growth; the model is the same over one part and over many."""
    _, _, df = table(spark)
    params = {**TREE, "subsample": 0.7, "max_iter": 30, "max_bins": 16}
    made = []
    for parts in (1, 7):
        store = Blocks.of(df.repartition(parts), ["a", "b", "c", "y", "part", "_weight"], ["i"])
        (model,), _ = boosting.boost(store, ["a", "b", "c"], [boosting.Job(params, "y", "part", ["a", "b", "c"], True)])
        store.drop()
        made.append([(t.splits.keys(), list(t.feature), list(t.cut)) for t in model.trees])
    assert made[0] == made[1] and 1 <= len(made[0]) < 30


def test_sets_of_a_fold_share_passes_and_features(spark, monkeypatch):
    """Two folds, four sets of two rounds: a pass per level of the deepest set, features stored once for all folds."""
    rows = spark.range(1200).selectExpr("id % 4 AS k", "date_add(DATE'2020-01-06', CAST(id div 4 * 7 AS INT)) AS d", "CAST(id * id % 17 AS DOUBLE) AS y")
    builder = FeatureBuilder(P.WEEKLY, lags=(1, 2), rolling_windows=(), ewm_halflives=())
    passes, stores = [], []
    add, of = boosting.sums, Blocks.of.__func__
    monkeypatch.setattr(boosting, "sums", lambda *a: (passes.append(1), add(*a))[1])
    monkeypatch.setattr(Blocks, "of", classmethod(lambda cls, *a: (stores.append(1), of(cls, *a))[1]))
    folds = splits.expanding_day_folds(rows, P.DAILY, 2, 70)
    out = tuning.grid_search(rows, builder, folds, {**TREE, "max_iter": 2, "max_bins": 16}, {"max_depth": [1, 3], "learning_rate": [0.1, 0.5]}).collect()
    assert len(passes) == 2 * 2 * 3 and len(stores) == 1
    # The scores are those of models fitted and judged alone.
    f = folds.items[0]
    full = builder.transform(rows)
    train, valid = folds.pair(full, P.WEEKLY, f.fold)
    for r in out:
        params = {**TREE, "max_iter": 2, "max_bins": 16, "max_depth": r.max_depth, "learning_rate": r.learning_rate}
        model = learners.PanelRegressor(builder, params).fit(train, "y")
        alone = model.predict(valid).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)))).first()[0]
        assert r.fold0 == pytest.approx(alone, abs=1e-9)


def panel(spark):
    return spark.range(1200).selectExpr("id % 4 AS k", "date_add(DATE'2020-01-06', CAST(id div 4 * 7 AS INT)) AS d", "CAST(id * id % 17 + id % 4 AS DOUBLE) AS y")


def test_horizons_share_passes_and_features(spark, monkeypatch):
    """Three horizons of two rounds: a pass per level and not per horizon; each model is the one fitted on its rows alone."""
    passes, stores = [], []
    add, of = boosting.sums, Blocks.of.__func__
    monkeypatch.setattr(boosting, "sums", lambda *a: (passes.append(1), add(*a))[1])
    monkeypatch.setattr(Blocks, "of", classmethod(lambda cls, *a: (stores.append(1), of(cls, *a))[1]))
    rows = panel(spark)
    builder = FeatureBuilder(P.WEEKLY, lags=(1, 2), rolling_windows=(), ewm_halflives=())
    params = {**TREE, "max_iter": 2, "max_bins": 16}
    direct = learners.DirectMultiHorizonForecaster(builder, (1, 2, 3), params).fit(rows)
    assert len(passes) == 2 * 2 and len(stores) == 1
    ahead = builder.transform(rows).withColumns({"_y2": F.lead("y", 2).over(P.WEEKLY.in_order())})
    alone = learners.PanelRegressor(builder, params).fit(ahead, "_y2")
    got = direct.models[2].predict(ahead).agg(F.avg("yhat"), F.stddev("yhat")).first()
    # Cut points come from all training rows, also the last ones, whose label lies beyond the end.
    want = alone.predict(ahead).agg(F.avg("yhat"), F.stddev("yhat")).first()
    assert got[0] == pytest.approx(want[0], rel=0.01) and got[1] == pytest.approx(want[1], rel=0.1)
    made = direct.predict(rows, "2030-01-01").collect()
    assert sorted((r.k, r.horizon) for r in made) == [(k, h) for k in range(4) for h in (1, 2, 3)]


def test_folds_share_stored_features(spark, monkeypatch):
    """Features of three folds are stored once; the predictions are those of models fitted fold by fold."""
    stores, of = [], Blocks.of.__func__
    monkeypatch.setattr(Blocks, "of", classmethod(lambda cls, *a: (stores.append(1), of(cls, *a))[1]))
    builder = FeatureBuilder(P.WEEKLY, lags=(1, 2), rolling_windows=(), ewm_halflives=())
    params = {**TREE, "max_iter": 2, "max_bins": 16}
    rows = builder.transform(panel(spark))
    oof, _ = learners.cross_validated_predictions(rows, builder, "y", ["k", "d"], 3, params)
    made = {(r.k, r.d): r for r in oof.collect()}
    assert len(stores) == 1 and len(made) == 1200
    fold = splits.time_fold(P.WEEKLY, *splits.date_span(rows, P.WEEKLY), 3)
    folded = rows.withColumn("_fold", fold.cast("int")).withColumn("_label", F.sqrt("y"))
    alone = learners.PanelRegressor(builder, params).fit(folded.filter("_fold <> 1"), "_label")
    for r in alone.predict(folded.filter("_fold = 1")).collect():
        own = made[r.k, r.d]
        assert own.fold == 1 and own.yhat == pytest.approx(max(r.yhat, 0.0) ** 2, abs=1e-6)
