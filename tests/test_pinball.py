"""Quantile models: optimality, order, weights, odd input and held-out coverage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom import make_spec
from seriesloom.operators.features import FeatureBuilder
from seriesloom.operators.pinball import PinballForecaster, PinballRegressor

SPEC = make_spec("d", "y", ["k"], frequency="D")
BUILDER = FeatureBuilder(SPEC, lags=(1,), rolling_windows=(), ewm_halflives=())
QS = (0.1, 0.5, 0.9)


def loss(y, fit, q):
    rest = y - fit
    return float(np.mean(rest * (q - (rest < 0))))


@pytest.fixture(scope="module")
def skewed(spark):
    """Deviation and skew grow with ``a``: the slopes of the quantiles differ."""
    rng = np.random.default_rng(7)
    a, b = rng.uniform(0, 10, 4000), rng.normal(0, 1, 4000)
    y = 3 + 2 * a - b + (0.5 + a) * (rng.exponential(1, 4000) - 1)
    return spark.createDataFrame([tuple(map(float, v)) for v in zip(a, b, y)], "a double, b double, y double"), np.column_stack([np.ones(4000), a, b]), y


def test_no_change_of_a_coefficient_lowers_the_loss(skewed):
    df, x, y = skewed
    model = PinballRegressor(BUILDER, QS, ["a", "b"], max_iter=200, tolerance=1e-8).fit(df, "y")
    for q, terms in model.coefficients().items():
        best = np.array(list(terms.values()))
        least = loss(y, x @ best, q)
        for j in range(3):
            for step in (-0.1, -0.02, 0.02, 0.1):
                moved = best + step * np.eye(3)[j]
                assert loss(y, x @ moved, q) > least - 1e-4
        assert np.mean(y <= x @ best) == pytest.approx(q, abs=0.01)
    falls = np.diff(np.array(model.losses), axis=0)
    assert np.all(falls <= 1e-3 * model.losses[0])


def test_fewer_features_than_quantiles_of_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, float(v)) for v in range(1, 102)], "a double, y double")
    terms = PinballRegressor(BUILDER, (0.25, 0.75), ["a"], max_iter=300, tolerance=1e-9).fit(df, "y").coefficients()
    assert [sum(t.values()) for t in terms.values()] == pytest.approx([26.0, 76.0], abs=0.6)


def test_weights_count_like_copies(skewed):
    df = skewed[0].limit(500).withColumn("w", F.when(F.col("a") > 5, 3.0).otherwise(1.0))
    weighted = PinballRegressor(BUILDER, QS, ["a", "b"], max_iter=30, tolerance=0.0, smoothing=1e-2).fit(df, "y", weight="w")
    copies = df.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    copied = PinballRegressor(BUILDER, QS, ["a", "b"], max_iter=30, tolerance=0.0, smoothing=1e-2).fit(copies, "y")
    for q in QS:
        assert list(weighted.coefficients()[q].values()) == pytest.approx(list(copied.coefficients()[q].values()), abs=0.1)


def test_odd_input(spark):
    schema = "a double, b double, y double"
    same = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (None, float("nan"), 5.0)], schema)
    made = PinballRegressor(BUILDER, QS, ["a", "b"]).fit(same, "y").predict(same).collect()
    assert all(row[c] == pytest.approx(5.0) for row in made for c in ("q0_10", "q0_50", "q0_90"))
    one = spark.createDataFrame([(1.0, 2.0, 4.0), (9.0, 9.0, None)], schema)
    assert PinballRegressor(BUILDER, QS, ["a", "b"]).fit(one, "y").predict(one.limit(1)).first()["q0_50"] == pytest.approx(4.0)
    with pytest.raises(ValueError, match="no labelled row"):
        PinballRegressor(BUILDER, QS, ["a", "b"]).fit(same.filter("false"), "y")
    with pytest.raises(ValueError, match="between 0 and 1"):
        PinballRegressor(BUILDER, (0.0, 0.5))
    with pytest.raises(RuntimeError):
        PinballRegressor(BUILDER, QS, ["a", "b"]).predict(same)


def test_held_out_rows_are_covered(spark):
    """Of rows after the training part, the share below each quantile is within 0.05 of it."""
    rows = spark.range(20 * 300).select(
        F.concat(F.lit("k"), F.col("id") % 20).alias("k"), F.date_add(F.lit("2023-01-01"), (F.col("id") / 20).cast("int")).alias("d"),
        (10 + (F.col("id") % 20) + F.abs(F.xxhash64("id") % 1000) / 100.0).alias("y"),
    )
    known, test = rows.filter("d < '2023-08-01'"), rows.filter("d >= '2023-08-01'")
    model = PinballForecaster(BUILDER, QS, ["y_lag_1", "k_te"]).fit(known)
    made = model.predict(test, known).join(test, ["k", "d"])
    share = made.agg(F.count("*").alias("n"), *[F.avg((F.col("y") <= F.col(c)).cast("double")).alias(c) for c in ("q0_10", "q0_50", "q0_90")]).first()
    assert share.n == test.count()
    assert [share.q0_10, share.q0_50, share.q0_90] == pytest.approx(QS, abs=0.05)
    assert made.filter("q0_10 > q0_50 OR q0_50 > q0_90").count() == 0
