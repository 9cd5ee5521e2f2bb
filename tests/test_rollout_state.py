"""State of a roll-out: shape statistics from arrays, ages of missing rows, key codes that do not change between tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from seriesloom import make_spec
from seriesloom.operators.features import ARRAY_STATS, FeatureBuilder
from seriesloom.operators.learners import DirectMultiHorizonForecaster, QuantileForecaster, RecursiveForecaster
from seriesloom.operators.pinball import PinballForecaster
from seriesloom.operators.windows import ROLLING

SPEC = make_spec("d", "y", ["k"], frequency="D")
OLS = {"objective": "least_squares"}
START = dt.date(2024, 1, 1)


def series(spark, keys, length=40):
    rows = [(k, START + dt.timedelta(i), float((i * 7 + len(k)) % 11)) for k in keys for i in range(length)]
    return spark.createDataFrame(rows, "k string, d date, y double")


@pytest.mark.parametrize("values", [[], [0.3], [0.1] * 7, [1.0, 2.0], [1.0, 2.0, 9.0], [5.0, 1.0, 1.0, 8.0, 2.5], [1e6 + v for v in (1.0, 2.0, 4.0, 9.0)]])
def test_shape_of_an_array_equals_that_of_a_window(spark, values):
    row = spark.range(1).select(F.array(*[F.lit(v) for v in values]).cast("array<double>").alias("a")).select(*[ARRAY_STATS[s](F.col("a")).alias(s) for s in ("skew", "kurt")]).first()
    df = spark.createDataFrame([("a", START + dt.timedelta(i), v) for i, v in enumerate(values)] or [("a", START, None)], "k string, d date, y double")
    frame = SPEC.in_order().rowsBetween(-100, 0)
    last = df.select("d", *[ROLLING[s](F.col("y"), frame).alias(s) for s in ("skew", "kurt")]).orderBy(F.desc("d")).first()
    for stat in ("skew", "kurt"):
        assert row[stat] == (None if last[stat] is None else pytest.approx(last[stat], rel=1e-6, abs=1e-6))


def test_missing_rows_at_the_end_age_the_mean(spark):
    rows = [("a", START, 8.0), ("a", START + dt.timedelta(1), 2.0)] + [("a", START + dt.timedelta(i), None) for i in (2, 3, 4)]
    df = spark.createDataFrame(rows, "k string, d date, y double")
    builder = FeatureBuilder(SPEC, lags=(1,), rolling_windows=(), ewm_halflives=(2.0,))
    model = RecursiveForecaster(builder, OLS, features=["y_ewm_hl2"])
    model.fit(spark.createDataFrame([("a", START + dt.timedelta(i), float(i % 5)) for i in range(30)], "k string, d date, y double"))
    made = {r.horizon: r for r in model.predict_recursive(df, 3, show=["y_ewm_hl2"]).collect()}
    keep = math.exp(-math.log(2.0) / 2.0)
    mean = keep * 8 + (1 - keep) * 2
    assert made[1].y_ewm_hl2 == pytest.approx(mean)
    # The first forecast enters four rows after the last known value.
    left = keep**4
    assert made[2].y_ewm_hl2 == pytest.approx((left * mean + (1 - keep) * made[1].yhat) / (left + 1 - keep))
    assert made[3].y_ewm_hl2 == pytest.approx(keep * made[2].y_ewm_hl2 + (1 - keep) * made[2].yhat)


def test_codes_are_those_of_the_training_rows(spark):
    builder = FeatureBuilder(SPEC, lags=(1,), rolling_windows=(), ewm_halflives=(), encode_keys=True)
    fitted = builder.fitted(series(spark, ["b", "d"]))
    assert fitted.fitted(series(spark, ["a"])) is fitted
    other = series(spark, ["a", "b", "d"]).union(series(spark, ["x"]).withColumn("k", F.lit(None).cast("string")))
    codes = {r.k: r.k_code for r in fitted.transform(other).select("k", "k_code").distinct().collect()}
    assert codes == {"a": -1, "b": 0, "d": 1, None: -1}
    assert {r.k_code for r in fitted.transform(series(spark, ["d"])).select("k_code").distinct().collect()} == {1}


def test_every_forecaster_takes_key_codes(spark):
    builder = FeatureBuilder(SPEC, lags=(1,), rolling_windows=(3,), rolling_stats=("mean", "skew", "kurt"), ewm_halflives=(2.0,), encode_keys=True, cyclical_calendar=False)
    train, known = series(spark, ["a", "b", "c"], 30), series(spark, ["b", "c", "new"])
    use = ["y_lag_1", "k_code"]
    rolled = RecursiveForecaster(builder, OLS, features=use).fit(train).predict_recursive(known, 2, show=["k_code"]).collect()
    assert {(r.k, r.k_code) for r in rolled} == {("b", 1.0), ("c", 2.0), ("new", -1.0)} and len(rolled) == 6
    assert RecursiveForecaster(builder, OLS).fit(train).predict_recursive(known, 2).filter("yhat IS NOT NULL").count() == 6
    assert DirectMultiHorizonForecaster(builder, [1, 2], OLS, features=use).fit(train).predict(known, "2024-02-09").filter("yhat IS NOT NULL").count() == 6
    held = series(spark, ["a", "b", "c"]).filter("d >= '2024-01-31'")
    quantiles = QuantileForecaster(builder, (0.1, 0.9), OLS, features=use).fit(train, held)
    assert quantiles.predict(held, train).filter("q0_10 <= q0_90").count() == 30
    assert PinballForecaster(builder, (0.1, 0.9), use, max_iter=3).fit(train).predict(held, train).filter("q0_10 <= q0_90").count() == 30


def test_columns_known_ahead_are_declared_not_guessed(spark):
    from seriesloom.operators.features import causal_features

    builder = FeatureBuilder(SPEC, lags=(1,), rolling_windows=(3,), ewm_halflives=(), exogenous=("day_before_x", "price"), encode_keys=True)
    kept = causal_features(builder.feature_names, builder, ["price"])
    assert "day_before_x" not in kept and {"price", "month", "dow_sin", "y_lag_1", "y_roll_mean_3", "k_code"} <= set(kept)
