"""Short, empty and ended series, and forecasts that must not see the future."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import demand, forecast, learners, splits, transforms, tsstats
from seriesloom.operators.features import FeatureBuilder
from seriesloom.plans import univariate
from seriesloom.spec import PanelSpec

SPEC = PanelSpec("d", "y", ("k",), frequency="D")
START = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def mixed(spark):
    """Forty days of `long`, one of `one`, three of `same`, two without a value of `none`."""
    rows = [("long", START + dt.timedelta(days=i), float(i % 7 + i // 10)) for i in range(40)]
    rows += [("one", START, 5.0)] + [("same", START + dt.timedelta(days=i), 2.0) for i in range(3)]
    rows += [("none", START + dt.timedelta(days=i), None) for i in range(2)]
    return spark.createDataFrame(rows, "k string, d date, y double")


def _keys(df):
    return {r.k for r in df.select("k").distinct().collect()}


EVERY = {"long", "one", "same", "none"}


def test_no_statistic_loses_a_key(mixed):
    for out in (
        tsstats.acf_pacf(mixed, SPEC, nlags=5), tsstats.ljung_box_statistic(mixed, SPEC, lags=5), tsstats.kpss_test(mixed, SPEC), tsstats.kpss_test(mixed, SPEC, regression="ct"),
        tsstats.adf_test(mixed, SPEC), tsstats.seasonal_decompose(mixed, SPEC, 7), tsstats.seasonal_decompose(mixed, SPEC, 7, extrapolate=False), tsstats.stl_decompose(mixed, SPEC, 7),
    ):
        assert _keys(out) == EVERY


def test_reasons(mixed):
    kpss = {r.k: r.error for r in tsstats.kpss_test(mixed, SPEC).collect()}
    assert kpss == {"long": None, "one": "fewer than 3 observations", "none": "fewer than 3 observations", "same": "constant series"}
    parts = tsstats.seasonal_decompose(mixed, SPEC, 7).collect()
    assert len(parts) == 46
    assert all((p.error is None) == (p.k == "long") and (p.trend is None) == (p.k != "long") for p in parts)


def test_short_keys_have_null_forecasts(mixed):
    made = forecast.exponential_smoothing(mixed, SPEC, 2, season_length=7).collect()
    assert {r.k for r in made if r.yhat is None} == {"one", "same", "none"} and len(made) == 8


def test_workflow_forecasts_every_key(spark, mixed):
    out = univariate.run_workflow(mixed, SPEC, 7, 7, ["seasonal_naive", "mean", "holt"])
    assert _keys(out.forecast) == EVERY
    reasons = {r.k: r.reason for r in out.best.collect()}
    assert reasons["long"] is None and reasons["one"] is not None


@pytest.mark.parametrize("frequency", ["D", "W", "W-WED", "B", "MS", "ME", "QS", "QE", "YS", "H"])
def test_shift_on_the_driver_equals_the_column(spark, frequency):
    freq = PanelSpec("d", "y", ("k",), frequency=frequency).freq
    kind = "timestamp_ntz" if freq.hourly else "date"
    days = [dt.date(1969, 11, 30), dt.date(1999, 12, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 9)]
    if freq.hourly:
        days = [dt.datetime.combine(d, dt.time(23)) for d in days]
    for day in days:
        for n in (-30, -1, 0, 1, 13):
            assert freq.shift_day(day, n) == spark.range(1).select(freq.shift(F.lit(day).cast(kind), n)).first()[0], (day, n)


def test_fewer_folds_than_asked_are_announced(mixed):
    with pytest.warns(UserWarning, match="of 9 folds"):
        folds = splits.rolling_window_split(mixed.filter("k = 'long'"), SPEC, 20, 5, 9)
    assert folds.asked == 9 and len(folds) == 4


def test_lambda_far_outside_the_grid(spark):
    rows = spark.range(1, 400).select(F.lit("a").alias("k"), F.pow(F.col("id") / 400.0, F.lit(1.0 / 6)).alias("y"))
    assert transforms.fit_boxcox(rows, "y", ["k"]).first()["lambda"] > 4


def test_catalog_has_a_row_per_objective(spark):
    rows = demand.loss_catalog(spark).collect()
    assert {r.objective for r in rows} >= set(demand.OBJECTIVES.values())
    assert all(r.name and r.watch_out for r in rows)


def test_forecasts_do_not_see_test_values(spark):
    rows = [(k, START + dt.timedelta(days=i), float((i * (3 + j)) % 11 + 1)) for j, k in enumerate("abc") for i in range(80 - 5 * j)]
    panel = spark.createDataFrame(rows, "k string, d date, y double")
    builder = FeatureBuilder(SPEC, lags=(1, 2), rolling_windows=(3,), rolling_stats=("mean",), ewm_halflives=())
    tree = {"objective": "regression", "max_iter": 2, "max_depth": 2}
    cut = START + dt.timedelta(days=70)

    def made(df):
        split = splits.time_based_split(df, SPEC, START + dt.timedelta(days=55), cut)
        known = df.filter(F.col("d") <= F.lit(cut))
        quantiles = learners.QuantileForecaster(builder, (0.1, 0.5, 0.9), tree).fit_ahead(split.train, split.val, 3).predict_ahead(known, 3)
        direct = learners.DirectMultiHorizonForecaster(builder, (1, 3), tree).fit(split.train, split.val).predict(known, cut)
        return sorted(map(tuple, quantiles.collect())), sorted(map(tuple, direct.collect()))

    changed = panel.withColumn("y", F.when(F.col("d") > F.lit(cut), F.col("y") * 100).otherwise(F.col("y")))
    first, second = made(panel), made(changed)
    assert first == second
    assert {r[0] for r in first[1]} == {"a", "b", "c"}


def test_weights_change_the_fit(spark):
    rows = [("a", START + dt.timedelta(days=i), float(i % 2) * 10, 100.0 if i % 2 else 1.0) for i in range(60)]
    panel = spark.createDataFrame(rows, "k string, d date, y double, w double")
    builder = FeatureBuilder(SPEC, lags=(7,), rolling_windows=(), rolling_stats=(), ewm_halflives=())
    params = {"objective": "regression", "max_iter": 1, "max_depth": 1, "subsample": 1.0, "min_rows": 40}
    features = builder.transform(panel)
    mean = lambda weight: learners.PanelRegressor(builder, params).fit(features, "y", weight=weight).predict(features).agg(F.avg("yhat")).first()[0]
    assert mean("w") > mean(None) + 2
