"""Weighted means in two levels equal the form over whole keys, and a key is spread over tasks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesloom import make_spec
from seriesloom.operators.features import FeatureBuilder
from seriesloom.operators.recurrence import add_ewm_features, ewm_mean, ewm_means_by_blocks, long_ema

SPEC = make_spec("d", "y", ["k"], frequency="D")
START = dt.date(1969, 11, 1)


@pytest.fixture(scope="module")
def panel(spark):
    """Dense and sparse keys, a null key, one without values, one with gaps over many blocks; dates on both sides of 1970."""
    rows = []
    for key, every, length in (("dense", 1, 400), ("sparse", 17, 400), (None, 3, 200), ("late", 211, 700), ("short", 1, 1)):
        rows += [(key, START + dt.timedelta(i), float((i * 37) % 101) if i % every == every - 1 else None) for i in range(length)]
    rows += [("empty", START + dt.timedelta(i), None) for i in range(50)]
    return spark.createDataFrame(rows, "k string, d date, y double").cache()


def read(df, name):
    return {(r.k, r.d): r[name] for r in df.select("k", "d", name).collect()}


@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("block", [1, 7, 30, 1000])
def test_equal_to_the_form_over_whole_keys(panel, adjust, block):
    alphas = {"slow": 0.02, "fast": 0.6}
    made = ewm_means_by_blocks(panel, SPEC, F.col("y"), alphas, block, adjust)
    assert made.columns == [*panel.columns, *alphas]
    made = made.cache()
    for name, alpha in alphas.items():
        wanted, got = read(ewm_mean(panel, SPEC, F.col("y"), alpha, name, adjust), name), read(made, name)
        assert wanted.keys() == got.keys() and len(got) == panel.count()
        for at, value in wanted.items():
            assert got[at] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-9)), at


def test_features_and_long_means_by_blocks(panel):
    for lag in (1, 5):
        wanted, got = (read(add_ewm_features(panel, SPEC, halflives=(4.0,), min_lag=lag, block=b), "y_ewm_hl4") for b in (None, 11))
        assert got == {at: None if v is None else pytest.approx(v) for at, v in wanted.items()}
    wanted, got = (read(long_ema(panel, SPEC, "y", 0.1, "m", lag=2, null_as=-1.0, block=b), "m") for b in (None, 11))
    assert got == {at: pytest.approx(v) for at, v in wanted.items()}


def test_one_key_takes_several_tasks(spark):
    rows = spark.range(5000).select(F.lit("a").alias("k"), F.date_add(F.lit("2000-01-01"), F.col("id").cast("int")).alias("d"), F.col("id").cast("double").alias("y"))
    # Block-level tables stay small, so only an adaptive merge of partitions could put them together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = FeatureBuilder(SPEC, lags=(1,), rolling_windows=(), ewm_halflives=(7.0,), block=500).transform(rows)
        tasks = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(t["count"] for t in tasks) == 5000
    assert len(tasks) > 2 and max(t["count"] for t in tasks) < 5000
