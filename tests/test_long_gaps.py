"""Cases outside the given tables: long gaps, constant families, zones with clock changes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesloom import make_spec
from seriesloom.operators.recurrence import ewm_mean
from seriesloom.spec import Frequency


@pytest.mark.parametrize(("adjust", "at_gap"), [(False, 100.0), (True, 100.0)])
def test_weighted_mean_after_a_long_gap(spark, adjust, at_gap):
    spec = make_spec("d", "y", ["k"], frequency="D")
    start = dt.date(2000, 1, 1)
    rows = [("a", start, 100.0)] + [("a", start + dt.timedelta(i), None) for i in range(1, 1300)] + [("a", start + dt.timedelta(1300), 1.0), ("a", start + dt.timedelta(1301), 3.0)]
    df = spark.createDataFrame(rows, "k string, d date, y double")
    out = [r.m for r in ewm_mean(df, spec, F.col("y"), 0.5, "m", adjust).orderBy("d").collect()]
    assert out[1299] == pytest.approx(at_gap)
    assert out[1300] == pytest.approx(1.0)
    # Weights of the two last values: 0.5 and 0.5 from the first value on, 0.5 and 1 when adjusted.
    assert out[1301] == pytest.approx((0.5 * 1 + 3) / 1.5 if adjust else 2.0)


def test_hours_do_not_pass_through_the_session_zone(spark):
    hourly = Frequency("H")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        hours = [dt.datetime(2024, 3, 10, h) for h in (1, 2, 3)]
        df = spark.createDataFrame([(h,) for h in hours], "t timestamp_ntz")
        rows = df.select(hourly.index("t").alias("i"), hourly.date(hourly.index("t")).alias("t")).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.t for r in rows] == hours and rows[2].i - rows[0].i == 2
