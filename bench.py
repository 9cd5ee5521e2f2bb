"""Headline queries at one scale: prints a single JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from seriesloom.operators import demand, forecast, impute, quality, scoring, splits
from seriesloom.operators.features import FeatureBuilder
from seriesloom.operators.grid import complete_panel, fill_time_gaps
from seriesloom.operators.recurrence import add_ewm_features
from seriesloom.session import build_session
from workload import QUERIES
from workload import panels as P

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def part_week_features(spark, folder):
    """Lags, rolling and calendar features of every part."""
    full = complete_panel(P.part_week(spark, folder), P.WEEKLY)
    builder = FeatureBuilder(P.WEEKLY, lags=(1, 2, 4, 13), rolling_windows=(4, 13), rolling_stats=("mean", "std"), ewm_halflives=())
    return builder.transform(full)


def brand_day_ewm(spark, folder):
    full = complete_panel(P.brand_day(spark, folder), P.DAILY)
    return add_ewm_features(full, P.DAILY, halflives=(7.0, 28.0))


def user_day_gaps_and_interpolation(spark, folder):
    panel = P.user_type_day(spark, folder)
    gaps = quality.detect_time_gaps(panel, P.DAILY_BY_TYPE).select("k", "t", "missing_dates")
    filled = impute.impute_missing(fill_time_gaps(panel, P.DAILY_BY_TYPE), P.DAILY_BY_TYPE, "y", "linear")
    return filled.join(gaps, ["k", "t"])


def seasonal_naive_backtest(spark, folder):
    split = splits.holdout_horizon_split(P.supplier_week_full(spark, folder), P.WEEKLY, 13)
    fc = forecast.seasonal_naive_forecast(split.train, P.WEEKLY, 13, 52)
    return scoring.metric_report(scoring.align(split.test, fc, P.WEEKLY), "y", "yhat", ["k", "horizon"])


def supplier_week_classes(spark, folder):
    return demand.classification_summary(demand.classify_all_series(P.supplier_week_full(spark, folder), P.WEEKLY))


def part_week_classes(spark, folder):
    full = complete_panel(P.part_week(spark, folder), P.WEEKLY)
    return demand.classify_all_series(full, P.WEEKLY).groupBy("sb_class").agg(F.count("*").alias("n"))


HEADLINE = {
    "supplier_week_classes": supplier_week_classes,
    "part_week_classes": part_week_classes,
    "part_week_features": part_week_features,
    "brand_day_ewm": brand_day_ewm,
    "user_day_gaps_and_interpolation": user_day_gaps_and_interpolation,
    "seasonal_naive_backtest": seasonal_naive_backtest,
}
FROM_WORKLOAD = (
    "numeric_description", "spearman_correlation", "outlier_counts", "croston_forecasts", "model_comparison",
    "partial_autocorrelations", "decomposition_additive", "retail_features",
)


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = HEADLINE | {q: QUERIES[q] for q in FROM_WORKLOAD}
    # One untimed pass over a small query starts the workers and loads the classes.
    QUERIES["value_counts"](spark, FOLDER).collect()
    seconds = {}
    for name, run in jobs.items():
        start = time.perf_counter()
        run(spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
