"""Outlier flags and treatment.

A detector adds a boolean column for one value column, judged against the
values of the same key. Bounds are window aggregates over the keys; a key has
one row per period, so their state is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.statistics import count_where, percent
from seriesloom.operators.exact import exact_quantiles
from seriesloom.operators.impute import impute_missing
from seriesloom.spec import PanelSpec

Detector = Callable[[DataFrame, PanelSpec, str, str], DataFrame]

# Scale of the modified z-score.
NORMAL_MAD = 0.6745


def detect_outliers_iqr(df: DataFrame, spec: PanelSpec, col: str, flag: str = "is_outlier", k: float = 1.5) -> DataFrame:
    """Beyond ``k`` interquartile ranges outside the quartiles."""
    y = F.col(col)
    both = df.withColumn("_q", F.percentile(y, F.array(F.lit(0.25), F.lit(0.75))).over(spec.per_key()))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    reach = (hi - lo) * k
    return both.withColumn(flag, F.coalesce((y < lo - reach) | (y > hi + reach), F.lit(False))).drop("_q")


def detect_outliers_zscore(df: DataFrame, spec: PanelSpec, col: str, flag: str = "is_outlier", threshold: float = 3.0) -> DataFrame:
    """Beyond ``threshold`` sample deviations; never for a constant series."""
    y, w = F.col(col), spec.per_key()
    z = F.try_divide(F.abs(y - F.avg(y).over(w)), F.stddev_samp(y).over(w))
    return df.withColumn(flag, F.coalesce(z > threshold, F.lit(False)))


def detect_outliers_modified_zscore(df: DataFrame, spec: PanelSpec, col: str, flag: str = "is_outlier", threshold: float = 3.5) -> DataFrame:
    """Distance from the median in units of the median absolute deviation."""
    y, w = F.col(col), spec.per_key()
    centred = df.withColumn("_dev", F.abs(y - F.percentile(y, 0.5).over(w)))
    z = F.try_divide(F.lit(NORMAL_MAD) * F.col("_dev"), F.percentile("_dev", 0.5).over(w))
    return centred.withColumn(flag, F.coalesce(z > threshold, F.lit(False))).drop("_dev")


DETECTORS: dict[str, Detector] = {
    "iqr": detect_outliers_iqr,
    "zscore": detect_outliers_zscore,
    "modified_zscore": detect_outliers_modified_zscore,
}


def outlier_summary(df: DataFrame, spec: PanelSpec, method: str = "iqr", **options: float) -> DataFrame:
    if method not in DETECTORS:
        raise ValueError(f"unknown outlier method: {method}")
    flagged = DETECTORS[method](df, spec, spec.target_col, "_flag", **options)
    hits = count_where(F.col("_flag"))
    return flagged.groupBy(*spec.key_cols).agg(
        F.count("*").alias("n_obs"), hits.alias("n_outliers"), percent(hits, F.count("*")).alias("outlier_pct")
    )


def compare_detectors(df: DataFrame, spec: PanelSpec, methods: Sequence[str] = tuple(DETECTORS)) -> DataFrame:
    """Flag counts of several methods from one pass over one partitioning."""
    for m in methods:
        df = DETECTORS[m](df, spec, spec.target_col, f"_by_{m}")
    n = F.count("*")
    row = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("method"),
                    count_where(F.col(f"_by_{m}")).alias("n_outliers"),
                    percent(count_where(F.col(f"_by_{m}")), n).alias("outlier_pct"),
                )
                for m in methods
            ]
        ).alias("_r")
    )
    return row.select(F.inline("_r"))


def winsorize(
    df: DataFrame, spec: PanelSpec, col: str, lower_pct: float = 0.01, upper_pct: float = 0.99, group: bool = True
) -> DataFrame:
    """Limit values to two percentiles, per key or of the whole column; nulls stay."""
    y = F.col(col)
    if group:
        bounds = F.percentile(y, F.array(F.lit(lower_pct), F.lit(upper_pct))).over(spec.per_key())
        both = df.withColumn("_q", bounds)
    else:
        q = exact_quantiles(df, [col], [lower_pct, upper_pct])
        one = q.agg(F.array(F.min_by("value", "prob"), F.max_by("value", "prob")).alias("_q"))
        both = df.join(F.broadcast(one))
    capped = F.least(F.greatest(y, F.col("_q")[0]), F.col("_q")[1])
    return both.withColumn(col, F.when(y.isNotNull(), capped)).drop("_q")


def replace_outliers_with(
    df: DataFrame, spec: PanelSpec, col: str, detector: Detector = detect_outliers_iqr, replace_with: str = "median"
) -> DataFrame:
    """Flagged values become the median or mean of their key, or null."""
    w = spec.per_key()
    stats = {"median": F.percentile(col, 0.5).over(w), "mean": F.avg(col).over(w), "nan": F.lit(None).cast("double")}
    if replace_with not in stats:
        raise ValueError("replace_with must be 'median', 'mean' or 'nan'")
    flagged = detector(df, spec, col, "_flag").withColumn("_new", stats[replace_with])
    return flagged.withColumn(col, F.when(F.col("_flag"), F.col("_new")).otherwise(F.col(col))).drop("_flag", "_new")


def reimpute_outliers(df: DataFrame, spec: PanelSpec, col: str, detector: Detector = detect_outliers_iqr) -> DataFrame:
    """Outliers are blanked and filled by linear interpolation."""
    return impute_missing(replace_outliers_with(df, spec, col, detector, "nan"), spec, col, "linear")


def treatment_effect(df: DataFrame, before: str, after: str) -> DataFrame:
    """Changed rows and mean absolute change between two columns."""
    delta = F.abs(F.col(after) - F.col(before))
    return df.agg(
        F.count("*").alias("n_rows"),
        count_where(~F.col(before).eqNullSafe(F.col(after))).alias("n_changed"),
        F.avg(delta).alias("mean_abs_change"),
    )
