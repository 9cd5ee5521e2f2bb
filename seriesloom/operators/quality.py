"""Data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.statistics import count_where, percent
from seriesloom.operators.impute import join_on_keys
from seriesloom.spec import PanelSpec


def missing_value_report(df: DataFrame) -> DataFrame:
    """Missing and present values of every column, in one aggregation."""
    row = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column"),
                    count_where(F.col(f.name).isNull()).alias("missing"),
                    percent(count_where(F.col(f.name).isNull()), F.count("*")).alias("missing_pct"),
                    F.count(f.name).alias("non_null"),
                    F.lit(f.dataType.simpleString()).alias("dtype"),
                )
                for f in df.schema.fields
            ]
        ).alias("_r")
    )
    return row.select(F.inline("_r"))


def missing_by_series(df: DataFrame, spec: PanelSpec) -> DataFrame:
    absent = count_where(F.col(spec.target_col).isNull())
    return df.groupBy(*spec.key_cols).agg(
        F.count("*").alias("n_obs"),
        absent.alias("missing"),
        percent(absent, F.count("*")).alias("missing_pct"),
    )


def _gaps(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Distinct dates per key with ``_at`` (period) and ``_next`` (following period)."""
    dates = (
        df.filter(F.col(spec.date_col).isNotNull())
        .groupBy(*spec.key_cols, spec.date_col)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_at", spec.freq.strict_index(spec.date_col))
    )
    return dates.withColumn("_next", F.lead("_at").over(spec.in_order()))


def detect_time_gaps(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Missing periods between the first and last date of each key.

    Counts follow from period numbers; no grid is generated.
    """
    f = spec.freq
    hole = F.col("_next") - F.col("_at") > 1
    missing = F.sum(F.when(hole, F.col("_next") - F.col("_at") - 1).otherwise(0))
    stats = _gaps(df, spec).groupBy(*spec.key_cols).agg(
        F.sum("_rows").alias("n_obs"),
        (F.max("_at") - F.min("_at") + 1).alias("expected_obs"),
        missing.alias("missing_dates"),
        f.date(F.min(F.when(hole, F.col("_at") + 1))).alias("first_gap"),
        f.date(F.max(F.when(hole, F.col("_next") - 1))).alias("last_gap"),
    )
    return stats.withColumn("gap_pct", percent(F.col("missing_dates"), F.col("expected_obs")))


def missing_periods(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Every missing period of every key, one row each."""
    holes = _gaps(df, spec).filter(F.col("_next") - F.col("_at") > 1)
    periods = holes.select(*spec.key_cols, F.explode(F.sequence(F.col("_at") + 1, F.col("_next") - 1)).alias("_p"))
    return periods.select(*spec.key_cols, spec.freq.date("_p").alias("missing_date"))


def gap_examples(df: DataFrame, spec: PanelSpec, key_values=None, max_examples: int = 20) -> DataFrame:
    """First missing dates with their weekday, for one key or for each key."""
    from seriesloom.operators.select import get_series

    if key_values is not None:
        df = get_series(df, spec, key_values, sort=False)
    gaps = missing_periods(df, spec)
    rank = F.row_number().over(spec.per_key().orderBy("missing_date"))
    return gaps.withColumn("_r", rank).filter(F.col("_r") <= max_examples).select(
        *spec.key_cols, "missing_date", F.date_format("missing_date", "EEEE").alias("weekday")
    )


def gap_weekdays(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Missing periods by weekday over all keys."""
    return (
        missing_periods(df, spec)
        .groupBy(F.date_format("missing_date", "EEEE").alias("weekday"))
        .agg(F.count("*").alias("n"))
    )


def keys_above(report: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows of a report beyond a threshold."""
    return report.filter(F.col(column) > threshold)


def validate_panel(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Audit per key; missing dates are periods of the span without any row."""
    y, d = F.col(spec.target_col), F.col(spec.date_col)
    # One row per key and date first, so distinct dates need no second expansion.
    daily = df.groupBy(*spec.key_cols, spec.date_col).agg(
        F.count("*").alias("_rows"),
        count_where(y == 0).alias("_z"),
        count_where(y < 0).alias("_neg"),
        count_where(y.isNull()).alias("_null"),
    )
    at = spec.freq.index(d)
    return daily.groupBy(*spec.key_cols).agg(
        F.sum("_rows").alias("n_obs"),
        F.min(d).alias("first_date"),
        F.max(d).alias("last_date"),
        (F.max(at) - F.min(at) + 1 - F.count(d)).alias("missing_dates"),
        F.sum("_z").alias("n_zeros"),
        F.sum("_neg").alias("n_negatives"),
        F.sum("_null").alias("n_nans"),
    )


def panel_totals(audit: DataFrame) -> DataFrame:
    """Totals of :func:`validate_panel`."""
    return audit.agg(
        F.count("*").alias("n_keys"),
        *[F.sum(c).alias(c) for c in ("missing_dates", "n_zeros", "n_negatives", "n_nans")],
    )


def detect_duplicates(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """All rows that share key and date with another row.

    Repeated (key, date) pairs are found by a partial aggregation and joined
    back, so clean data moves only its distinct pairs.
    """
    ident = [*spec.key_cols, spec.date_col]
    repeated = df.groupBy(*ident).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return join_on_keys(df, repeated, ident, "left_semi")


def target_sign_check(df: DataFrame, spec: PanelSpec) -> DataFrame:
    y = F.col(spec.target_col)
    return df.agg(
        F.count(y).alias("n_total"),
        count_where(y < 0).alias("n_negative"),
        count_where(y == 0).alias("n_zero"),
        count_where(y > 0).alias("n_positive"),
        percent(count_where(y < 0), F.count(y)).alias("pct_negative"),
        percent(count_where(y == 0), F.count(y)).alias("pct_zero"),
    )


def static_feature_consistency(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None) -> DataFrame:
    """Per static column: keys that hold more than one value.

    A key is inconsistent when its smallest and largest value differ: two
    mergeable aggregates per column instead of a distinct count.
    """
    cols = [c for c in (cols or spec.static_cols) if c in df.columns]
    varies = df.groupBy(*spec.key_cols).agg(*[(F.min(c) != F.max(c)).alias(f"_v{i}") for i, c in enumerate(cols)])
    row = varies.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count("*").alias("n_keys"),
                    count_where(F.col(f"_v{i}")).alias("n_inconsistent_keys"),
                    percent(count_where(F.col(f"_v{i}")), F.count("*")).alias("inconsistent_pct"),
                )
                for i, c in enumerate(cols)
            ]
        ).alias("_r")
    )
    return row.select(F.inline("_r"))
