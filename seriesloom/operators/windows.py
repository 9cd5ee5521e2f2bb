"""Lag, rolling, difference and time-range features.

All row-order features of one call share one window partitioning and ordering:
one exchange and one sort, whatever the number of features. On a completed
grid the row distance equals the period distance; :func:`by_blocks` uses this
to spread a long series over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesloom.spec import PanelSpec


def _skew_over(y: Column, w: WindowSpec) -> Column:
    n = F.count(y).over(w).cast("double")
    g = F.skewness(y).over(w) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n > 2, F.when(F.var_pop(y).over(w) > 0, g).otherwise(0.0))


def _kurt_over(y: Column, w: WindowSpec) -> Column:
    n = F.count(y).over(w).cast("double")
    g = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(y).over(w) + 6)
    # A constant window counts as the flattest shape.
    return F.when(n > 3, F.when(F.var_pop(y).over(w) > 0, g).otherwise(-3.0))


ROLLING: dict[str, Callable[[Column, WindowSpec], Column]] = {
    "mean": lambda y, w: F.avg(y).over(w),
    "std": lambda y, w: F.stddev_samp(y).over(w),
    "min": lambda y, w: F.min(y).over(w),
    "max": lambda y, w: F.max(y).over(w),
    "median": lambda y, w: F.percentile(y, 0.5).over(w),
    "sum": lambda y, w: F.sum(y).over(w),
    "var": lambda y, w: F.var_samp(y).over(w),
    "skew": _skew_over,
    "kurt": _kurt_over,
}


def add_lag_features(
    df: DataFrame, spec: PanelSpec, column: str | None = None, lags: Iterable[int] = (1, 7, 14, 28), prefix: str | None = None
) -> DataFrame:
    name = column or spec.target_col
    w = spec.in_order()
    return df.withColumns({f"{prefix or name + '_lag_'}{k}": F.lag(name, k).over(w) for k in lags})


def rolling_columns(
    spec: PanelSpec, name: str, windows: Iterable[int], stats: Sequence[str], shift: int, min_periods: int = 1
) -> dict[str, Column]:
    """Rolling statistics over the ``W`` rows that end ``shift`` rows back."""
    unknown = [s for s in stats if s not in ROLLING]
    if unknown:
        raise ValueError(f"unknown rolling statistics: {unknown}")
    y, out = F.col(name), {}
    for size in windows:
        frame = spec.in_order().rowsBetween(-(shift + size - 1), -shift)
        for stat in stats:
            value = ROLLING[stat](y, frame)
            if min_periods > 1:
                value = F.when(F.count(y).over(frame) >= min_periods, value)
            out[f"{name}_roll_{stat}_{size}"] = value
    return out


def add_rolling_features(
    df: DataFrame,
    spec: PanelSpec,
    column: str | None = None,
    windows: Iterable[int] = (7, 14, 28),
    stats: Sequence[str] = ("mean", "std", "min", "max"),
    shift: int = 1,
    min_periods: int = 1,
) -> DataFrame:
    return df.withColumns(rolling_columns(spec, column or spec.target_col, windows, stats, shift, min_periods))


def by_blocks(
    df: DataFrame, spec: PanelSpec, reach: int, block: int, build: Callable[[DataFrame, PanelSpec], DataFrame]
) -> DataFrame:
    """Run row-order features with at most ``block + reach`` rows of a key per group.

    Each row also goes, as a helper, to the next block when it lies within
    ``reach`` periods before it; helpers are dropped afterwards. Needs a
    completed grid, ``block >= reach`` and features that look back at most
    ``reach`` rows. The result equals that of ``build`` on whole series.
    """
    if block < reach:
        raise ValueError("block must be at least as long as the look-back")
    at = spec.freq.index(spec.date_col)
    own = F.floor(at / block)
    # A row `into` its block is a helper of the next one when fewer than `reach` periods remain.
    homes = F.when(at - own * block >= block - reach, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.select("*", F.posexplode(homes).alias("_helper", "_block"))
    blocked = PanelSpec(
        spec.date_col, spec.target_col, (*spec.key_cols, "_block"), spec.static_cols, spec.dynamic_cols, spec.frequency
    )
    # Without this exchange a table already partitioned by its keys would keep each key in one task.
    spread = spread.repartition(*spec.key_cols, "_block")
    return build(spread, blocked).filter(F.col("_helper") == 0).drop("_helper", "_block")


def add_time_range_features(
    df: DataFrame, keys: Sequence[str], date_col: str, features: dict[str, tuple[str, str, int, int]]
) -> DataFrame:
    """Statistics over day ranges: name -> (column, stat, first day, last day), relative to the row."""

    days = F.unix_date(F.col(date_col).cast("date"))
    aggs = {"count": F.count, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    return df.withColumns(
        {
            name: aggs[stat](col).over(Window.partitionBy(*keys).orderBy(days).rangeBetween(lo, hi))
            for name, (col, stat, lo, hi) in features.items()
        }
    )


def lead_target(spec: PanelSpec, h: int) -> Column:
    """Target ``h`` rows ahead in the same key."""
    return F.lead(spec.target_col, h).over(spec.in_order())


def difference(df: DataFrame, spec: PanelSpec, col: str, lags: Sequence[int], name: str) -> DataFrame:
    """Successive differences, e.g. ``(12,)`` seasonal or ``(1, 12)`` both."""
    out = df.withColumn(name, F.col(col))
    for k in lags:
        out = out.withColumn(name, F.col(name) - F.lag(name, k).over(spec.in_order()))
    return out


def rolling_statistics(df: DataFrame, spec: PanelSpec, window: int) -> DataFrame:
    """Mean and deviation over full windows that include the row."""
    y, frame = F.col(spec.target_col), spec.in_order().rowsBetween(-(window - 1), 0)
    full = F.count(y).over(frame) == window
    return df.withColumns(
        {"rolling_mean": F.when(full, F.avg(y).over(frame)), "rolling_std": F.when(full, F.stddev_samp(y).over(frame))}
    )


def lag_pairs(df: DataFrame, spec: PanelSpec, lags: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Long table of (lag, value k rows before, value)."""
    wide = df.withColumns({f"_l{k}": F.lag(spec.target_col, k).over(spec.in_order()) for k in lags})
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias("y_before"), F.col(spec.target_col).alias("y_now")) for k in lags])
    return wide.select(*spec.key_cols, spec.date_col, F.inline(rows))


def best_so_far(order: WindowSpec, col: str) -> Column:
    """Running minimum."""

    return F.min(col).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def cycle_position(spec: PanelSpec, period: int) -> tuple[Column, Column]:
    """Cycle number and position within the cycle, both from 0."""
    i = F.row_number().over(spec.in_order()) - 1
    return F.floor(i / period), F.pmod(i, F.lit(period))


