"""Filling of missing values inside each key.

All rules are windows over one partitioning by the keys. A look-ahead is a
running window over the reversed order: a frame that reaches to the end of the
partition would be evaluated anew for every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.spec import PanelSpec

METHODS = (
    "mean", "median", "mode", "zero", "constant", "ffill", "bfill", "linear", "time",
    "rolling_mean", "rolling_median", "seasonal_naive_7",
)


def _so_far(spec: PanelSpec):
    return spec.in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _from_end(spec: PanelSpec):
    return spec.in_reverse().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def previous_value(value: Column, spec: PanelSpec) -> Column:
    """Latest non-null value up to this row."""
    return F.last(value, ignorenulls=True).over(_so_far(spec))


def next_value(value: Column, spec: PanelSpec) -> Column:
    """Earliest non-null value from this row on."""
    return F.last(value, ignorenulls=True).over(_from_end(spec))


def _present(df: DataFrame, cols: Sequence[str] | None, default: Sequence[str]) -> list[str]:
    return [c for c in (cols if cols is not None else default) if c in df.columns]


def ffill_static(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: previous_value(F.col(c), spec) for c in _present(df, cols, spec.static_cols)})


def bfill_static(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: next_value(F.col(c), spec) for c in _present(df, cols, spec.static_cols)})


def ffill_bfill_static(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns(
        {
            c: F.coalesce(previous_value(F.col(c), spec), next_value(F.col(c), spec))
            for c in _present(df, cols, spec.static_cols)
        }
    )


def _interpolate(df: DataFrame, spec: PanelSpec, col: str, at: Column, fill_leading: bool) -> DataFrame:
    """Straight line between the neighbours known on both sides, flat outside them."""
    y = F.col(col)
    anchored = df.withColumn("_x", at).withColumn(
        "_point", F.when(y.isNotNull(), F.struct(F.col("_x").alias("x"), y.cast("double").alias("y")))
    )
    both = anchored.withColumn("_left", previous_value(F.col("_point"), spec)).withColumn(
        "_right", next_value(F.col("_point"), spec)
    )
    left, right = F.col("_left"), F.col("_right")
    run = right["x"] - left["x"]
    between = left["y"] + (right["y"] - left["y"]) * F.try_divide((F.col("_x") - left["x"]).cast("double"), run.cast("double"))
    edge = F.coalesce(left["y"], right["y"]) if fill_leading else left["y"]
    filled = F.coalesce(y.cast("double"), between, edge)
    return both.withColumn(col, filled).drop("_x", "_point", "_left", "_right")


def _with_scalar(df: DataFrame, stat: Column, name: str) -> DataFrame:
    """A whole-table statistic as a column; the joined side is one row."""
    return df.join(F.broadcast(df.agg(stat.alias(name))))


def _key_mode(df: DataFrame, spec: PanelSpec, col: str, group: bool) -> DataFrame:
    """Most frequent value; the smallest one on a tie. Counted before it is compared."""
    keys = list(spec.key_cols) if group else []
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_n"))
    best = F.min_by(col, F.struct(-F.col("_n"), F.col(col)))
    return counts.groupBy(*keys).agg(best.alias("_mode"))


def join_on_keys(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join on the key columns, keeping the left key columns."""
    renamed = other.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if not keys:
        return df.join(F.broadcast(renamed))
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    joined = df.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def impute_missing(
    df: DataFrame,
    spec: PanelSpec,
    cols: str | Sequence[str],
    method: str = "linear",
    group: bool = True,
    constant_value: float | None = None,
    rolling_window: int = 7,
    fill_leading: bool = True,
) -> DataFrame:
    """Fill nulls of the given columns by one of :data:`METHODS`.

    ``group=False`` is defined for the rules that do not depend on row order.
    """
    if method not in METHODS:
        raise ValueError(f"unknown imputation method: {method}")
    if method == "constant" and constant_value is None:
        raise ValueError("method 'constant' needs constant_value")
    if not group and method not in ("mean", "median", "mode", "zero", "constant"):
        raise ValueError(f"method {method!r} depends on row order and works within keys only")
    for col in [cols] if isinstance(cols, str) else cols:
        df = _impute_column(df, spec, col, method, group, constant_value, rolling_window, fill_leading)
    return df


def _impute_column(df, spec, col, method, group, constant_value, rolling_window, fill_leading) -> DataFrame:
    y = F.col(col)
    if method in ("zero", "constant"):
        return df.withColumn(col, F.coalesce(y, F.lit(0.0 if method == "zero" else constant_value)))
    if method in ("mean", "median"):
        stat = F.avg(col) if method == "mean" else F.percentile(col, 0.5)
        if group:
            return df.withColumn(col, F.coalesce(y, stat.over(spec.per_key())))
        if method == "median":
            from seriesloom.operators.exact import exact_quantiles

            stats = exact_quantiles(df, [col], [0.5]).select(F.col("value").alias("_stat"))
            return df.join(F.broadcast(stats)).withColumn(col, F.coalesce(y, "_stat")).drop("_stat")
        return _with_scalar(df, stat, "_stat").withColumn(col, F.coalesce(y, "_stat")).drop("_stat")
    if method == "mode":
        keys = list(spec.key_cols) if group else []
        joined = join_on_keys(df, _key_mode(df, spec, col, group), keys)
        return joined.withColumn(col, F.coalesce(y, "_mode")).drop("_mode")
    if method == "ffill":
        return df.withColumn(col, previous_value(y, spec))
    if method == "bfill":
        return df.withColumn(col, next_value(y, spec))
    if method == "linear":
        return _interpolate(df, spec, col, F.row_number().over(spec.in_order()), fill_leading)
    if method == "time":
        return _interpolate(df, spec, col, F.unix_micros(F.col(spec.date_col).cast("timestamp")), fill_leading)
    if method in ("rolling_mean", "rolling_median"):
        frame = spec.in_order().rowsBetween(-(rolling_window - 1), 0)
        stat = F.avg(col) if method == "rolling_mean" else F.percentile(col, 0.5)
        return df.withColumn(col, F.coalesce(y, stat.over(frame)))
    seasonal = df.withColumn(col, F.coalesce(y, F.lag(col, 7).over(spec.in_order())))
    filled = F.coalesce(previous_value(y, spec), next_value(y, spec))
    return seasonal.withColumn(col, filled)


def blank_block(df: DataFrame, spec: PanelSpec, col: str, start: int, length: int) -> DataFrame:
    """Hide ``length`` consecutive rows per key from row ``start`` on; truth in ``_truth``."""
    position = F.row_number().over(spec.in_order()) - 1
    hidden = df.withColumn("_hidden", (position >= start) & (position < start + length))
    return hidden.withColumn("_truth", F.col(col)).withColumn(col, F.when(~F.col("_hidden"), F.col(col)))


def compare_imputers(
    df: DataFrame, spec: PanelSpec, col: str, methods: Sequence[str], start: int, length: int
) -> DataFrame:
    """MAE and RMSE of each method on a hidden block of every key.

    All methods read one masked panel; each adds its own column, so a single
    scan and a single partitioning serve them all.
    """
    masked = blank_block(df, spec, col, start, length)
    for m in methods:
        named = masked.withColumn(f"_by_{m}", F.col(col))
        masked = impute_missing(named, spec, f"_by_{m}", m)
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"_by_{m}").cast("double").alias("filled")) for m in methods])
    long = masked.filter("_hidden").select("_truth", F.inline(pairs))
    err = F.col("_truth") - F.col("filled")
    return long.groupBy("method").agg(
        F.count(err).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse")
    )
