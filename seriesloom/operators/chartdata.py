"""The tables behind charts; drawing is left to the caller."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.statistics import count_where
from seriesloom.operators import demand, select, splits
from seriesloom.operators.exact import exact_quantiles
from seriesloom.operators.impute import join_on_keys
from seriesloom.operators.outliers import Detector, detect_outliers_iqr
from seriesloom.operators.tsstats import autocorrelation
from seriesloom.operators.windows import cycle_position
from seriesloom.spec import PanelSpec


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """``(bin, lower, upper, n)`` of equal-width bins over the range of the column."""
    v = F.col(col).cast("double")
    span = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.least(F.floor(F.coalesce(F.try_divide(v - F.col("_lo"), width), F.lit(0.0))), F.lit(bins - 1))
    placed = df.filter(v.isNotNull()).join(F.broadcast(span)).groupBy(slot.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n"))
    return placed.select("bin", (F.col("_lo") + width * F.col("bin")).alias("lower"), (F.col("_lo") + width * (F.col("bin") + 1)).alias("upper"), "n")


def box_numbers(df: DataFrame, col: str) -> DataFrame:
    """Quartiles and the whiskers: the extreme values within 1.5 interquartile ranges."""
    q = exact_quantiles(df, [col], [0.25, 0.5, 0.75]).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(col).cast("double")
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    return df.join(F.broadcast(q)).groupBy("q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), count_where(~inside).alias("n_outside")
    )


def missing_grid(df: DataFrame, order: Sequence[str], columns: Sequence[str], rows: int = 1500) -> DataFrame:
    """Evenly spaced rows with 1 for a missing and 0 for a present value."""
    picked = select.evenly_spaced(df, order, rows)
    return picked.select(*order, *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns])


def calendar_heatmap(df: DataFrame, date_col: str, col: str, how: str = "mean") -> DataFrame:
    """Year by month table."""
    agg = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, 0.5)}[how]
    monthly = df.select(F.year(date_col).alias("year"), F.month(date_col).alias("_m"), F.col(col).alias("_v"))
    return monthly.groupBy("year").pivot("_m", list(range(1, 13))).agg(agg("_v"))


def seasonal_cycles(df: DataFrame, spec: PanelSpec, period: int) -> DataFrame:
    """``(keys, cycle, position, value)``: one line per cycle."""
    cycle, position = cycle_position(spec, period)
    return df.select(*spec.key_cols, cycle.alias("cycle"), position.alias("position"), F.col(spec.target_col).alias("value"))


def seasonal_cycle_table(df: DataFrame, spec: PanelSpec, period: int, cycles: Sequence[int]) -> DataFrame:
    """Position by cycle table of each key."""
    return seasonal_cycles(df, spec, period).groupBy(*spec.key_cols, "position").pivot("cycle", list(cycles)).agg(F.first("value"))


def class_scatter(classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points of the ADI / CV² chart with their label; infinite and missing values are left out."""
    drawn = classes.filter(F.col("adi").isNotNull() & F.col("cv2").isNotNull() & (F.col("adi") < demand.INFINITY))
    return drawn.select(*keys, "adi", "cv2", "sb_class", F.concat_ws(" | ", *[F.col(k).cast("string") for k in keys]).alias("label"))


def split_sample(split: splits.SplitResult, n_keys: int = 4) -> DataFrame:
    """Rows of a few series with their part."""
    keys = select.first_keys(split.frame, split.spec, n_keys)
    return select.keep_keys(split.frame, keys, split.spec).select(*split.spec.key_cols, split.spec.date_col, split.spec.target_col, "split")


def fold_spans(df: DataFrame, folds: splits.Folds) -> DataFrame:
    """``(fold, part, start, end)`` for a timeline of folds."""
    rows = F.array(
        *[
            F.struct(F.lit(f.fold).alias("fold"), F.lit(p).alias("part"), F.lit(a).alias("start"), F.lit(b).alias("end"))
            for f in folds
            for p, a, b in (("train", f.train_start, f.train_end), ("valid", f.valid_start, f.valid_end))
        ]
    )
    return df.sparkSession.range(1).select(F.inline(rows))


def outlier_points(df: DataFrame, spec: PanelSpec, detector: Detector = detect_outliers_iqr) -> DataFrame:
    """Only the flagged points, to lay over the series."""
    return detector(df, spec, spec.target_col, "_flag").filter("_flag").drop("_flag")


# Coefficients of Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_SPLIT = 0.02425


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function."""

    def poly(coef: Sequence[float], x: Column, tail: float | None = None) -> Column:
        out = F.lit(coef[0])
        for c in coef[1:]:
            out = out * x + c
        return out if tail is None else out * x + tail

    low = F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    mid = p - 0.5
    sq = mid * mid
    return (
        F.when(p < _SPLIT, poly(_C, low) / poly(_D, low, 1.0))
        .when(p > 1 - _SPLIT, -poly(_C, high) / poly(_D, high, 1.0))
        .otherwise(poly(_A, sq) * mid / poly(_B, sq, 1.0))
    )


def qq_points(df: DataFrame, spec: PanelSpec, col: str) -> DataFrame:
    """Ordered values of each key against normal quantiles at Filliben's positions."""
    rows = df.filter(F.col(col).isNotNull())
    i = F.row_number().over(Window.partitionBy(*spec.key_cols).orderBy(col))
    n = F.count("*").over(spec.per_key()).cast("double")
    end = F.pow(F.lit(0.5), 1 / F.col("_n"))
    position = F.when(F.col("_i") == F.col("_n"), end).when(F.col("_i") == 1, 1 - end).otherwise((F.col("_i") - 0.3175) / (F.col("_n") + 0.365))
    placed = rows.select(*spec.key_cols, i.alias("_i"), n.alias("_n"), F.col(col).alias("sample"))
    return placed.select(*spec.key_cols, normal_quantile(position).alias("theoretical"), "sample")


def residual_diagnostics(residuals: DataFrame, spec: PanelSpec, col: str = "residual", bins: int = 30, nlags: int = 20) -> dict[str, DataFrame]:
    """Tables of the residual chart: bins, autocorrelation, quantile points and moments."""
    return {
        "bins": histogram(residuals, col, bins),
        "acf": autocorrelation(residuals, spec, col, nlags),
        "qq": qq_points(residuals, spec, col),
        "moments": residuals.agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.count(col).alias("n")),
    }


def normal_density(x: Column, mean: Column, std: Column) -> Column:
    z = (x - mean) / std
    return F.exp(-z * z / 2) / (std * math.sqrt(2 * math.pi))


def top_bars(report: DataFrame, by: str, label: str, n: int = 20) -> DataFrame:
    """Largest rows of a report."""
    return report.orderBy(F.desc(by), label).limit(n).select(label, by)


def nonzero_share(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Text such as ``12/40 non-zero periods (30%)`` per key."""
    y = F.col(spec.target_col)
    stats = df.groupBy(*spec.key_cols).agg(count_where(y > 0).alias("nonzero"), F.count("*").alias("periods"))
    pct = F.bround(F.try_divide(F.col("nonzero") * 100.0, F.col("periods"))).cast("int")
    text = F.concat(F.col("nonzero"), F.lit("/"), F.col("periods"), F.lit(" non-zero periods ("), pct, F.lit("%)"))
    return stats.withColumn("annotation", text)


def quantile_bands(forecast: DataFrame, keys: Sequence[str], quantiles: Sequence[str]) -> DataFrame:
    """Pairs of quantile columns from the outermost inwards: ``(band, lower, upper)``."""
    pairs = [(quantiles[i], quantiles[-1 - i]) for i in range(len(quantiles) // 2)]
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col(a).alias("lower"), F.col(b).alias("upper")) for i, (a, b) in enumerate(pairs)])
    return forecast.select(*keys, F.inline(bands))


def components_with_actual(components: DataFrame, actual: DataFrame, spec: PanelSpec) -> DataFrame:
    """Component table of an additive model next to the observed values."""
    return join_on_keys(components, actual.select(*spec.key_cols, spec.date_col, F.col(spec.target_col).alias("observed")), [*spec.key_cols, spec.date_col])
