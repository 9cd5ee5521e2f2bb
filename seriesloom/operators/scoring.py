"""Scoring of long forecast tables ``(keys, date, model, horizon, yhat, ...)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import metrics as M
from seriesloom.operators.impute import join_on_keys
from seriesloom.spec import PanelSpec


def align(actual: DataFrame, forecast: DataFrame, spec: PanelSpec) -> DataFrame:
    """Every actual with the forecasts for it; a missing forecast is null."""
    ident = [*spec.key_cols, spec.date_col]
    return join_on_keys(actual.select(*ident, spec.target_col), forecast, ident, "left")


def unmatched_rows(actual: DataFrame, forecast: DataFrame, spec: PanelSpec) -> DataFrame:
    """How many actuals lack a forecast and the reverse.

    Both sides are tagged and counted in one aggregation instead of two joins.
    """
    ident = [*spec.key_cols, spec.date_col]
    both = actual.select(*ident, F.lit(1).alias("_a"), F.lit(0).alias("_f")).unionByName(
        forecast.select(*ident, F.lit(0).alias("_a"), F.lit(1).alias("_f"))
    )
    per = both.groupBy(*ident).agg(F.max("_a").alias("_a"), F.max("_f").alias("_f"))
    return per.agg(
        F.sum(F.when((F.col("_a") == 1) & (F.col("_f") == 0), 1).otherwise(0)).alias("actual_only"),
        F.sum(F.when((F.col("_a") == 0) & (F.col("_f") == 1), 1).otherwise(0)).alias("forecast_only"),
        F.sum(F.col("_a") * F.col("_f")).alias("matched"),
    )


def naive_scale(train: DataFrame, spec: PanelSpec, season: int = 1) -> DataFrame:
    """Per key: mean absolute and mean squared seasonal-naive error in the training part."""
    y = F.col(spec.target_col)
    step = train.withColumn("_e", y - F.lag(y, season).over(spec.in_order()))
    return step.groupBy(*spec.key_cols).agg(
        F.avg(F.abs(F.col("_e"))).alias("scale"), F.avg(F.col("_e") * F.col("_e")).alias("sq_scale")
    )


def metric_report(
    scored: DataFrame, actual: str, forecast: str, by: Sequence[str] = (), scale: str | None = None, sq_scale: str | None = None
) -> DataFrame:
    """Report by any grouping, with scaled metrics when scale columns are given."""
    y, f = F.col(actual), F.col(forecast)
    cols = dict(M.report(y, f))
    if scale:
        cols["MASE"] = M.mase(y, f, F.col(scale))
    if sq_scale:
        cols["RMSSE"] = M.rmsse(y, f, F.col(sq_scale))
    return scored.groupBy(*by).agg(*[c.alias(n) for n, c in cols.items()])


def forecast_metrics(scored: DataFrame, actual: str, forecast: str, by: Sequence[str] = (), scale: str | None = None) -> DataFrame:
    """The univariate report: MAE, MSE, RMSE, MAPE, sMAPE, ME and, with a scale, MASE."""
    y, f = F.col(actual), F.col(forecast)
    cols: dict[str, Column] = {
        "MAE": M.mae(y, f), "MSE": M.mse(y, f), "RMSE": M.rmse(y, f),
        "MAPE": M.mape(y, f), "sMAPE": M.smape(y, f), "ME": M.me(y, f),
    }
    if scale:
        cols["MASE"] = M.mase(y, f, F.col(scale))
    return scored.groupBy(*by).agg(*[c.alias(n) for n, c in cols.items()])


def compare_models(
    actual: DataFrame, forecasts: DataFrame, train: DataFrame, spec: PanelSpec, season: int = 1, by: Sequence[str] = ("model",)
) -> DataFrame:
    """Model table with the number of scored rows.

    Scales are taken per key, so long panels never difference across keys.
    """
    scored = join_on_keys(align(actual, forecasts, spec), naive_scale(train, spec, season), spec.key_cols)
    y, f = F.col(spec.target_col), F.col("yhat")
    cols = dict(M.report(y, f)) | {
        "MASE": M.mase(y, f, F.col("scale")),
        "RMSSE": M.rmsse(y, f, F.col("sq_scale")),
        "coverage_n": F.count(f),
    }
    return scored.filter(F.col("model").isNotNull()).groupBy(*by).agg(*[c.alias(n) for n, c in cols.items()])


def wide_to_long(df: DataFrame, ids: Sequence[str], models: Mapping[str, str]) -> DataFrame:
    """One forecast column per model becomes rows ``(model, yhat)``."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("yhat")) for m, c in models.items()])
    return df.select(*ids, F.inline(rows))


def probabilistic_report(scored: DataFrame, actual: str, quantiles: Mapping[float, str], by: Sequence[str] = ()) -> DataFrame:
    """Pinball loss per quantile, their mean, and coverage and width of the outer interval."""
    y = F.col(actual)
    cols = {f"pinball_{q:.2f}".replace(".", "_"): M.pinball_loss(y, F.col(c), q) for q, c in quantiles.items()}
    lo, hi = F.col(quantiles[min(quantiles)]), F.col(quantiles[max(quantiles)])
    mean = sum(M.pinball_loss(y, F.col(c), q) for q, c in quantiles.items()) / len(quantiles)
    return scored.groupBy(*by).agg(
        *[c.alias(n) for n, c in cols.items()],
        mean.alias("mean_pinball"),
        M.coverage(y, lo, hi).alias("coverage"),
        F.avg(hi - lo).alias("mean_width"),
    )


def wape_by_horizon(scored: DataFrame, actual: str, forecast: str, date_col: str, anchor: str, by: Sequence[str] = ("model",)) -> DataFrame:
    """WAPE by days ahead of the anchor column; the denominator is at least 1."""
    y, f = F.col(actual), F.col(forecast)
    return scored.groupBy(*by, F.datediff(date_col, anchor).alias("horizon")).agg(
        (100 * F.sum(F.abs(y - f)) / F.greatest(F.sum(F.abs(y)), F.lit(1.0))).alias("WAPE")
    )


def running_error(df: DataFrame, spec: PanelSpec, actual: str, forecast: str) -> DataFrame:
    """Cumulative forecast error along each key."""
    frame = spec.in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("cfe", F.sum(F.col(actual) - F.col(forecast)).over(frame))


def residuals(actual: DataFrame, forecast: DataFrame, spec: PanelSpec) -> DataFrame:
    return align(actual, forecast, spec).withColumn("residual", F.col(spec.target_col) - F.col("yhat"))


def join_point_and_probabilistic(point: DataFrame, prob: DataFrame, by: str = "model") -> DataFrame:
    """Ranked model table: point metrics with interval metrics where they exist."""
    return point.join(prob, by, "left").orderBy("WAPE", by)


def average_forecasts(forecasts: Sequence[DataFrame], spec: PanelSpec, name: str = "ensemble") -> DataFrame:
    """Mean of several forecast tables, by one union and one aggregation."""
    ident = [*spec.key_cols, spec.date_col]
    together = forecasts[0].select(*ident, "yhat")
    for f in forecasts[1:]:
        together = together.unionByName(f.select(*ident, "yhat"))
    return together.groupBy(*ident).agg(F.avg("yhat").alias("yhat")).withColumn("model", F.lit(name))
