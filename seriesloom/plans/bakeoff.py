"""Comparison of learned, additive and baseline forecasts on one hold-out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators import forecast as FC
from seriesloom.operators import scoring, select
from seriesloom.operators.additive import AdditiveModel
from seriesloom.operators.features import FeatureBuilder
from seriesloom.operators.grid import future_dates
from seriesloom.operators.learners import DirectMultiHorizonForecaster, QuantileForecaster, RecursiveForecaster, quantile_name
from seriesloom.operators.splits import date_span, holdout_horizon_split
from seriesloom.session import reliable_checkpoint
from seriesloom.spec import PanelSpec


@dataclass
class BakeOff:
    forecasts: DataFrame
    point: DataFrame
    probabilistic: DataFrame
    ranking: DataFrame


def run_bakeoff(panel: DataFrame, spec: PanelSpec, builder: FeatureBuilder, horizon: int, season_length: int, params: Mapping, additive_keys: int | None = None) -> BakeOff:
    """Recursive, direct, quantile, additive and seasonal-naive forecasts of the last periods.

    All models forecast the same keys, so their scores compare. ``additive_keys``
    keeps the additive model to the keys with the largest volume; its row in the
    table then says how many values it scored.
    """
    split = holdout_horizon_split(panel, spec, horizon, horizon)
    fit, valid, test = split.train, split.val, split.test
    known = split.frame.filter(F.col("split") != "test").drop("split")

    rec = RecursiveForecaster(builder, params).fit(fit, valid).predict_recursive(known, horizon)
    anchor = date_span(known, spec)[1]
    direct = DirectMultiHorizonForecaster(builder, range(1, horizon + 1), params).fit(fit, valid).predict(known, anchor)
    quant = QuantileForecaster(builder, (0.1, 0.5, 0.9), params).fit_ahead(fit, valid, horizon).predict_ahead(known, horizon)
    big = known if additive_keys is None else select.keep_keys(known, select.top_keys(known, spec, additive_keys), spec)
    additive = AdditiveModel(spec).predict(big, future_dates(big, spec, horizon))
    # Forecasts are one row per key and step; written out, they are made once for all tables below.
    rec, direct, quant, additive = (reliable_checkpoint(t) for t in (rec, direct, quant, additive))
    naive = FC.seasonal_naive_forecast(known, spec, horizon, season_length)

    cols = [*spec.key_cols, spec.date_col, "model", "yhat"]
    lo, mid, hi = (quantile_name(q) for q in (0.1, 0.5, 0.9))
    tables = {"recursive": rec, "direct": direct, "quantile": quant.withColumn("yhat", F.col(mid)), "additive": additive}
    forecasts = naive.select(*cols)
    for name, t in tables.items():
        forecasts = forecasts.unionByName(t.withColumn("model", F.lit(name)).select(*cols))
    point = scoring.compare_models(test, forecasts, known, spec, season_length)

    bands = quant.select(*spec.key_cols, spec.date_col, F.lit("quantile").alias("model"), F.col(lo).alias("lo"), F.col(hi).alias("hi")).unionByName(
        additive.select(*spec.key_cols, spec.date_col, F.lit("additive").alias("model"), F.col("yhat_lower").alias("lo"), F.col("yhat_upper").alias("hi"))
    )
    scored = scoring.align(test, bands, spec).filter(F.col("model").isNotNull())
    prob = scoring.probabilistic_report(scored, spec.target_col, {0.1: "lo", 0.9: "hi"}, ["model"])
    return BakeOff(forecasts, point, prob, scoring.join_point_and_probabilistic(point, prob))
