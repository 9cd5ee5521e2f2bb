"""The workflow of single series, run for every key: split, forecast, compare, refit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators import forecast as FC
from seriesloom.operators import scoring
from seriesloom.operators.impute import join_on_keys
from seriesloom.operators.splits import train_test_split_ts
from seriesloom.session import reliable_checkpoint
from seriesloom.spec import PanelSpec


@dataclass
class UnivariateResult:
    comparison: DataFrame
    best: DataFrame
    forecast: DataFrame


def run_workflow(df: DataFrame, spec: PanelSpec, horizon: int, season_length: int, models: Sequence[str], ahead: int | None = None, fallback: str = "naive") -> UnivariateResult:
    """Hold out the last ``horizon`` rows of each key, score the models, refit the best per key.

    A key without any score (too short to hold out rows) is forecast by ``fallback``;
    ``reason`` in ``best`` says so.
    """
    parts = train_test_split_ts(df, spec, horizon)
    train, test = parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'").drop("split")
    made = FC.forecast_all(train, spec, horizon, season_length, models)
    scored = join_on_keys(scoring.align(test, made, spec), scoring.naive_scale(train, spec, season_length), spec.key_cols)
    table = scoring.forecast_metrics(scored.filter(F.col("model").isNotNull()), spec.target_col, "yhat", [*spec.key_cols, "model"], "scale")
    # One row per key; written out so that the refit does not repeat the comparison.
    every = join_on_keys(df.select(*spec.key_cols).distinct(), FC.best_model_per_key(table, spec), spec.key_cols)
    named = every.withColumn("reason", F.when(F.col("model").isNull(), "no score on the held-out rows"))
    best = reliable_checkpoint(named.withColumn("model", F.coalesce("model", F.lit(fallback))))
    return UnivariateResult(table, best, FC.refit_best(df, best, spec, ahead or horizon, season_length, list(dict.fromkeys([*models, fallback]))))
