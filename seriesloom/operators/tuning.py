"""Search over parameter sets, scored on walk-forward folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions import metrics as M
from seriesloom.operators.blocks import Blocks
from seriesloom.operators.boosting import HELD, TRAIN
from seriesloom.operators.features import FeatureBuilder
from seriesloom.operators.learners import DEFAULT_PARAMS, PanelRegressor, is_tree
from seriesloom.operators.reweighted import reweight
from seriesloom.operators.splits import Folds
from seriesloom.operators.windows import best_so_far
from seriesloom.session import dealt


def parameter_grid(spark: SparkSession, grid: Mapping[str, Sequence]) -> DataFrame:
    """``trial`` and one column per parameter: the product of the lists, in list order."""
    out = spark.range(1).select(F.lit(0).cast("bigint").alias("trial"))
    for name, values in grid.items():
        # The product is built from literals inside the plan; nothing is joined.
        entries = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(v).alias(name)) for i, v in enumerate(values)])
        out = out.select("*", F.inline(entries)).withColumn("trial", F.col("trial") * len(values) + F.col("_i")).drop("_i")
    return out


def sample_space(spark: SparkSession, space: Mapping[str, Mapping], n_trials: int, seed: int = 42) -> DataFrame:
    """``n_trials`` draws of a declared space, the same for the same seed.

    Entries: ``{"type": "int" | "float" | "log_float", "low", "high", "step"}`` or
    ``{"type": "categorical", "choices"}``.
    """
    cols = []
    for name, want in space.items():
        u = F.pmod(F.xxhash64("trial", F.lit(name), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        kind = want["type"]
        if kind == "int":
            step = want.get("step", 1)
            slots = (want["high"] - want["low"]) // step + 1
            value = (F.lit(want["low"]) + F.floor(u * slots) * step).cast("int")
        elif kind == "float":
            value = want["low"] + u * (want["high"] - want["low"])
        elif kind == "log_float":
            lo, hi = math.log(want["low"]), math.log(want["high"])
            value = F.exp(lo + u * (hi - lo))
        elif kind == "categorical":
            choices = F.array(*[F.lit(c) for c in want["choices"]])
            value = choices[F.floor(u * len(want["choices"])).cast("int")]
        else:
            raise ValueError(f"unknown parameter type: {kind}")
        cols.append(value.alias(name))
    return spark.range(n_trials).withColumnRenamed("id", "trial").select("trial", *cols)


def _linear_scores(
    rows: DataFrame, base: PanelRegressor, folds: Folds, fold: int, sets: Sequence[Mapping], metric: Callable[[Column, Column], Column], parallelism: int
) -> list[float | None]:
    """Scores of linear models, each fitted by MLlib on vectors that are made once for all sets."""
    y = base.builder.spec.target_col
    train, valid = (base.encode(part.filter(F.col(y).isNotNull())) for part in folds.pair(rows, base.builder.spec, fold))
    data, held = base.prepare(train, y).persist(), valid.persist()

    def score(params: Mapping) -> float | None:
        model = base.with_params(params).learn(data)
        return model.predict(held, encoded=True).agg(metric(F.col(y), F.col("yhat"))).first()[0]

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            return list(pool.map(score, sets))
    finally:
        data.unpersist()
        held.unpersist()


def _stored_folds(rows: DataFrame, bases: Mapping[int, PanelRegressor], folds: Folds) -> Blocks:
    """Blocks of the features, and per fold of the key means that its training range gives and the part of a row in it."""
    first = next(iter(bases.values()))
    spec, keys = first.builder.spec, first.encoded_keys
    d, out, names = F.col(spec.date_col), rows.withColumns({"_label": F.col(spec.target_col), "_weight": F.lit(1.0)}), []
    for f in folds:
        out = bases[f.fold].encode(out).withColumnsRenamed({f"{k}_te": f"{k}_te{f.fold}" for k in keys})
        part = F.when(d.between(F.lit(f.train_start), F.lit(f.train_end)), TRAIN).when(d.between(F.lit(f.valid_start), F.lit(f.valid_end)), HELD)
        out = out.withColumn(f"_part{f.fold}", part)
        names += [*[f"{k}_te{f.fold}" for k in keys], f"_part{f.fold}"]
    shared = [c for c in first.inputs if c not in {f"{k}_te" for k in keys}]
    return Blocks.of(out.filter(F.col("_label").isNotNull()), [*shared, *names, "_label", "_weight"], [*spec.key_cols, spec.date_col])


def search(df: DataFrame, builder: FeatureBuilder, folds: Folds, base_params: Mapping, trials: DataFrame, metric: Callable[[Column, Column], Column] = M.rmse, parallelism: int = 2) -> DataFrame:
    """Score every trial on every fold: ``trial, params.., fold, score, state``.

    Features are computed and stored once for all folds and trials; key means, fills and cut points are those of a fold's
    training range. Trees of a fold grow in the same passes, and so do its Tweedie and Poisson models; other linear models are
    fitted a few side by side.
    The driver holds one number per trial and fold.
    """
    names = [c for c in trials.columns if c != "trial"]
    listed = trials.orderBy("trial").collect()
    sets = [{**DEFAULT_PARAMS, **base_params, **{c: r[c] for c in names}} for r in listed]
    trees = [i for i, s in enumerate(sets) if is_tree(s)]
    rated = [i for i, s in enumerate(sets) if s["objective"] in ("tweedie", "poisson")]
    others = [i for i in range(len(sets)) if i not in {*trees, *rated}]
    y = builder.spec.target_col
    rows = builder.transform(dealt(df, *builder.spec.key_cols))
    bases = {f.fold: PanelRegressor(builder) for f in folds}
    for f, base in bases.items():
        # Key means need the panel alone.
        base._learn_encodings(folds.pair(df, builder.spec, f)[0].filter(F.col(y).isNotNull()), y)
    scores: dict[tuple[int, int], float | None] = {}
    if trees or rated:
        store = _stored_folds(rows, bases, folds)
        try:
            for f, base in bases.items():
                columns = [f"{c}{f}" if c in {f"{k}_te" for k in base.encoded_keys} else c for c in base.inputs]

                def judge(own: list[int], f: int = f) -> Callable[[DataFrame, list[int]], None]:
                    def note(made: DataFrame, ids: list[int]) -> None:
                        row = made.agg(*[metric(F.col("_y"), F.col(f"_p{i}")) for i in ids]).first()
                        scores.update({(own[i], f): v for i, v in zip(ids, row, strict=True)})

                    return note

                if trees:
                    base.grow(store, [sets[i] for i in trees], f"_part{f}", names=columns, judge=judge(trees))
                if rated:
                    reweight(store, columns, [sets[i] for i in rated], "_label", f"_part{f}", judge(rated))
        finally:
            store.drop()
    if others:
        kept = rows.persist()
        try:
            for f, base in bases.items():
                made = _linear_scores(kept, base, folds, f, [sets[i] for i in others], metric, parallelism)
                scores |= {(i, f): v for i, v in zip(others, made, strict=True)}
        finally:
            kept.unpersist()
    done = [(r["trial"], f, scores[i, f], "COMPLETE" if scores[i, f] is not None else "FAIL") for f in bases for i, r in enumerate(listed)]
    scored = df.sparkSession.createDataFrame(done, "trial bigint, fold int, score double, state string")
    return trials.join(scored, "trial")


def ranking(scores: DataFrame, params: Sequence[str], folds: int) -> DataFrame:
    """One row per trial: mean and population deviation of the fold scores, and each fold."""
    out = scores.groupBy("trial", *params).agg(
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
        *[F.max(F.when(F.col("fold") == i, F.col("score"))).alias(f"fold{i}") for i in range(folds)],
    )
    return out.orderBy("mean_score", "trial")


def grid_search(df: DataFrame, builder: FeatureBuilder, folds: Folds, base_params: Mapping, grid: Mapping[str, Sequence], metric=M.rmse, parallelism: int = 2) -> DataFrame:
    trials = parameter_grid(df.sparkSession, grid)
    return ranking(search(df, builder, folds, base_params, trials, metric, parallelism), list(grid), len(folds))


def trial_history(scores: DataFrame, params: Sequence[str]) -> DataFrame:
    """Trials in order with the best mean score so far. One row per trial, so one small window."""
    per = scores.groupBy("trial", *params).agg(F.avg("score").alias("value"), F.min("state").alias("state"))
    return per.withColumn("best_so_far", best_so_far(Window.partitionBy(F.lit(0)).orderBy("trial"), "value"))


def state_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("state").agg(F.count("*").alias("n"))


def score_matrix(ranked: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Pivot of mean scores over two parameters."""
    return ranked.groupBy(row).pivot(column, list(values)).agg(F.avg("mean_score"))
