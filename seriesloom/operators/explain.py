"""Importance and attribution of fitted models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import metrics as M
from seriesloom.operators.exact import running_total
from seriesloom.operators.learners import PanelRegressor
from seriesloom.session import reliable_checkpoint


def _core(model: PanelRegressor):
    stages = model.model.stages if isinstance(model.model, PipelineModel) else [model.model]
    return stages[-1]


def _percent(df: DataFrame) -> DataFrame:
    total = df.agg(F.sum("importance").alias("_t"))
    return df.join(F.broadcast(total)).select(
        "feature", "importance", F.coalesce(F.try_divide(F.col("importance") * 100, F.col("_t")), F.lit(0.0)).alias("importance_pct")
    )


def importance(df: DataFrame, model: PanelRegressor, kind: str = "gain") -> DataFrame:
    """``(feature, importance, importance_pct)`` of a tree model, by gain or by number of splits."""
    if kind not in ("gain", "split"):
        raise ValueError("kind must be 'gain' or 'split'")
    spark, trees = df.sparkSession, model.model
    rows = [(n, float(v)) for n, v in zip(model.vector_names, trees.gains() if kind == "gain" else trees.counts(), strict=True)]
    # One row per feature of a fitted model.
    return _percent(spark.createDataFrame(rows, "feature string, importance double"))


#: Features scored by one pass over the paired rows.
AT_ONCE = 4


def beside_shuffled(df: DataFrame, columns: Sequence[str], identity: Sequence[str], seed: int) -> DataFrame:
    """Adds ``_s0``, ``_s1``, ...: the columns of another row, rows in one hash order paired with rows in another.

    Ranks are distributed running counts, taken once for all columns; the pairing is one equi-join.
    """
    slim = df.select(*identity, *[F.col(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    target = running_total(df.withColumn("_h", F.xxhash64(*identity, F.lit(seed))), ["_h", *identity], None, "_rank").drop("_h")
    base = running_total(slim.withColumn("_h", F.xxhash64(*identity, F.lit(seed + 1))), ["_h", *identity], None, "_rank")
    return target.join(base.select("_rank", *[f"_s{i}" for i in range(len(columns))]), "_rank").drop("_rank")


def permutation_importance(
    rows: DataFrame, model: PanelRegressor, identity: Sequence[str], features: Sequence[str] | None = None,
    metric: Callable[[Column, Column], Column] = M.rmse, seed: int = 0,
) -> DataFrame:
    """Rise of the error when one feature is shuffled: ``(feature, base, shuffled, increase)``.

    All features take their values from the same shuffled row. A pass scores ``AT_ONCE``
    features, so that its generated code stays small.
    """
    y = model.builder.spec.target_col
    wanted = list(features or model.inputs)
    encoded = model.encode(rows.filter(F.col(y).isNotNull())).select(*identity, *[c for c in dict.fromkeys([y, *model.inputs]) if c not in identity])
    # Written out: the predictions below read it once, the ranks are not repeated.
    paired = reliable_checkpoint(beside_shuffled(encoded, wanted, identity, seed))
    base = model.predict(paired, encoded=True).agg(metric(F.col(y), F.col("yhat")).alias("base"))
    out = None
    for start in range(0, len(wanted), AT_ONCE):
        some = list(enumerate(wanted))[start : start + AT_ONCE]
        scored = paired
        for i, f in some:
            swapped = scored.withColumns({"_own": F.col(f), f: F.col(f"_s{i}")})
            scored = model.predict(swapped, encoded=True).withColumn(f, F.col("_own")).withColumnRenamed("yhat", f"_p{i}").drop("_own")
        errors = scored.agg(*[metric(F.col(y), F.col(f"_p{i}")).alias(f"_p{i}") for i, _ in some])
        part = errors.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_p{i}").alias("shuffled")) for i, f in some])))
        out = part if out is None else out.unionByName(part)
    both = out.join(F.broadcast(base))
    return both.select("feature", "base", "shuffled", (F.col("shuffled") - F.col("base")).alias("increase"))


def linear_contributions(rows: DataFrame, model: PanelRegressor, identity: Sequence[str]) -> DataFrame:
    """Exact attributions of a linear model on its link scale.

    ``(identity, feature, value, contribution, base_value, link)`` where base plus
    the contributions of a row equals its link. The base is the model at the
    training means, to which features were centred.
    """
    from pyspark.ml.functions import vector_to_array

    core, scaler = _core(model), model.model.stages[0]
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    beta = core.coefficients.toArray()
    vectors = model._vectors(model.encode(rows)).withColumn("_a", vector_to_array("_raw"))
    parts = [
        F.struct(
            F.lit(name).alias("feature"),
            F.col("_a")[i].alias("value"),
            ((F.col("_a")[i] - float(mean[i])) * float(beta[i] / std[i] if std[i] > 0 else 0.0)).alias("contribution"),
        )
        for i, name in enumerate(model.vector_names)
    ]
    listed = vectors.select(*identity, F.array(*parts).alias("_p"))
    total = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["contribution"])
    base = float(core.intercept)
    return listed.withColumn("link", total + base).select(*identity, F.lit(base).alias("base_value"), "link", F.inline("_p"))


def attribution_summary(contributions: DataFrame) -> DataFrame:
    """Mean absolute and mean signed contribution per feature."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean"))


def local_attribution(contributions: DataFrame, condition: Column) -> DataFrame:
    """Contributions of the chosen row, strongest first."""
    return contributions.filter(condition).orderBy(F.abs("contribution").desc(), "feature")


def dependence(contributions: DataFrame, feature: str) -> DataFrame:
    """Feature value against its contribution."""
    return contributions.filter(F.col("feature") == feature).select(F.col("value").alias(feature), "contribution")
