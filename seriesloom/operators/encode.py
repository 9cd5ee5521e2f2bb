"""Category encodings. A fit is a small table; applying it is an equi-join.

Lookup tables are as large as the column's cardinality, so the join strategy is
left to the planner, which broadcasts only below its size threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.exact import running_total
from seriesloom.operators.impute import join_on_keys
from seriesloom.session import reliable_checkpoint
from seriesloom.spec import PanelSpec


def fit_labels(df: DataFrame, col: str) -> DataFrame:
    """Codes from 0 in text order of the non-null values: ``(value, code)``."""
    levels = df.select(F.col(col).cast("string").alias("value")).dropna().distinct()
    return running_total(levels, ["value"], None, "_n").select("value", (F.col("_n") - 1).cast("bigint").alias("code"))


def _map(df: DataFrame, col: str, lookup: DataFrame, value: str, name: str) -> DataFrame:
    keyed = lookup.select(F.col("value").alias("_value"), F.col(value).alias("_mapped"))
    joined = df.join(keyed, F.col(col).cast("string") == F.col("_value"), "left").drop("_value")
    return joined.withColumn(name, F.col("_mapped")).drop("_mapped")


def label_encode(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    fits = {c: fit_labels(df, c) for c in cols}
    for c, fit in fits.items():
        df = _map(df, c, fit, "code", c)
    return df, fits


def apply_label_encoding(df: DataFrame, fits: dict[str, DataFrame], unknown: int = -1) -> DataFrame:
    for c, fit in fits.items():
        if c in df.columns:
            df = _map(df, c, fit, "code", c).withColumn(c, F.coalesce(c, F.lit(unknown).cast("bigint")))
    return df


def one_hot_encode(df: DataFrame, cols: Sequence[str], levels: dict[str, Sequence] | None = None, drop_first: bool = False, max_levels: int = 1000) -> DataFrame:
    """0/1 column per level.

    Levels become column names, so they are needed at plan time. A column with
    more than ``max_levels`` levels is an error: use :func:`one_hot_vector`.
    """
    for c in cols:
        found = list((levels or {}).get(c, ()))
        if not found:
            rows = df.select(c).dropna().distinct().orderBy(c).limit(max_levels + 1).collect()
            if len(rows) > max_levels:
                raise ValueError(f"{c} has more than {max_levels} levels; use one_hot_vector")
            found = [r[0] for r in rows]
        for v in found[1:] if drop_first else found:
            df = df.withColumn(f"{c}_{v}", F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)))
        df = df.drop(c)
    return df


def one_hot_vector(df: DataFrame, cols: Sequence[str], drop_last: bool = False) -> DataFrame:
    """Sparse one-hot vectors ``<col>_vec`` for columns of high cardinality."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    idx = [f"{c}_idx" for c in cols]
    indexed = StringIndexer(inputCols=list(cols), outputCols=idx, stringOrderType="alphabetAsc", handleInvalid="keep").fit(df).transform(df)
    encoder = OneHotEncoder(inputCols=idx, outputCols=[f"{c}_vec" for c in cols], dropLast=drop_last)
    return encoder.fit(indexed).transform(indexed).drop(*idx)


def frequency_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``<col>_freq``: rows with the same value, nulls counted as a value."""
    for c in cols:
        counts = df.groupBy(c).agg(F.count("*").alias(f"{c}_freq"))
        df = join_on_keys(df, counts, [c])
    return df


def fit_target_encoding(train: DataFrame, cols: Sequence[str], target: str, smoothing: float = 10.0) -> dict[str, DataFrame]:
    """Smoothed target mean per value, from the training part only.

    ``__global_mean__`` is one row.
    """
    prior = train.agg(F.avg(target).alias("_g"))
    fits = {"__global_mean__": prior}
    for c in cols:
        stats = train.groupBy(c).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
        smooth = F.when(F.col("_n") > 0, (F.col("_s") + F.col("_g") * smoothing) / (F.col("_n") + smoothing))
        fits[c] = stats.join(F.broadcast(prior)).select(c, smooth.alias(f"{c}_te"))
    return fits


def fit_target_encodings(rows: DataFrame, col: str, targets: Mapping[str, Column], smoothing: float = 10.0) -> tuple[DataFrame, dict[str, float | None]]:
    """Smoothed means of several targets per value of ``col`` in one aggregation, and their global means.

    A target is null on the rows that it does not learn from. The table has a row per value and a column per target.
    """
    sums = [a for i, t in enumerate(targets.values()) for a in (F.sum(t).alias(f"_s{i}"), F.count(t).alias(f"_n{i}"))]
    stats = reliable_checkpoint(rows.groupBy(col).agg(*sums))
    row = stats.agg(*[(F.sum(f"_s{i}") / F.sum(f"_n{i}")).alias(f"g{i}") for i in range(len(targets))]).first()
    priors = {name: row[f"g{i}"] for i, name in enumerate(targets)}
    means = [
        F.when(F.col(f"_n{i}") > 0, (F.col(f"_s{i}") + F.lit(priors[name]) * smoothing) / (F.col(f"_n{i}") + smoothing)).cast("double").alias(name)
        for i, name in enumerate(targets)
    ]
    return stats.select(col, *means), priors


def apply_target_encoding(df: DataFrame, fits: dict[str, DataFrame]) -> DataFrame:
    """Unseen values get the global mean."""
    df = df.join(F.broadcast(fits["__global_mean__"]))
    for c, fit in fits.items():
        if c in df.columns and c != "__global_mean__":
            df = join_on_keys(df, fit, [c]).withColumn(f"{c}_te", F.coalesce(f"{c}_te", "_g"))
    return df.drop("_g")


def target_encode(train: DataFrame, cols: Sequence[str], target: str, smoothing: float = 10.0) -> tuple[DataFrame, dict[str, DataFrame]]:
    fits = fit_target_encoding(train, cols, target, smoothing)
    out = train
    for c in cols:
        out = join_on_keys(out, fits[c], [c])
    return out, fits


def factorize(df: DataFrame, spec: PanelSpec, col: str, name: str) -> DataFrame:
    """Codes in order of first appearance by keys and date; null is -1."""
    order = [*spec.key_cols, spec.date_col]
    first = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(F.struct(*order)).alias("_o"))
    seen = first.select(F.col(col).cast("string").alias("value"), "_o.*")
    seen = seen.toDF("value", *[f"_o{i}" for i in range(len(order))])
    codes = running_total(seen, [*[f"_o{i}" for i in range(len(order))], "value"], None, "_n")
    lookup = codes.select("value", (F.col("_n") - 1).alias("code"))
    return _map(df, col, lookup, "code", name).withColumn(name, F.coalesce(name, F.lit(-1).cast("bigint")))


def encode_categoricals(df: DataFrame, spec: PanelSpec, cols: Sequence[str], method: str = "category") -> DataFrame:
    """Codes in place of the columns: ``category`` by text order, ``label`` by first appearance."""
    if method == "category":
        return label_encode(df, cols)[0]
    if method != "label":
        raise ValueError(f"unknown encoding: {method}")
    for c in cols:
        df = factorize(df, spec, c, c)
    return df


def shared_levels(parts: Sequence[DataFrame], col: str) -> tuple[list[DataFrame], DataFrame]:
    """One code table over all parts (training and test), applied to each."""
    together = parts[0].select(col)
    for p in parts[1:]:
        together = together.unionByName(p.select(col))
    fit = fit_labels(together, col)
    return [_map(p, col, fit, "code", col) for p in parts], fit
