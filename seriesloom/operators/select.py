"""Selection of series, rows and columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.impute import join_on_keys
from seriesloom.spec import PanelSpec


def get_series(df: DataFrame, spec: PanelSpec, key_values: Mapping | Sequence, sort: bool = True) -> DataFrame:
    """Rows of one series; a mapping may name only some of the keys."""
    if not isinstance(key_values, Mapping):
        if len(key_values) != len(spec.key_cols):
            raise ValueError("one value per key column is needed")
        key_values = dict(zip(spec.key_cols, key_values, strict=True))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in key_values.items()], F.lit(True))
    rows = df.filter(same)
    return rows.orderBy(spec.date_col) if sort else rows


def composite_key(cols: Sequence[str], sep: str = "_") -> Column:
    """Joined key text; null when any part is null."""
    parts = [F.col(cols[0]).cast("string")]
    for c in cols[1:]:
        parts += [F.lit(sep), F.col(c).cast("string")]
    return F.concat(*parts)


def _draw(identity: Sequence[str], seed: int) -> Column:
    """MD5 of the identity values and the seed: an order that other engines can repeat."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in identity], F.lit(str(seed))))


def sample_keys(df: DataFrame, spec: PanelSpec, n: int, seed: int = 42) -> DataFrame:
    """All rows of ``n`` keys drawn by a seeded hash, the same on every run and engine."""
    keys = df.select(*spec.key_cols).distinct()
    chosen = keys.orderBy(_draw(spec.key_cols, seed), *spec.key_cols).limit(n)
    return join_on_keys(df, chosen, spec.key_cols, "left_semi")


def sample_rows(df: DataFrame, n: int, identity: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``n`` rows in hash order of their identity columns."""
    return df.orderBy(_draw(identity, seed), *identity).limit(n)


def first_keys(df: DataFrame, spec: PanelSpec, n: int) -> DataFrame:
    return df.select(*spec.key_cols).distinct().orderBy(*spec.key_cols).limit(n)


def top_keys(df: DataFrame, spec: PanelSpec, n: int) -> DataFrame:
    """Keys with the largest total target; ties by key."""
    totals = df.groupBy(*spec.key_cols).agg(F.sum(spec.target_col).alias("total"))
    return totals.orderBy(F.desc("total"), *spec.key_cols).limit(n)


def keep_keys(df: DataFrame, keys: DataFrame, spec: PanelSpec) -> DataFrame:
    return join_on_keys(df, keys.select(*spec.key_cols), spec.key_cols, "left_semi")


def head_per_key(df: DataFrame, spec: PanelSpec, n: int) -> DataFrame:
    """First ``n`` rows of each key."""
    return df.withColumn("_r", F.row_number().over(spec.in_order())).filter(F.col("_r") <= n).drop("_r")


def tail_per_key(df: DataFrame, spec: PanelSpec, n: int) -> DataFrame:
    """Last ``n`` rows of each key."""
    return df.withColumn("_r", F.row_number().over(spec.in_reverse())).filter(F.col("_r") <= n).drop("_r")


def evenly_spaced(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """About ``n`` rows at equal steps of the table order, both ends included.

    ``order`` tells rows apart. Positions come from a distributed running count over its columns alone; the rows
    are then picked by a semi-join with the at most ``n`` values found.
    """
    from seriesloom.operators.exact import running_total

    ranked = running_total(df.select(*order), order, None, "_pos")
    total = df.agg(F.count("*").alias("_n"))
    placed = ranked.join(F.broadcast(total)).withColumn("_pos", F.col("_pos") - 1)
    slots = F.least(F.lit(n), F.col("_n"))
    span = F.greatest(F.col("_n") - 1, F.lit(1))
    # Row p is the pick of slot s when p = floor(s * (N - 1) / (slots - 1)).
    gaps = F.greatest(slots - 1, F.lit(1))
    slot = F.ceil(F.col("_pos") * gaps / span)
    hit = F.floor(slot * span / gaps) == F.col("_pos")
    return join_on_keys(df, placed.filter(hit & (slot <= gaps)).select(*order), order, "left_semi")


def columns_starting(df: DataFrame, prefixes: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def ordered_report(report: DataFrame, by: str, keys: Sequence[str], ascending: bool = False) -> DataFrame:
    """A report in its display order, with the keys as tie-break."""
    first = F.col(by).asc() if ascending else F.col(by).desc()
    return report.orderBy(first, *keys)


def strongest(cols: Sequence[str]) -> Column:
    """Row-wise maximum that ignores nulls."""
    return F.greatest(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])


def not_below(col: Column, floor: float = 0.0) -> Column:
    """Lower clip that keeps nulls."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(floor)))


def latest_row_per_key(df: DataFrame, spec: PanelSpec, value: str) -> DataFrame:
    return df.groupBy(*spec.key_cols).agg(F.max_by(value, spec.date_col).alias(value))


def rank_within(keys: Sequence[str], order: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
