"""Exact order statistics over whole tables without a single-task sort.

Ranks over a table have no natural partition key. Here distinct values are dealt by range once and stored, so that every
partition is a stretch of the order; a rank is local to its stretch plus the sizes of the stretches before it, of which
there is one number per partition. Quantiles need no order of the table at all: rounds of counts narrow a bracket around
each rank until what is left inside is small.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.impute import join_on_keys
from seriesloom.session import reliable_checkpoint

SKETCH_ACCURACY = 10_000
#: Values of one bracket that a single task may hold and sort, whatever the size of the table.
FINAL_VALUES = 50_000


# --- quantiles -------------------------------------------------------------------------


@dataclass(frozen=True)
class Bracket:
    """The value of rank ``rank`` (from 0) of a column lies strictly between ``lo`` and ``hi`` (None: no bound).

    ``below`` values are at or under ``lo``, ``inner`` inside. ``found`` is the value itself, once it is known.
    """

    column: str
    rank: int
    below: int
    inner: int
    lo: float | None = None
    hi: float | None = None
    found: float | None = None

    def inside(self) -> Column:
        v = F.col(self.column).cast("double")
        out = v.isNotNull()
        if self.lo is not None:
            out = out & (v > F.lit(self.lo))
        return out & (v < F.lit(self.hi)) if self.hi is not None else out

    def probes(self) -> list[float]:
        """Shares of the bracket between which the rank lies with certainty, but for the sketch's error."""
        margin, at = 3.0 / SKETCH_ACCURACY, self.rank - self.below
        return [max(0.0, at / self.inner - margin), min(1.0, (at + 1) / self.inner + margin)]

    def narrowed(self, a: float, b: float, under: int, at_a: int, between: int, at_b: int) -> Bracket:
        """After counting what lies under probe ``a``, at it, between, and at ``b``: whichever part holds the rank."""
        at = self.rank - self.below
        if at < under:
            return replace(self, hi=a, inner=under)
        if at < under + at_a:
            return replace(self, found=a)
        if at < under + at_a + between:
            return replace(self, lo=a, hi=b, below=self.below + under + at_a, inner=between)
        if at < under + at_a + between + at_b:
            return replace(self, found=b)
        less = under + at_a + between + at_b
        return replace(self, lo=b, below=self.below + less, inner=self.inner - less)


def _same(a: float, b: float) -> bool:
    return a == b or (math.isnan(a) and math.isnan(b))


def _counted(df: DataFrame, brackets: Sequence[Bracket], probes: Sequence[Sequence[float]]) -> list[Bracket]:
    """One pass: four counts for each bracket."""
    aggs = []
    for i, (b, (lo, hi)) in enumerate(zip(brackets, probes, strict=True)):
        v, low, high = F.col(b.column).cast("double"), F.lit(lo), F.lit(hi)
        parts = [v < low, v == low, (v > low) & (v < high), (v == high) & F.lit(not _same(lo, hi))]
        aggs += [F.count(F.when(b.inside() & p, 1)).alias(f"n{i}_{j}") for j, p in enumerate(parts)]
    row = df.agg(*aggs).first()
    return [b.narrowed(*p, *row[4 * i : 4 * i + 4]) for i, (b, p) in enumerate(zip(brackets, probes, strict=True))]


def values_inside(df: DataFrame, brackets: Sequence[Bracket]) -> DataFrame:
    """(i, value): the value of each bracket's rank, from the at most ``FINAL_VALUES`` values inside."""
    hits = [F.when(b.inside(), F.struct(F.lit(i).alias("i"), F.col(b.column).cast("double").alias("v"))) for i, b in enumerate(brackets)]
    at = F.array(*[F.lit(b.rank - b.below) for b in brackets])
    inside = df.select(F.inline(F.array_compact(F.array(*hits))))
    sorted_ = inside.groupBy("i").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    return sorted_.select("i", F.get("vs", F.get(at, F.col("i"))).alias("value"))


def ranked_values(df: DataFrame, wanted: Sequence[tuple[str, Sequence[float]]]) -> dict[tuple[str, int], float]:
    """Values at the ranks that linear interpolation of the given probabilities reads: ``{(column, rank): value}``.

    Jobs: one sketch of all columns, one count for all brackets, one for the values left inside. Each further 1600-fold of
    ``FINAL_VALUES`` in a column without ties adds a sketch and a count.
    """
    edges = {c: [p for q in probs for p in (max(q - 3.0 / SKETCH_ACCURACY, 0.0), min(q + 3.0 / SKETCH_ACCURACY, 1.0))] for c, probs in wanted}
    first = df.agg(*[x for c, _ in wanted for x in (F.count(c), F.percentile_approx(F.col(c).cast("double"), edges[c], SKETCH_ACCURACY))]).first()
    brackets, probes = [], []
    for i, (c, probs) in enumerate(wanted):
        total, sketch = first[2 * i], first[2 * i + 1]
        seen: set[int] = set()
        for j, q in enumerate(probs if total else ()):
            k = math.floor((total - 1) * q)
            for rank in {k, min(k + 1, total - 1)} - seen:
                seen.add(rank)
                brackets.append(Bracket(c, rank, 0, total))
                probes.append(sketch[2 * j : 2 * j + 2])
    while brackets:
        done = [b for b in brackets if b.found is not None or b.inner <= FINAL_VALUES]
        if len(done) == len(brackets):
            break
        if probes is None:
            open_ = [b for b in brackets if b not in done]
            sketches = df.agg(*[F.percentile_approx(F.when(b.inside(), F.col(b.column).cast("double")), b.probes(), SKETCH_ACCURACY) for b in open_]).first()
            brackets = done + _counted(df, open_, list(sketches))
        else:
            brackets, probes = _counted(df, brackets, probes), None
    rest = [b for b in brackets if b.found is None]
    values = {(b.column, b.rank): b.found for b in brackets if b.found is not None}
    if rest:
        values |= {(rest[r["i"]].column, rest[r["i"]].rank): r["value"] for r in values_inside(df, rest).collect()}
    return values | {(c, -1): first[2 * i] for i, (c, _) in enumerate(wanted)}


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles of whole columns: ``(column, prob, value)``; a column without values has no row.

    Computed when called: the driver sees a few counts and two values per quantile.
    """
    values = ranked_values(df, [(c, probs) for c in cols])
    rows = []
    for c in cols:
        total = values[c, -1]
        for q in probs if total else ():
            h = (total - 1) * q
            k = math.floor(h)
            low, high = values[c, k], values[c, min(k + 1, total - 1)]
            rows.append((c, float(q), low + (h - k) * (high - low) if h > k else low))
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


# --- ranks -----------------------------------------------------------------------------


def in_ranges(values: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows, stored in stretches of their order, with the number of the stretch in ``_part``."""
    return reliable_checkpoint(values.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def running_total(values: DataFrame, order: Sequence[str], weight: str | None, name: str, group: Sequence[str] = (), keep_part: bool = False) -> DataFrame:
    """Adds ``name``: the weight (or count) of all rows of the group up to and including this one.

    Rows must be distinct in ``group`` and ``order``. The rows are stored when this is called, in as many ranges as there
    are shuffle partitions; ``keep_part`` leaves the number of the range in ``_part``.
    """
    group = list(group)
    parts = in_ranges(values, [*group, *order])
    w = F.col(weight) if weight else F.lit(1)
    sizes = parts.groupBy("_part", *group).agg(F.sum(w).alias("_w"))
    # One number for each range, and for each group inside one: a group's list is as long as there are ranges.
    listed = sizes.groupBy(*group).agg(F.collect_list(F.struct("_part", "_w")).alias("_sizes"))
    earlier = lambda b: F.aggregate(F.filter("_sizes", lambda x: x["_part"] < b["_part"]), F.lit(0).cast("bigint"), lambda t, x: t + x["_w"])
    offsets = listed.select(*group, F.inline(F.transform("_sizes", lambda b: F.struct(b["_part"].alias("_part"), earlier(b).alias("_before")))))
    local = F.sum(w).over(Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    counted = parts.withColumn("_local", local)
    placed = join_on_keys(counted, offsets, ["_part", *group]) if group else counted.join(F.broadcast(offsets), "_part")
    total = placed.withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before")
    return total if keep_part else total.drop("_part")


def average_rank(values: DataFrame, value: str, weight: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Average rank (ties share the middle) of distinct values with their counts."""
    ranked = running_total(values, [value], weight, "_upto", group)
    return ranked.withColumn(name, F.col("_upto") - (F.col(weight) - 1) / 2.0).drop("_upto")


def grouped_quantiles(df: DataFrame, group: str, col: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles per group: ``(group, prob, value)``.

    Positions come from one running total over (group, value) counts, so a group
    that holds most of the rows is spread over the ranges.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(group, F.col(col).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_total(counts, ["_v"], "_n", "_upto", [group])
    totals = placed.groupBy(group).agg(F.sum("_n").alias("_total"))
    rows = join_on_keys(placed, totals, [group]).withColumn("_last", F.col("_upto") - 1)
    rows = rows.withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs])))
    h = (F.col("_total") - 1) * F.col("prob")
    k = F.floor(h)
    first = F.col("_last") - F.col("_n") + 1
    at = lambda pos: F.max(F.when((first <= pos) & (pos <= F.col("_last")), F.col("_v")))
    near = rows.filter((first <= k + 1) & (k <= F.col("_last")))
    part = F.max(h - k)
    value = at(k) + F.when(part > 0, part * (at(k + 1) - at(k))).otherwise(0.0)
    return near.groupBy(group, "prob").agg(value.alias("value"))
