"""Exponential recurrences as running window sums.

Every smoother here has the form ``s_t = a_t * s_(t-1) + b_t`` with
``0 < a_t <= 1``. With ``L_t = sum(ln a)`` the solution is
``s_t = exp(L_t) * sum(b_i * exp(-L_i))``: two running sums, linear in the
series length, inside generated code. The exponents are taken relative to
blocks of bounded decay so that they cannot overflow; what lies more than one
whole block back has decayed below ``exp(-BLOCK)``, which is zero in doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesloom.operators.impute import join_on_keys
from seriesloom.operators.windows import by_blocks
from seriesloom.spec import PanelSpec

# Log-decay spanned by one block; exponents stay within +-BLOCK / 2.
BLOCK = 1200.0


def solve_recurrence(df: DataFrame, keys: Sequence[str], order: str, log_decay: Column, gains: Mapping[str, Column]) -> DataFrame:
    """Adds one column per gain: ``s = decay * s_previous + gain`` from ``s = 0``.

    ``log_decay`` is the running sum of the logarithms of the decays, at the row.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log, block = F.col("_log"), F.col("_block")
    out = df.withColumns({"_log": log_decay, **{f"_g_{n}": g for n, g in gains.items()}})
    out = out.withColumn("_block", F.floor(-log / BLOCK))
    lift = F.exp(-(log + block * BLOCK) - BLOCK / 2)
    # A block covers adjacent rows of a key: the running sums restart where it changes.
    in_block = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumns({f"_s_{n}": F.sum(F.col(f"_g_{n}") * lift).over(in_block) / lift for n in gains})
    closing = F.struct(F.lag("_log").over(by).alias("log"), *[F.lag(f"_s_{n}").over(by).alias(n) for n in gains])
    out = out.withColumn("_close", F.when(F.lag("_block").over(by) != block, closing))
    out = out.withColumn("_carry", F.last("_close", ignorenulls=True).over(so_far))
    aged = F.exp(log - F.col("_carry")["log"])
    solved = {n: F.col(f"_s_{n}") + F.coalesce(F.col("_carry")[n] * aged, F.lit(0.0)) for n in gains}
    helpers = [f"_{x}_{n}" for n in gains for x in ("g", "s")]
    return out.withColumns(solved).drop("_log", "_block", "_close", "_carry", *helpers)


def ewm_mean(df: DataFrame, spec: PanelSpec, value: Column, alpha: float, name: str, adjust: bool = False) -> DataFrame:
    """Exponentially weighted mean along each key, null until the first value.

    Null rows keep the mean and age the weight of what came before them.
    ``adjust`` divides by the sum of weights instead of starting at the first value.
    """
    order, keys = spec.date_col, spec.key_cols
    by = Window.partitionBy(*keys).orderBy(order)
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keep = 1.0 - alpha
    known = F.col("_v").isNotNull()
    base = df.withColumn("_v", value.cast("double")).withColumns({"_row": F.row_number().over(by), "_seen": F.count("_v").over(so_far)})
    if adjust:
        gains = {"_num": F.coalesce("_v", F.lit(0.0)), "_den": F.when(known, 1.0).otherwise(0.0)}
        solved = solve_recurrence(base, keys, order, F.col("_row") * math.log(keep), gains)
        # Null rows age both sums alike: they carry the last mean, also where the sums have decayed to zero.
        mean = F.last(F.when(known, F.col("_num") / F.col("_den")), ignorenulls=True).over(so_far)
        return solved.withColumn(name, mean).drop("_v", "_row", "_seen", "_num", "_den")
    # Rows since the previous value decide how much weight it has left.
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("_age", F.col("_row") - F.last(F.when(known, F.col("_row")), ignorenulls=True).over(before))
    old = F.pow(F.lit(keep), F.col("_age"))
    first = F.col("_age").isNull()
    base = base.withColumns(
        {
            "_ln": F.when(~known | first, 0.0).otherwise(F.col("_age") * math.log(keep) - F.ln(old + alpha)),
            "_gain": F.when(~known, 0.0).when(first, F.col("_v")).otherwise(F.col("_v") * alpha / (old + alpha)),
        }
    )
    solved = solve_recurrence(base, keys, order, F.sum("_ln").over(so_far), {"_mean": F.col("_gain")})
    return solved.withColumn(name, F.when(F.col("_seen") > 0, F.col("_mean"))).drop("_v", "_row", "_seen", "_age", "_ln", "_gain", "_mean")


def alpha_of_halflife(halflife: float) -> float:
    return 1.0 - math.exp(-math.log(2.0) / halflife)


def ewm_name(column: str, halflife: float) -> str:
    return f"{column}_ewm_hl{halflife:g}".replace(".", "_")


def ewm_means_by_blocks(df: DataFrame, spec: PanelSpec, value: Column, alphas: Mapping[str, float], block: int, adjust: bool = False) -> DataFrame:
    """:func:`ewm_mean` for every name of ``alphas``, with at most ``block`` rows of a key per group. Needs a completed grid.

    Two levels: inside a block the means start afresh; what a block does to the mean before it is a decay and a gain, so the
    blocks of a key are a recurrence of their own, one row per block, whose solution is handed back to the rows. Blocks without
    a value, values far apart and null keys give what :func:`ewm_mean` gives. ``value`` must not depend on other rows.
    """
    if block < 1:
        raise ValueError("a block holds at least one period")
    keys = [*spec.key_cols, "_part"]
    # Without this exchange a table already partitioned by its keys would keep each key in one task.
    rows = df.withColumns({"_v": value.cast("double"), "_at": spec.freq.index(spec.date_col).cast("bigint")})
    rows = rows.withColumn("_part", F.floor(F.col("_at") / block)).repartition(*keys)
    by = Window.partitionBy(*keys).orderBy("_at")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.when(F.col("_v").isNotNull(), F.col("_at"))
    rows = rows.withColumns({
        "_first": F.first(F.when(place.isNotNull(), F.struct(place.alias("at"), F.col("_v").alias("v"))), ignorenulls=True).over(so_far),
        "_before": F.max(place).over(by.rowsBetween(Window.unboundedPreceding, -1)),
    })
    build = _adjusted_blocks if adjust else _blocks
    return build(rows, spec, keys, place, alphas, block, so_far).drop("_v", "_at", "_part", "_first", "_before")


def _log_share(age: Column, alpha: float) -> Column:
    """Logarithm of the share that the mean before keeps when the next value is ``age`` rows later."""
    left = age * math.log(1.0 - alpha)
    return left - F.log(F.exp(left) + alpha)


def _over_blocks(ends: DataFrame, spec: PanelSpec) -> tuple[WindowSpec, WindowSpec]:
    by = Window.partitionBy(*spec.key_cols).orderBy("_part")
    return by, by.rowsBetween(Window.unboundedPreceding, -1)


def _blocks(rows: DataFrame, spec: PanelSpec, keys: Sequence[str], place: Column, alphas: Mapping[str, float], block: int, so_far: WindowSpec) -> DataFrame:
    later = place.isNotNull() & F.col("_before").isNotNull()
    age = F.col("_at") - F.col("_before")
    for name, alpha in alphas.items():
        kept = F.when(later, _log_share(age, alpha)).otherwise(0.0)
        gain = F.when(place.isNull(), 0.0).when(later, F.col("_v") * (1.0 - F.exp(kept))).otherwise(F.col("_v"))
        rows = rows.withColumns({f"_l_{name}": F.sum(kept).over(so_far), "_gain": gain})
        rows = solve_recurrence(rows, keys, "_at", F.col(f"_l_{name}"), {f"_m_{name}": F.col("_gain")}).drop("_gain")
    state = F.struct(*[F.col(f"_{x}_{name}").alias(f"{x}_{name}") for name in alphas for x in "lm"])
    ends = rows.groupBy(*keys).agg(F.max_by(F.struct("_first", state.alias("s")), "_at").alias("_end"), F.max(place).alias("_last"))
    by, earlier = _over_blocks(ends, spec)
    first = F.col("_end._first")
    ends = ends.withColumn("_b_before", F.max("_last").over(earlier))
    joins = first.isNotNull() & F.col("_b_before").isNotNull()
    for name, alpha in alphas.items():
        kept = F.when(joins, F.col(f"_end.s.l_{name}") + _log_share(first["at"] - F.col("_b_before"), alpha)).otherwise(0.0)
        fresh = F.col(f"_end.s.m_{name}")
        # The block's own mean counts its first value in full; the mean before takes that value's place in the share it keeps.
        gain = F.when(first.isNull(), 0.0).when(joins, fresh - F.exp(F.col("_kept")) * first["v"]).otherwise(fresh)
        total = F.sum("_kept").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ends = ends.withColumn("_kept", kept).withColumns({"_total": total, "_gain": gain})
        ends = solve_recurrence(ends, spec.key_cols, "_part", F.col("_total"), {"_run": F.col("_gain")})
        ends = ends.withColumn(f"_c_{name}", F.lag("_run").over(by)).drop("_run", "_kept", "_total", "_gain")
    out = join_on_keys(rows, ends.select(*keys, "_b_before", *[f"_c_{name}" for name in alphas]), keys)
    for name, alpha in alphas.items():
        carried, own = F.col(f"_c_{name}"), F.col(f"_m_{name}")
        share = F.exp(F.col(f"_l_{name}") + _log_share(F.col("_first")["at"] - F.col("_b_before"), alpha))
        joined = F.when(F.col("_b_before").isNull(), own).otherwise(own + share * (carried - F.col("_first")["v"]))
        out = out.withColumn(name, F.when(F.col("_first").isNotNull(), joined).when(F.col("_b_before").isNotNull(), carried))
    return out.drop("_b_before", *[f"_{x}_{name}" for name in alphas for x in "lmc"])


def _adjusted_blocks(rows: DataFrame, spec: PanelSpec, keys: Sequence[str], place: Column, alphas: Mapping[str, float], block: int, so_far: WindowSpec) -> DataFrame:
    def since(at: Column, alpha: float) -> Column:
        """Decay from the end of the block before up to a place of this one."""
        return F.exp((at - F.col("_part") * block + 1) * math.log(1.0 - alpha))

    gains = {"n": F.coalesce("_v", F.lit(0.0)), "d": F.when(place.isNotNull(), 1.0).otherwise(0.0)}
    for name, alpha in alphas.items():
        sums = {f"_{x}_{name}": g for x, g in gains.items()}
        rows = solve_recurrence(rows, keys, "_at", (F.col("_at") - F.col("_part") * block) * math.log(1.0 - alpha), sums)
    state = F.struct(F.col("_at").alias("at"), *[F.col(f"_{x}_{name}").alias(f"{x}_{name}") for name in alphas for x in "nd"])
    ends = rows.groupBy(*keys).agg(F.max(F.when(place.isNotNull(), state)).alias("_seen"), F.max(state).alias("_end"))
    by, earlier = _over_blocks(ends, spec)
    for name, alpha in alphas.items():
        sums = {f"_{x}": F.col(f"_end.{x}_{name}") for x in "nd"}
        ends = solve_recurrence(ends, spec.key_cols, "_part", F.col("_end.at") * math.log(1.0 - alpha), sums)
        ends = ends.withColumns({f"_pn_{name}": F.coalesce(F.lag("_n").over(by), F.lit(0.0)), f"_pd_{name}": F.coalesce(F.lag("_d").over(by), F.lit(0.0))})
        aged = since(F.col("_seen.at"), alpha)
        mean = (F.col(f"_seen.n_{name}") + aged * F.col(f"_pn_{name}")) / (F.col(f"_seen.d_{name}") + aged * F.col(f"_pd_{name}"))
        ends = ends.withColumn("_mean", mean).withColumn(f"_c_{name}", F.last("_mean", ignorenulls=True).over(earlier)).drop("_n", "_d", "_mean")
    out = join_on_keys(rows, ends.select(*keys, *[f"_{x}_{name}" for name in alphas for x in ("pn", "pd", "c")]), keys)
    for name, alpha in alphas.items():
        aged = since(F.col("_at"), alpha)
        mean = (F.col(f"_n_{name}") + aged * F.col(f"_pn_{name}")) / (F.col(f"_d_{name}") + aged * F.col(f"_pd_{name}"))
        held = F.last(F.when(place.isNotNull(), mean), ignorenulls=True).over(so_far)
        out = out.withColumn(name, F.coalesce(held, F.col(f"_c_{name}")))
    return out.drop(*[f"_{x}_{name}" for name in alphas for x in ("n", "d", "pn", "pd", "c")])


def add_ewm_features(
    df: DataFrame, spec: PanelSpec, column: str | None = None, halflives: Iterable[float] = (7.0, 28.0), min_lag: int = 1, block: int | None = None
) -> DataFrame:
    """Exponentially weighted means of the lagged column, one per half-life.

    A fractional half-life is written with ``_`` in the column name. ``block`` spreads a long series over several tasks
    (completed grids only).
    """
    name = column or spec.target_col
    if block:
        lagged = by_blocks(df, spec, max(min_lag, 1), max(block, min_lag), lambda rows, blocked: rows.withColumn("_lagged", F.lag(name, min_lag).over(blocked.in_order())))
        alphas = {ewm_name(name, h): alpha_of_halflife(h) for h in halflives}
        return ewm_means_by_blocks(lagged, spec, F.col("_lagged"), alphas, block).drop("_lagged")
    out = df.withColumn("_lagged", F.lag(name, min_lag).over(spec.in_order()))
    for h in halflives:
        out = ewm_mean(out, spec, F.col("_lagged"), alpha_of_halflife(h), ewm_name(name, h))
    return out.drop("_lagged")


def long_ema(df: DataFrame, spec: PanelSpec, column: str, alpha: float, name: str, lag: int = 0, null_as: float | None = None, block: int | None = None) -> DataFrame:
    """Weight-adjusted mean with a given ``alpha``, optionally of the lagged column; ``block`` as in :func:`add_ewm_features`."""
    if block:
        shift = by_blocks(df, spec, max(lag, 1), max(block, lag), lambda rows, blocked: rows.withColumn("_source", F.lag(column, lag).over(blocked.in_order())))
        out = ewm_means_by_blocks(shift, spec, F.col("_source"), {name: alpha}, block, adjust=True).drop("_source")
        return out if null_as is None else out.withColumn(name, F.coalesce(name, F.lit(null_as)))
    source = F.lag(column, lag).over(spec.in_order()) if lag else F.col(column)
    out = df.withColumn("_source", source)
    out = ewm_mean(out, spec, F.col("_source"), alpha, name, adjust=True).drop("_source")
    return out if null_as is None else out.withColumn(name, F.coalesce(name, F.lit(null_as)))


def final_smooth(value: Column, back: Column, first: Column, alpha: float) -> Column:
    """Aggregate: last state of simple smoothing.

    ``back`` counts later values (0 for the last), ``first`` marks the starting value.
    """
    weight = F.when(first, 1.0).otherwise(alpha) * F.pow(F.lit(1.0 - alpha), back)
    return F.sum(value * weight)
