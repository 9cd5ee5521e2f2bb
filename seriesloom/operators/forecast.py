"""Baseline, intermittent-demand and smoothing forecasts.

Each returns ``(keys, date, horizon, model, yhat)``. A forecaster is one
aggregation per key followed by the expansion of the horizon.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.grid import explode_horizon
from seriesloom.operators.impute import join_on_keys
from seriesloom.operators.linear import let
from seriesloom.operators.recurrence import final_smooth
from seriesloom.spec import PanelSpec

Forecaster = Callable[[DataFrame, PanelSpec, int], DataFrame]


def _ahead(stats: DataFrame, spec: PanelSpec, horizon: int, value: Column, model: str) -> DataFrame:
    return explode_horizon(stats, spec, "_last", horizon).select(
        *spec.key_cols, spec.date_col, "horizon", F.lit(model).alias("model"), value.cast("double").alias("yhat")
    )


def _last(spec: PanelSpec) -> Column:
    return F.max(spec.date_col).alias("_last")


def naive_forecast(df: DataFrame, spec: PanelSpec, horizon: int) -> DataFrame:
    stats = df.groupBy(*spec.key_cols).agg(_last(spec), F.max_by(spec.target_col, spec.date_col).alias("_y"))
    return _ahead(stats, spec, horizon, F.col("_y"), "naive")


def mean_forecast(df: DataFrame, spec: PanelSpec, horizon: int) -> DataFrame:
    stats = df.groupBy(*spec.key_cols).agg(_last(spec), F.avg(spec.target_col).alias("_y"))
    return _ahead(stats, spec, horizon, F.col("_y"), "mean")


def drift_forecast(df: DataFrame, spec: PanelSpec, horizon: int) -> DataFrame:
    """Line through the first and last value; naive for a single value."""
    y, d = spec.target_col, spec.date_col
    stats = df.groupBy(*spec.key_cols).agg(
        _last(spec), F.max_by(y, d).alias("_end"), F.min_by(y, d).alias("_start"), F.count("*").alias("_n")
    )
    slope = F.coalesce(F.try_divide(F.col("_end") - F.col("_start"), F.col("_n") - 1), F.lit(0.0))
    return _ahead(stats, spec, horizon, F.col("_end") + slope * F.col("horizon"), "drift")


def seasonal_naive_forecast(df: DataFrame, spec: PanelSpec, horizon: int, season_length: int) -> DataFrame:
    """Last season repeated; null for a history shorter than one season.

    The last season of a key is an array of ``season_length`` values, built from
    the rows that the rank filter lets through the exchange.
    """
    back = F.row_number().over(spec.in_reverse())
    tail = df.withColumn("_b", back).filter(F.col("_b") <= season_length)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_b")).alias("o"), F.col(spec.target_col).alias("y"))))
    stats = tail.groupBy(*spec.key_cols).agg(_last(spec), ordered.alias("_season"))
    slot = F.pmod(F.col("horizon") - 1, F.lit(season_length)).cast("int")
    value = F.when(F.size("_season") == season_length, F.col("_season")[slot]["y"])
    return _ahead(stats, spec, horizon, value, "seasonal_naive")


def intermittent_rates(df: DataFrame, spec: PanelSpec, alpha: float = 0.1, beta: float = 0.1) -> DataFrame:
    """``(keys, _last, classic, sba, tsb)``: demand rates of three methods from one aggregation per key.

    ``classic`` is smoothed demand size over smoothed demand interval, ``sba`` the same with its bias taken out, ``tsb`` the
    size times a demand probability that decays in idle periods at rate ``beta``. All end in weighted sums over the demands, so
    no state is folded row by row. Without demand the rates are zero; with one demand classic and sba spread it over the history.
    """
    _check_rate(alpha)
    _check_rate(beta)
    y, by = F.col(spec.target_col), spec.in_order()
    sold = y > 0
    rows = df.withColumns({"_i": F.row_number().over(by), "_n": F.count("*").over(spec.per_key()), "_m": F.count(F.when(sold, 1)).over(spec.per_key())})
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_at": F.last(F.when(sold, F.col("_i")), ignorenulls=True).over(before), "_rank": F.count(F.when(sold, 1)).over(by)})
    first, back = F.col("_rank") == 1, F.col("_m") - F.col("_rank")
    gap = (F.col("_i") - F.coalesce("_at", F.lit(0))).cast("double")
    left = F.pow(F.lit(1.0 - beta), F.col("_n") - F.col("_i"))
    stats = rows.groupBy(*spec.key_cols).agg(
        _last(spec),
        final_smooth(F.when(sold, y), back, first, alpha).alias("_z"),
        final_smooth(F.when(sold, gap), back, first, alpha).alias("_p"),
        F.sum(F.when(sold, F.when(first, left / F.col("_i")).otherwise(beta * left))).alias("_chance"),
        F.max("_m").alias("_m"),
        F.max("_n").alias("_n"),
        F.max(F.when(sold, y)).alias("_y"),
    )
    once, rate = F.col("_m") == 1, F.col("_z") / F.col("_p")
    rates = {
        "classic": F.when(once, F.col("_y") / F.col("_n")).otherwise(rate),
        "sba": F.when(once, F.col("_y") / F.col("_n")).otherwise(rate * (1.0 - alpha / 2)),
        "tsb": F.col("_z") * F.col("_chance"),
    }
    return stats.select(*spec.key_cols, "_last", *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in rates.items()])


def croston(df: DataFrame, spec: PanelSpec, horizon: int, alpha: float = 0.1, variant: str = "classic") -> DataFrame:
    """Smoothed demand size over smoothed demand interval, see :func:`intermittent_rates`."""
    if variant not in ("classic", "sba"):
        raise ValueError("variant must be 'classic' or 'sba'")
    return _ahead(intermittent_rates(df, spec, alpha), spec, horizon, F.col(variant), f"croston_{variant}")


def croston_tsb(df: DataFrame, spec: PanelSpec, horizon: int, alpha: float = 0.1, beta: float = 0.1) -> DataFrame:
    """Smoothed demand size times a demand probability that decays in idle periods."""
    return _ahead(intermittent_rates(df, spec, alpha, beta), spec, horizon, F.col("tsb"), "tsb")


def _check_rate(x: float) -> None:
    if not 0 < x < 1:
        raise ValueError("smoothing rates must lie between 0 and 1")


def floor_zero(yhat: Column) -> Column:
    return F.greatest(yhat, F.lit(0.0))


# --- exponential smoothing -------------------------------------------------------------

def smoothing_grid(trend: bool, damped: bool, seasonal: bool, alphas: Sequence[float], betas: Sequence[float], gammas: Sequence[float], phis: Sequence[float]) -> list[tuple[float, float, float, float]]:
    """Parameter sets (alpha, beta, gamma, phi); unused ones are fixed."""
    return list(product(alphas, betas if trend else (0.0,), gammas if seasonal else (0.0,), phis if damped else (1.0,)))


@dataclass(frozen=True)
class Smoothing:
    """Additive smoothing: which parts a model has and the parameter sets it tries."""

    trend: bool = True
    damped: bool = False
    season_length: int = 1
    alphas: Sequence[float] = (0.1, 0.3, 0.5, 0.8)
    betas: Sequence[float] = (0.05, 0.2)
    gammas: Sequence[float] = (0.05, 0.2)
    phis: Sequence[float] = (0.9, 0.98)

    @property
    def seasonal(self) -> bool:
        return self.season_length > 1

    @property
    def sets(self) -> list[tuple[float, float, float, float]]:
        return smoothing_grid(self.trend, self.damped, self.seasonal, self.alphas, self.betas, self.gammas, self.phis)

    def enough(self) -> Column:
        """Whether ``_ys`` has the values that the start needs: two seasons, two for a trend, else one."""
        return F.size("_ys") >= (2 * self.season_length if self.seasonal else 2 if self.trend else 1)

    def series(self, df: DataFrame, spec: PanelSpec) -> DataFrame:
        """One row per key: its known values in order as ``_ys``, and ``_last``."""
        y, d = spec.target_col, spec.date_col
        known = F.when(F.col(y).isNotNull(), F.struct(d, F.col(y).cast("double").alias("y")))
        out = df.groupBy(*spec.key_cols).agg(
            F.transform(F.array_sort(F.collect_list(known)), lambda s: s["y"]).alias("_ys"),
            F.max(F.when(F.col(y).isNotNull(), F.col(d))).alias("_known_to"),
            _last(spec),
        )
        return out.withColumn("_last", F.coalesce("_known_to", "_last")).drop("_known_to")

    def _begin(self) -> tuple[Column, Column]:
        """State before the first error, and the values that follow the start."""
        ys, m = F.col("_ys"), self.season_length
        if self.seasonal:
            mean = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v) / m
            one, two = mean(F.slice(ys, 1, m)), mean(F.slice(ys, m + 1, m))
            level, slope = one, (two - one) / m if self.trend else F.lit(0.0)
            season = F.transform(F.slice(ys, 1, m), lambda v: v - one)
            rest = F.slice(ys, m + 1, F.greatest(F.size(ys) - m, F.lit(0)))
        else:
            level = F.get(ys, F.lit(0))
            slope = F.get(ys, F.lit(1)) - level if self.trend else F.lit(0.0)
            season = F.array(F.lit(0.0))
            rest = F.slice(ys, 2, F.greatest(F.size(ys) - 1, F.lit(0)))
        return F.struct(level.alias("l"), slope.alias("t"), season.alias("s"), F.lit(0.0).alias("sse")), rest

    def fold(self, par: Column) -> Column:
        """Final state ``(l, t, s, sse)`` of the values in ``_ys`` under parameters ``(a, b, g, p)``."""
        start, rest = self._begin()
        m = self.season_length

        def step(st: Column, v: Column) -> Column:
            drive = st["t"] * par["p"]
            wave = st["s"][0]
            err = v - (st["l"] + drive + wave)
            level = st["l"] + drive + par["a"] * err
            slope = drive + par["a"] * par["b"] * err
            # The season array rotates: its head is always the coming period.
            season = F.concat(F.slice(st["s"], 2, m - 1), F.array(wave + par["g"] * err)) if self.seasonal else st["s"]
            return F.struct(level.alias("l"), slope.alias("t"), season.alias("s"), (st["sse"] + err * err).alias("sse"))

        return F.aggregate(rest, start, step)

    def refined(self, rounds: int) -> Column:
        """Best parameters ``(sse, a, b, g, p)``, in thousandths, by a compass search inside the row.

        From the best set of the grid, each round tries one step up and down in every parameter and takes the best; where none
        is better the step is halved. Steps are 64 thousandths at first and one at last, so all sets lie on one lattice and a
        search that ends before ``rounds`` is at a minimum among neighbours. The error never rises above the grid's.
        """
        free = ["a", *(["b"] if self.trend else []), *(["g"] if self.seasonal else []), *(["p"] if self.damped else [])]

        def tried(par: Column) -> Column:
            real = {c: par[c] / F.lit(1000.0) for c in "abgp"}
            sse = self.fold(F.struct(*[v.alias(c) for c, v in real.items()]))["sse"]
            return F.struct(sse.alias("sse"), *[par[c].alias(c) for c in "abgp"])

        def beside(now: Column, name: str, by: Column) -> Column:
            moved = F.least(F.greatest(now[name] + by, F.lit(1)), F.lit(999))
            return F.struct(*[(moved if c == name else now[c]).alias(c) for c in "abgp"])

        grid = F.array(*[F.struct(*[F.lit(round(1000 * v)).cast("int").alias(c) for c, v in zip("abgp", s, strict=True)]) for s in self.sets])

        def move(st: Column, _: Column) -> Column:
            near = F.array(*[beside(st["now"], c, sign * st["h"]) for c in free for sign in (1, -1)])
            return let(F.array_min(F.transform(near, tried)), lambda best: F.when(
                best["sse"] < st["now"]["sse"], F.struct(best.alias("now"), st["h"].alias("h"))
            ).otherwise(F.struct(st["now"].alias("now"), F.floor(st["h"] / 2).cast("int").alias("h"))))

        def round_of(st: Column, i: Column) -> Column:
            return F.when(st["h"] > 0, move(st, i)).otherwise(st)

        first = F.struct(F.array_min(F.transform(grid, tried)).alias("now"), F.lit(64).alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, round_of, lambda st: st["now"])


def smoothing_parameters(df: DataFrame, spec: PanelSpec, smoothing: Smoothing | None = None, rounds: int = 100) -> DataFrame:
    """``(keys, n, alpha, beta, gamma, phi, sse)`` to three digits, see :meth:`Smoothing.refined`.

    A key is one row throughout: nothing is exchanged after its values are gathered. Null where a key has too few values.
    """
    model = smoothing or Smoothing()
    best = model.series(df, spec).withColumn("_p", F.when(model.enough(), model.refined(rounds)))
    real = [(F.col("_p")[c] / F.lit(1000.0)).alias(name) for c, name in (("a", "alpha"), ("b", "beta"), ("g", "gamma"), ("p", "phi"))]
    return best.select(*spec.key_cols, F.size("_ys").alias("n"), *real, F.col("_p")["sse"].alias("sse"))


def exponential_smoothing(
    df: DataFrame,
    spec: PanelSpec,
    horizon: int,
    trend: bool = True,
    damped: bool = False,
    season_length: int = 1,
    alphas: Sequence[float] = (0.1, 0.3, 0.5, 0.8),
    betas: Sequence[float] = (0.05, 0.2),
    gammas: Sequence[float] = (0.05, 0.2),
    phis: Sequence[float] = (0.9, 0.98),
    model: str | None = None,
    refine: int = 0,
) -> DataFrame:
    """Additive Holt / damped / Holt-Winters with parameters chosen per key by squared error.

    A series is one ordered array (one value per period), over which each parameter
    set folds a state of fixed size. ``refine`` rounds of search follow the grid. A key
    with fewer values than the start needs (two seasons, two for a trend, else one) has
    null forecasts.
    """
    kind = Smoothing(trend, damped, season_length, alphas, betas, gammas, phis)
    series, enough = kind.series(df, spec), kind.enough()
    if refine:
        found = series.withColumn("_p", F.when(enough, kind.refined(refine)))
        chosen = found.withColumn("_set", F.struct(*[(F.col("_p")[c] / F.lit(1000.0)).alias(c) for c in "abgp"]))
        best = chosen.select(*spec.key_cols, "_last", F.struct("_set", F.when(enough, kind.fold(F.col("_set"))).alias("_st")).alias("_best"))
    else:
        literal = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("abgp", s, strict=True)]) for s in kind.sets])
        # The sets of a key run in its own task: a row per set, over one bounded array.
        trials = series.withColumn("_set", F.explode(F.when(enough, literal).otherwise(F.slice(literal, 1, 1))))
        folded = trials.select(*spec.key_cols, "_last", "_set", F.when(enough, kind.fold(F.col("_set"))).alias("_st"))
        best = folded.groupBy(*spec.key_cols).agg(F.max("_last").alias("_last"), F.min_by(F.struct("_set", "_st"), F.struct(F.col("_st")["sse"], F.col("_set"))).alias("_best"))
    st, phi = F.col("_best")["_st"], F.col("_best")["_set"]["p"]
    h = F.col("horizon")
    pull = F.when(phi == 1.0, h.cast("double")).otherwise(phi * (1 - F.pow(phi, h)) / (1 - phi))
    wave = st["s"][F.pmod(h - 1, F.lit(season_length)).cast("int")] if kind.seasonal else F.lit(0.0)
    name = model or ("holt_winters" if kind.seasonal else "holt_damped" if damped else "holt" if trend else "ses")
    return _ahead(best, spec, horizon, st["l"] + pull * st["t"] + wave, name)


SIMPLE = ("naive", "mean", "drift", "seasonal_naive")


def forecasters(season_length: int) -> dict[str, Forecaster]:
    """The univariate forecasters by model name."""
    return {
        "naive": naive_forecast,
        "seasonal_naive": lambda df, s, h: seasonal_naive_forecast(df, s, h, season_length),
        "mean": mean_forecast,
        "drift": drift_forecast,
        "croston_classic": croston,
        "croston_sba": lambda df, s, h: croston(df, s, h, variant="sba"),
        "tsb": croston_tsb,
        "holt": exponential_smoothing,
        "holt_damped": lambda df, s, h: exponential_smoothing(df, s, h, damped=True),
        "holt_winters": lambda df, s, h: exponential_smoothing(df, s, h, season_length=season_length),
    }


def baseline_forecasts(df: DataFrame, spec: PanelSpec, horizon: int, season_length: int, models: Sequence[str]) -> DataFrame:
    """The requested :data:`SIMPLE` models from one aggregation per key."""
    y, d = spec.target_col, spec.date_col
    seasonal = "seasonal_naive" in models
    aggs = [_last(spec), F.max_by(y, d).alias("_end"), F.min_by(y, d).alias("_start"), F.count("*").alias("_n"), F.avg(y).alias("_mean")]
    rows = df
    if seasonal:
        rows = df.withColumn("_b", F.row_number().over(spec.in_reverse()))
        tail = F.when(F.col("_b") <= season_length, F.struct((-F.col("_b")).alias("o"), F.col(y).alias("y")))
        aggs.append(F.array_sort(F.collect_list(tail)).alias("_season"))
    stats = rows.groupBy(*spec.key_cols).agg(*aggs)
    h = F.col("horizon")
    slope = F.coalesce(F.try_divide(F.col("_end") - F.col("_start"), F.col("_n") - 1), F.lit(0.0))
    value = {"naive": F.col("_end"), "mean": F.col("_mean"), "drift": F.col("_end") + slope * h}
    if seasonal:
        slot = F.pmod(h - 1, F.lit(season_length)).cast("int")
        value["seasonal_naive"] = F.when(F.size("_season") == season_length, F.col("_season")[slot]["y"])
    made = F.array(*[F.struct(F.lit(m).alias("model"), value[m].cast("double").alias("yhat")) for m in models])
    return explode_horizon(stats, spec, "_last", horizon).select(*spec.key_cols, d, "horizon", F.inline(made))


def forecast_all(df: DataFrame, spec: PanelSpec, horizon: int, season_length: int, models: Sequence[str]) -> DataFrame:
    """Several forecasters in one long table; the simple ones share a single pass."""
    table = forecasters(season_length)
    simple = [m for m in models if m in SIMPLE]
    parts = [baseline_forecasts(df, spec, horizon, season_length, simple)] if simple else []
    parts += [table[m](df, spec, horizon) for m in models if m not in SIMPLE]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def best_model_per_key(scored: DataFrame, spec: PanelSpec, metric: str = "MAE") -> DataFrame:
    """``(keys, model)`` with the smallest metric; ties by model name. Null where no model of the key has a score.

    Metrics that agree in ten digits tie: equal sums added up in another order differ in the last digits of a double.
    """
    digits = F.format_string("%.9e", F.col(metric).cast("double") * (1 + 2e-12)).cast("double")
    order = F.when(F.col(metric).isNotNull(), F.struct(digits.alias("score"), "model"))
    return scored.groupBy(*spec.key_cols).agg(F.min_by("model", order).alias("model"))


def refit_best(df: DataFrame, best: DataFrame, spec: PanelSpec, horizon: int, season_length: int, models: Sequence[str]) -> DataFrame:
    """Each key is forecast from all its data by its own best model."""
    routed = join_on_keys(df, best.select(*spec.key_cols, F.col("model").alias("_use")), spec.key_cols, "inner")
    simple = [m for m in models if m in SIMPLE]
    chosen = join_on_keys(
        baseline_forecasts(routed.filter(F.col("_use").isin(simple)), spec, horizon, season_length, simple),
        best.select(*spec.key_cols, "model"), [*spec.key_cols, "model"], "left_semi",
    ) if simple else None
    for m, make in forecasters(season_length).items():
        if m in models and m not in SIMPLE:
            part = make(routed.filter(F.col("_use") == m).drop("_use"), spec, horizon)
            chosen = part if chosen is None else chosen.unionByName(part)
    return chosen
