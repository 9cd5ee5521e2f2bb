"""Rolling-origin validation of any forecaster that can be stated as a state, an update and a forecast.

A key is one ordered array of its values, over which the state is folded once. At every origin the state so far is kept, and
the forecasts follow from it: no history is copied per origin, and each key is passed once however many origins it has.
The array is bounded by the calendar of the panel. Forecasters are Spark columns, so nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.spec import PanelSpec


@dataclass(frozen=True)
class StateForecaster:
    """A forecaster as a fold.

    ``start`` is the state before the first value, of the type ``schema``; ``update(state, value)`` the state after a value
    (null values included: it decides what they mean); ``forecast(state, h)`` the value ``h`` periods ahead, null where the
    history does not suffice. An origin whose forecast is null is skipped.
    """

    name: str
    schema: str
    start: Column
    update: Callable[[Column, Column], Column]
    forecast: Callable[[Column, Column], Column]


def _state(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _none() -> Column:
    return F.lit(None).cast("double")


def naive() -> StateForecaster:
    """The last known value."""
    return StateForecaster("naive", "struct<y:double>", _state(y=_none()), lambda s, v: _state(y=F.coalesce(v, s["y"])), lambda s, h: s["y"])


def mean() -> StateForecaster:
    """The mean of all known values."""
    return StateForecaster(
        "mean", "struct<sum:double,n:double>", _state(sum=F.lit(0.0), n=F.lit(0.0)),
        lambda s, v: _state(sum=s["sum"] + F.coalesce(v, F.lit(0.0)), n=s["n"] + F.when(v.isNull(), 0.0).otherwise(1.0)),
        lambda s, h: F.try_divide(s["sum"], s["n"]),
    )


def drift() -> StateForecaster:
    """The line through the first and the last known value; a single value is repeated."""
    def update(s: Column, v: Column) -> Column:
        # Positions count all rows, so that gaps lengthen the way between the two values.
        i = s["i"] + 1.0
        return _state(i=i, first=F.coalesce(s["first"], v), at=F.when(s["first"].isNull() & v.isNotNull(), i).otherwise(s["at"]), last=F.coalesce(v, s["last"]), seen=F.when(v.isNotNull(), i).otherwise(s["seen"]))

    def forecast(s: Column, h: Column) -> Column:
        slope = F.coalesce(F.try_divide(s["last"] - s["first"], s["seen"] - s["at"]), F.lit(0.0))
        return s["last"] + slope * (s["i"] - s["seen"] + h)

    return StateForecaster("drift", "struct<i:double,first:double,at:double,last:double,seen:double>", _state(i=F.lit(0.0), first=_none(), at=_none(), last=_none(), seen=_none()), update, forecast)


def seasonal_naive(season: int) -> StateForecaster:
    """The value one season before, or as many seasons as the horizon needs; null before a whole season is known."""
    return StateForecaster(
        "seasonal_naive", "struct<tail:array<double>>", _state(tail=F.array().cast("array<double>")),
        # The season array holds the last values in order; its head leaves when a new one comes.
        lambda s, v: _state(tail=F.when(F.size(s["tail"]) < season, F.concat(s["tail"], F.array(v))).otherwise(F.concat(F.slice(s["tail"], 2, season - 1), F.array(v)))),
        lambda s, h: F.when(F.size(s["tail"]) == season, F.get(s["tail"], F.pmod(h - 1, F.lit(season)).cast("int"))),
    )


def smoothing(alpha: float, beta: float | None = None, phi: float = 1.0) -> StateForecaster:
    """Exponential smoothing of the level and, with ``beta``, of a trend that ``phi`` damps.

    The level starts at the first value, the trend at the first difference. Null values leave the state as it is.
    """
    trended = beta is not None

    def update(s: Column, v: Column) -> Column:
        # The second value sets the trend, and is then smoothed like those after it.
        slope = F.when((s["n"] == 1) & F.lit(trended), v - s["l"]).otherwise(s["t"])
        drive = slope * phi
        error = v - s["l"] - drive
        later = _state(n=s["n"] + 1.0, l=s["l"] + drive + alpha * error, t=drive + alpha * (beta or 0.0) * error)
        return F.when(v.isNull(), s).when(s["n"] == 0, _state(n=F.lit(1.0), l=v, t=F.lit(0.0))).otherwise(later)

    def forecast(s: Column, h: Column) -> Column:
        pull = h.cast("double") if phi == 1.0 else phi * (1 - F.pow(F.lit(phi), h)) / (1 - phi)
        return F.when(s["n"] >= (2 if trended else 1), s["l"] + pull * s["t"])

    name = "ses" if not trended else "holt" if phi == 1.0 else "holt_damped"
    return StateForecaster(name, "struct<n:double,l:double,t:double>", _state(n=F.lit(0.0), l=_none(), t=F.lit(0.0)), update, forecast)


def croston(alpha: float = 0.1, variant: str = "classic") -> StateForecaster:
    """Smoothed demand size over smoothed interval; zero without demand, the only demand spread over the history."""
    if variant not in ("classic", "sba"):
        raise ValueError("variant must be 'classic' or 'sba'")
    correction = 1.0 - alpha / 2 if variant == "sba" else 1.0

    def update(s: Column, v: Column) -> Column:
        gap, sold = s["gap"] + 1.0, v > 0
        size = F.when(s["m"] == 0, v).otherwise(s["z"] + alpha * (v - s["z"]))
        wait = F.when(s["m"] == 0, gap).otherwise(s["p"] + alpha * (gap - s["p"]))
        hit = _state(n=s["n"] + 1.0, m=s["m"] + 1.0, z=size, p=wait, gap=F.lit(0.0), y=v)
        return F.when(sold, hit).otherwise(_state(n=s["n"] + 1.0, m=s["m"], z=s["z"], p=s["p"], gap=gap, y=s["y"]))

    def forecast(s: Column, h: Column) -> Column:
        return F.when(s["n"] > 0, F.when(s["m"] == 0, 0.0).when(s["m"] == 1, s["y"] / s["n"]).otherwise(s["z"] / s["p"] * correction))

    zero = F.lit(0.0)
    return StateForecaster(f"croston_{variant}", "struct<n:double,m:double,z:double,p:double,gap:double,y:double>", _state(n=zero, m=zero, z=_none(), p=_none(), gap=zero, y=_none()), update, forecast)


def tsb(alpha: float = 0.1, beta: float = 0.1) -> StateForecaster:
    """Smoothed demand size times a demand probability that every period updates; zero before the first demand."""
    def update(s: Column, v: Column) -> Column:
        n, first = s["n"] + 1.0, s["z"].isNull()
        hit = _state(n=n, z=F.when(first, v).otherwise(s["z"] + alpha * (v - s["z"])), c=F.when(first, F.lit(1.0) / n).otherwise(s["c"] + beta * (1.0 - s["c"])))
        return F.when(v > 0, hit).otherwise(_state(n=n, z=s["z"], c=s["c"] * (1.0 - beta)))

    return StateForecaster("tsb", "struct<n:double,z:double,c:double>", _state(n=F.lit(0.0), z=_none(), c=F.lit(0.0)), update, lambda s, h: F.when(s["n"] > 0, F.coalesce(s["z"] * s["c"], F.lit(0.0))))


def walk_forward(df: DataFrame, spec: PanelSpec, forecaster: StateForecaster, n_test: int, step: int = 1, horizon: int = 1) -> DataFrame:
    """(keys, date, actual, predicted, origin, horizon): forecasts of the last ``n_test`` rows of each key from rolling origins.

    Origins lie ``step`` rows apart from ``n_test`` rows before the end on, as long as ``horizon`` rows follow. On a date
    that several origins reach, the latest one whose forecast is not null counts; ``origin`` is its last known date and
    ``horizon`` its distance in rows. A key with no more than ``n_test`` rows has no origin and no row.
    """
    if n_test < 1 or step < 1 or horizon < 1:
        raise ValueError("n_test, step and horizon must be at least 1")
    rows = F.struct(F.col(spec.date_col).alias("d"), F.col(spec.target_col).cast("double").alias("y"))
    series = df.groupBy(*spec.key_cols).agg(F.array_sort(F.collect_list(rows)).alias("_s")).where(F.size("_s") > n_test)
    n = F.size("_s")
    first = n - n_test
    none = F.array().cast(f"array<struct<i:int,st:{forecaster.schema}>>")
    start = F.struct(F.lit(0).alias("i"), forecaster.start.cast(forecaster.schema).alias("st"), none.alias("out"))

    def fold(acc: Column, row: Column) -> Column:
        # Before the row is taken in: acc.st is what an origin of acc.i rows knows.
        i = acc["i"]
        origin = (i >= first) & (i + horizon <= n) & (F.pmod(i - first, F.lit(step)) == 0)
        kept = F.when(origin, F.concat(acc["out"], F.array(F.struct(i.alias("i"), acc["st"].alias("st"))))).otherwise(acc["out"])
        return F.struct((i + 1).alias("i"), forecaster.update(acc["st"], row["y"]).cast(forecaster.schema).alias("st"), kept.alias("out"))

    origins = series.select(*spec.key_cols, "_s", F.explode(F.aggregate("_s", start, fold)["out"]).alias("_o"))
    ahead = origins.select(*spec.key_cols, "_s", "_o", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h"))
    at = F.col("_o")["i"] + F.col("_h")
    made = ahead.select(
        *spec.key_cols, F.get("_s", at - 1)["d"].alias(spec.date_col), F.get("_s", at - 1)["y"].alias("actual"),
        forecaster.forecast(F.col("_o")["st"], F.col("_h")).cast("double").alias("_f"), F.col("_o")["i"].alias("_i"), F.get("_s", F.col("_o")["i"] - 1)["d"].alias("origin"), F.col("_h").alias("horizon"),
    ).where(F.col("_f").isNotNull())
    # Rows of a key are together already, so this needs no exchange.
    last = F.max_by(F.struct("actual", F.col("_f").alias("predicted"), "origin", "horizon"), "_i").alias("_last")
    return made.groupBy(*spec.key_cols, spec.date_col).agg(last).select(*spec.key_cols, spec.date_col, "_last.*")
