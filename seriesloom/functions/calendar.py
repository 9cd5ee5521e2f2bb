"""Date features as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.spec import PanelSpec


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def _builders(d: Column) -> dict[str, Column]:
    first, last = F.day(d) == 1, d.cast("date") == F.last_day(d)
    month = F.month(d)
    return {
        "year": F.year(d),
        "quarter": F.quarter(d),
        "month": month,
        "week": F.weekofyear(d),
        "day": F.day(d),
        "dayofweek": F.weekday(d),
        "dayofyear": F.dayofyear(d),
        "is_weekend": _flag(F.weekday(d) >= 5),
        "is_month_start": _flag(first),
        "is_month_end": _flag(last),
        "is_quarter_start": _flag(first & (month % 3 == 1)),
        "is_quarter_end": _flag(last & (month % 3 == 0)),
        "is_year_start": _flag(first & (month == 1)),
        "is_year_end": _flag(last & (month == 12)),
    }


DATE_FEATURES = (
    "year", "quarter", "month", "week", "day", "dayofweek", "dayofyear", "is_weekend", "is_month_start",
    "is_month_end", "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end",
)


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle."""
    angle = value * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def add_date_features(
    df: DataFrame, spec: PanelSpec, features: Sequence[str] | None = None, cyclical: bool = True
) -> DataFrame:
    built = _builders(F.col(spec.date_col))
    wanted = {f: built[f] for f in (features or DATE_FEATURES) if f in built}
    out = df.withColumns(wanted)
    if not cyclical:
        return out
    waves = {}
    # Cycle lengths of this feature set.
    for name, period in (("month", 12), ("dayofweek", 7), ("dayofyear", 365)):
        if name in out.columns:
            waves[f"{name}_sin"], waves[f"{name}_cos"] = cycle(F.col(name), period)
    return out.withColumns(waves)


def add_calendar_features(df: DataFrame, date_col: str, cyclical: bool = True) -> DataFrame:
    """Feature set of the forecasting builder: other names and a 365.25-day year."""
    b = _builders(F.col(date_col))
    plain = ("year", "quarter", "month", "week", "day", "is_weekend", "is_month_start", "is_month_end", "is_quarter_end")
    cols = {n: b[n] for n in plain} | {"day_of_week": b["dayofweek"], "day_of_year": b["dayofyear"]}
    if cyclical:
        # Cycle lengths of this feature set.
        for name, source, period in (("dow", "dayofweek", 7), ("month", "month", 12), ("doy", "dayofyear", 365.25)):
            cols[f"{name}_sin"], cols[f"{name}_cos"] = cycle(b[source], period)
    return df.withColumns(cols)


def days_since(date: Column | str, anchor: str) -> Column:
    return F.datediff(date, F.lit(anchor).cast("date"))


def day_name(date: Column | str) -> Column:
    return F.date_format(date, "EEEE")


def month_abbreviation(date: Column | str) -> Column:
    return F.date_format(date, "MMM")


def infer_season_length(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Season length of each key from its most frequent date step.

    Month-like steps vary by a few days, hence the ranges.
    """
    step = F.datediff(spec.date_col, F.lag(spec.date_col).over(spec.in_order()))
    steps = df.withColumn("_s", step).filter(F.col("_s") > 0).groupBy(*spec.key_cols, "_s").agg(F.count("*").alias("_n"))
    usual = steps.groupBy(*spec.key_cols).agg(F.min_by("_s", F.struct(-F.col("_n"), F.col("_s"))).alias("step_days"))
    s = F.col("step_days")
    return usual.withColumn(
        "season_length",
        F.when(s == 1, 7).when(s == 7, 52).when(s.between(28, 31), 12).when(s.between(89, 92), 4).otherwise(1),
    )
