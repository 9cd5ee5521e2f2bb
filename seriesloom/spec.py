"""Column roles of a panel and the calendar arithmetic of its frequency.

A panel is a DataFrame with one row per (key columns, date). Operators that
need an order use windows partitioned by the key columns, so the work in one
task is bounded by the number of calendar periods a series can have, not by
the number of raw records behind it. Raw records are reduced to that grain by
``operators.grid.to_panel`` before any ordered work.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _names(cols: str | Iterable[str] | None) -> tuple[str, ...]:
    if cols is None:
        return ()
    return (cols,) if isinstance(cols, str) else tuple(cols)


@dataclass(frozen=True)
class PanelSpec:
    """Roles: date, target, keys, static (constant per key) and dynamic columns."""

    date_col: str
    target_col: str
    key_cols: tuple[str, ...]
    static_cols: tuple[str, ...] = ()
    dynamic_cols: tuple[str, ...] = ()
    frequency: str = "D"

    @property
    def freq(self) -> Frequency:
        return Frequency(self.frequency)

    @property
    def roles(self) -> list[str]:
        return [self.date_col, self.target_col, *self.key_cols, *self.static_cols, *self.dynamic_cols]

    def per_key(self) -> WindowSpec:
        return Window.partitionBy(*self.key_cols)

    def in_order(self) -> WindowSpec:
        return Window.partitionBy(*self.key_cols).orderBy(self.date_col)

    def in_reverse(self) -> WindowSpec:
        return Window.partitionBy(*self.key_cols).orderBy(F.col(self.date_col).desc())

    def with_target(self, name: str) -> PanelSpec:
        return replace(self, target_col=name)

    def check(self, df: DataFrame) -> DataFrame:
        """Raise at plan time when a declared column is absent; returns ``df``."""
        absent = [c for c in self.roles if c not in df.columns]
        if absent:
            raise ValueError(f"columns declared in the spec but absent from the data: {absent}")
        return df


def make_spec(
    date_col: str,
    target_col: str,
    key_cols: str | Sequence[str],
    static_cols: Sequence[str] | None = None,
    dynamic_cols: Sequence[str] | None = None,
    frequency: str = "D",
) -> PanelSpec:
    Frequency(frequency)
    return PanelSpec(
        date_col, target_col, _names(key_cols), _names(static_cols), _names(dynamic_cols), frequency
    )


# Months per step of the calendar-month frequencies.
MONTH_STEPS = {"MS": 1, "M": 1, "ME": 1, "QS": 3, "Q": 3, "QE": 3, "YS": 12, "AS": 12, "Y": 12, "YE": 12, "A": 12}
# Weekday anchors, Monday = 0.
WEEKDAYS = {"MON": 0, "TUE": 1, "WED": 2, "THU": 3, "FRI": 4, "SAT": 5, "SUN": 6}
# Usual season length by leading letter of the frequency.
SEASON_LENGTHS = {"M": 12, "Q": 4, "W": 52, "D": 7, "B": 5, "H": 24, "A": 1, "Y": 1}


@dataclass(frozen=True)
class Frequency:
    """Maps dates to consecutive period numbers and back.

    With an integer period number, gap counts, grid generation, forecast dates
    and offsets are plain arithmetic: no calendar table is joined anywhere.
    """

    alias: str

    def __post_init__(self) -> None:
        base, _, anchor = self.name.partition("-")
        if base not in MONTH_STEPS and base not in {"D", "H", "B", "W"}:
            raise ValueError(f"unsupported frequency: {self.alias}")
        if base == "W" and anchor and anchor not in WEEKDAYS:
            raise ValueError(f"unknown weekday anchor: {self.alias}")

    @property
    def name(self) -> str:
        return self.alias.upper()

    @property
    def base(self) -> str:
        return self.name.partition("-")[0]

    @property
    def hourly(self) -> bool:
        return self.base == "H"

    @property
    def _first_weekday(self) -> int:
        return WEEKDAYS[self.name.partition("-")[2] or "MON"]

    @property
    def season_length(self) -> int:
        return SEASON_LENGTHS[self.name[0]]

    def index(self, date: Column | str) -> Column:
        """Consecutive period number of ``date`` (bigint)."""
        d = F.col(date) if isinstance(date, str) else date
        if self.hourly:
            # Clock time as it stands: a session zone with clock changes must not move it.
            return F.unix_date(d.cast("date")).cast("bigint") * 24 + F.hour(d)
        days = F.unix_date(d.cast("date")).cast("bigint")
        if self.base == "D":
            return days
        if self.base == "W":
            # 1970-01-01 was a Thursday, so Monday-based weeks start at day -3.
            return F.floor((days + 3 - self._first_weekday) / 7).cast("bigint")
        if self.base == "B":
            week = F.floor((days + 3) / 7).cast("bigint")
            return week * 5 + F.weekday(d.cast("date")).cast("bigint")
        months = (F.year(d) * 12 + F.month(d) - 1).cast("bigint")
        return F.floor(months / MONTH_STEPS[self.base]).cast("bigint")

    def date(self, index: Column | str) -> Column:
        """Date of a period number; inverse of :meth:`index`."""
        i = F.col(index) if isinstance(index, str) else index
        if self.hourly:
            return F.date_from_unix_date(F.floor(i / 24).cast("int")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.pmod(i, F.lit(24)).cast("int"))
        if self.base == "D":
            return F.date_from_unix_date(i.cast("int"))
        if self.base == "W":
            return F.date_from_unix_date((i * 7 - 3 + self._first_weekday).cast("int"))
        if self.base == "B":
            week = F.floor(i / 5)
            return F.date_from_unix_date((week * 7 - 3 + (i - week * 5)).cast("int"))
        step = MONTH_STEPS[self.base]
        months = i * step
        year = F.floor(months / 12).cast("int")
        start = F.make_date(year, (months - F.floor(months / 12) * 12 + 1).cast("int"), F.lit(1))
        if self.base.endswith("S"):
            return start
        return F.last_day(F.add_months(start, step - 1))

    def shift(self, date: Column | str, periods: Column | int) -> Column:
        return self.date(self.index(date) + periods)

    def shift_day(self, day: dt.date, periods: int) -> dt.date:
        """:meth:`shift` of one date on the driver, without a Spark job."""
        if self.hourly:
            start = day if isinstance(day, dt.datetime) else dt.datetime.combine(day, dt.time())
            return start.replace(minute=0, second=0, microsecond=0) + dt.timedelta(hours=periods)
        date = day.date() if isinstance(day, dt.datetime) else day
        if self.base == "D":
            return date + dt.timedelta(days=periods)
        if self.base == "W":
            back = (date.weekday() - self._first_weekday) % 7
            return date + dt.timedelta(days=7 * periods - back)
        if self.base == "B":
            at = (date - dt.timedelta(days=date.weekday())).toordinal() // 7 * 5 + date.weekday() + periods
            return dt.date.fromordinal(at // 5 * 7 + 1 + at % 5)
        step = MONTH_STEPS[self.base]
        months = ((date.year * 12 + date.month - 1) // step + periods) * step
        if self.base.endswith("S"):
            return dt.date(months // 12, months % 12 + 1, 1)
        after = months + step
        return dt.date(after // 12, after % 12 + 1, 1) - dt.timedelta(days=1)

    def aligned(self, date: Column | str) -> Column:
        d = F.col(date) if isinstance(date, str) else date
        target = "timestamp_ntz" if self.hourly else "date"
        return self.date(self.index(d)) == d.cast(target)

    def strict_index(self, date: Column | str) -> Column:
        """:meth:`index`, failing the job on a date that is off the grid."""
        d = F.col(date) if isinstance(date, str) else date
        return F.when(d.isNull() | self.aligned(d), self.index(d)).otherwise(
            F.raise_error(F.concat(F.lit(f"date off the {self.alias} grid: "), d.cast("string"))).cast("bigint")
        )
