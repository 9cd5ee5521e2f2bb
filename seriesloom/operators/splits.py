"""Chronological splits and walk-forward folds.

A split is one column of the panel; folds are a list of date ranges that fits
into the plan as a literal. Membership is tested per row without a join: a row
is emitted once for each fold part that contains its date.
"""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.statistics import percent
from seriesloom.operators.impute import join_on_keys
from seriesloom.spec import PanelSpec

Day = dt.date | dt.datetime


def _day(value: str | Day) -> Day:
    if isinstance(value, str):
        return dt.date.fromisoformat(value) if len(value) == 10 else dt.datetime.fromisoformat(value)
    return value


def date_span(df: DataFrame, spec: PanelSpec) -> tuple[Day, Day]:
    """First and last date of the panel: two values on the driver."""
    row = df.agg(F.min(spec.date_col), F.max(spec.date_col)).first()
    return row[0], row[1]


def _shifted(spec: PanelSpec, day: Day, periods: int) -> Day:
    return spec.freq.shift_day(day, periods)


@dataclass
class SplitResult:
    """A panel with its ``split`` column (train, val, test) and the cut-off dates."""

    frame: DataFrame
    spec: PanelSpec
    train_end: Day
    val_end: Day | None
    test_end: Day

    def part(self, name: str) -> DataFrame:
        return self.frame.filter(F.col("split") == name).drop("split")

    @property
    def train(self) -> DataFrame:
        return self.part("train")

    @property
    def val(self) -> DataFrame:
        return self.part("val")

    @property
    def test(self) -> DataFrame:
        return self.part("test")

    def summary(self) -> DataFrame:
        return summarize_split(self.frame, self.spec)


def label_split(df: DataFrame, spec: PanelSpec, train_end: Day, val_end: Day | None, test_end: Day) -> DataFrame:
    d = F.col(spec.date_col)
    label = F.when(d <= F.lit(train_end), "train")
    if val_end is not None:
        label = label.when(d <= F.lit(val_end), "val")
    return df.withColumn("split", label.when(d <= F.lit(test_end), "test")).filter(F.col("split").isNotNull())


def time_based_split(df: DataFrame, spec: PanelSpec, train_end: str | Day, val_end: str | Day | None, test_end: str | Day | None = None) -> SplitResult:
    """Train up to ``train_end``, validation up to ``val_end``, test up to ``test_end``."""
    train_end, val_end = _day(train_end), _day(val_end) if val_end is not None else None
    test_end = _day(test_end) if test_end is not None else date_span(df, spec)[1]
    ordered = train_end < test_end if val_end is None else train_end < val_end <= test_end
    if not ordered:
        raise ValueError(f"cut-offs out of order: {train_end}, {val_end}, {test_end}")
    return SplitResult(label_split(df, spec, train_end, val_end, test_end), spec, train_end, val_end, test_end)


def cutoff_split(df: DataFrame, spec: PanelSpec, cutoff: str | Day, holdout_end: str | Day | None = None) -> tuple[DataFrame, DataFrame]:
    """Train before ``cutoff``, test from it up to ``holdout_end``."""
    d = F.col(spec.date_col)
    test = df.filter(d >= F.lit(_day(cutoff)))
    if holdout_end is not None:
        test = test.filter(d <= F.lit(_day(holdout_end)))
    return df.filter(d < F.lit(_day(cutoff))), test


def holdout_horizon_split(df: DataFrame, spec: PanelSpec, test_horizon: int, val_horizon: int | None = None) -> SplitResult:
    """Last ``test_horizon`` periods for test and the ``val_horizon`` before for validation."""
    end = date_span(df, spec)[1]
    before_test = _shifted(spec, end, -test_horizon)
    if not val_horizon:
        return time_based_split(df, spec, before_test, None, end)
    return time_based_split(df, spec, _shifted(spec, before_test, -val_horizon), before_test, end)


def fractional_split(df: DataFrame, spec: PanelSpec, train: float = 0.7, val: float = 0.15) -> SplitResult:
    """Cut-offs at fractions of the date span."""
    start, end = date_span(df, spec)
    days = (end - start).days
    cut = lambda share: start + dt.timedelta(days=int(days * share))
    return time_based_split(df, spec, cut(train), cut(train + val), end)


def summarize_split(frame: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows, share and dates per part. The window runs over one row per part."""
    parts = frame.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.min(spec.date_col).alias("start"), F.max(spec.date_col).alias("end")
    )
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))
    return parts.select("split", "n_rows", percent(F.col("n_rows"), total).alias("pct"), "start", "end")


def leakage_report(frame: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row: whether every part ends before the next one starts."""
    order = ("train", "val", "test")
    edge = {p: (F.min(F.when(F.col("split") == p, F.col(spec.date_col))), F.max(F.when(F.col("split") == p, F.col(spec.date_col)))) for p in order}
    ok = F.lit(True)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            ok = ok & F.coalesce(edge[a][1] < edge[b][0], F.lit(True))
    return frame.agg(*[edge[p][j].alias(f"{p}_{n}") for p in order for j, n in enumerate(("start", "end"))], ok.alias("ok"))


def assert_no_leakage(split: SplitResult) -> None:
    row = leakage_report(split.frame, split.spec).first()
    if not row["ok"]:
        raise AssertionError(f"parts overlap in time: {row.asDict()}")


@dataclass(frozen=True)
class Fold:
    fold: int
    train_start: Day
    train_end: Day
    valid_start: Day
    valid_end: Day


@dataclass
class Folds:
    """Date ranges of walk-forward folds, all ends inclusive.

    ``asked`` is the number of folds wanted; fewer items fit before the last date.
    """

    items: list[Fold] = field(default_factory=list)
    asked: int | None = None

    def __iter__(self):
        return iter(self.items)

    def __len__(self) -> int:
        return len(self.items)

    def assign(self, df: DataFrame, spec: PanelSpec) -> DataFrame:
        """Rows with ``fold`` and ``part``, once per fold part that contains them."""
        d = F.col(spec.date_col)
        parts = [
            F.when(d.between(F.lit(lo), F.lit(hi)), F.struct(F.lit(f.fold).alias("fold"), F.lit(name).alias("part")))
            for f in self.items
            for name, lo, hi in (("train", f.train_start, f.train_end), ("valid", f.valid_start, f.valid_end))
        ]
        return df.select("*", F.inline(F.array_compact(F.array(*parts))))

    def pair(self, df: DataFrame, spec: PanelSpec, fold: int) -> tuple[DataFrame, DataFrame]:
        """Training and validation rows of one fold: two date filters on the scan."""
        f = next(x for x in self.items if x.fold == fold)
        d = F.col(spec.date_col)
        return df.filter(d.between(F.lit(f.train_start), F.lit(f.train_end))), df.filter(d.between(F.lit(f.valid_start), F.lit(f.valid_end)))


def describe_folds(df: DataFrame, spec: PanelSpec, folds: Folds) -> DataFrame:
    """Date ranges and row counts. Rows are counted per date before they meet the folds."""
    per_date = df.groupBy(spec.date_col).agg(F.count("*").alias("_n"))
    tagged = folds.assign(per_date, spec)
    counted = tagged.groupBy("fold").agg(
        *[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("_n"))), F.lit(0)).alias(f"n_{p}") for p in ("train", "valid")]
    )
    ranges = F.array(
        *[
            F.struct(*[F.lit(getattr(f, c)).alias(c) for c in ("fold", "train_start", "train_end", "valid_start", "valid_end")])
            for f in folds
        ]
    )
    listed = df.sparkSession.range(1).select(F.inline(ranges))
    return listed.join(counted, "fold", "left")


def _walk(start: Day, first_end: Day, end: Day, n_folds: int, next_fold) -> Folds:
    out = []
    for i in range(n_folds):
        f = next_fold(i)
        if f.valid_end > end:
            break
        out.append(f)
    if len(out) < n_folds:
        warnings.warn(f"{len(out)} of {n_folds} folds end before the last date", stacklevel=3)
    return Folds(out, n_folds)


def expanding_window_split(df: DataFrame, spec: PanelSpec, initial_train_end: str | Day, val_horizon: int, n_folds: int, step: int | None = None) -> Folds:
    """Training from the start to a moving end, then ``val_horizon`` periods."""
    start, end = date_span(df, spec)
    step, first = step or val_horizon, _day(initial_train_end)
    move = lambda n: _shifted(spec, first, n)
    return _walk(start, first, end, n_folds, lambda i: Fold(i, start, move(i * step), move(i * step + 1), move(i * step + val_horizon)))


def rolling_window_split(df: DataFrame, spec: PanelSpec, train_size: int, val_horizon: int, n_folds: int, step: int | None = None) -> Folds:
    """Training window of ``train_size`` periods that moves with the folds."""
    start, end = date_span(df, spec)
    step = step or val_horizon
    move = lambda n: _shifted(spec, start, n)
    return _walk(
        start, start, end, n_folds,
        lambda i: Fold(i, move(i * step), move(i * step + train_size - 1), move(i * step + train_size), move(i * step + train_size + val_horizon - 1)),
    )


def _as_day(value: Day) -> dt.date:
    return value.date() if isinstance(value, dt.datetime) else value


def expanding_day_folds(df: DataFrame, spec: PanelSpec, n_folds: int = 4, horizon_days: int = 28, gap_days: int = 0, initial_train_days: int | None = None) -> Folds:
    """Expanding folds in days, with a gap between training and validation."""
    start, end = map(_as_day, date_span(df, spec))
    total, needed = (end - start).days + 1, n_folds * horizon_days + gap_days
    if total <= needed:
        raise ValueError(f"{total} days of history, more than {needed} needed")
    first = total - needed if initial_train_days is None else initial_train_days
    day = lambda n: start + dt.timedelta(days=n)

    def fold(i: int) -> Fold:
        close = first + i * horizon_days
        return Fold(i, start, day(close - 1), day(close + gap_days), day(close + gap_days + horizon_days - 1))

    return _walk(start, start, end, n_folds, fold)


def sliding_day_folds(df: DataFrame, spec: PanelSpec, n_folds: int = 4, train_days: int = 365, horizon_days: int = 28, gap_days: int = 0) -> Folds:
    start, end = map(_as_day, date_span(df, spec))
    if (end - start).days + 1 < train_days + gap_days + n_folds * horizon_days:
        raise ValueError("not enough history for the sliding folds")
    day = lambda n: start + dt.timedelta(days=n)

    def fold(i: int) -> Fold:
        open_ = i * horizon_days
        close = open_ + train_days
        return Fold(i, day(open_), day(close - 1), day(close + gap_days), day(close + gap_days + horizon_days - 1))

    return _walk(start, start, end, n_folds, fold)


def train_test_split_ts(df: DataFrame, spec: PanelSpec, test_size: int | float = 0.2) -> DataFrame:
    """``split`` column: the last rows of each key, by share (rounded up) or count, are test."""
    back = F.row_number().over(spec.in_reverse())
    n = F.count("*").over(spec.per_key())
    size = F.ceil(n * test_size) if isinstance(test_size, float) else F.lit(test_size)
    return df.withColumn("split", F.when(back <= size, "test").otherwise("train"))


def repeated_fold(identity: Sequence[str], k: int, seed: int = 0) -> Column:
    """Fold number of a row from a seeded hash of its identity."""
    return F.pmod(F.xxhash64(*identity, F.lit(seed)), F.lit(k))


def time_fold(spec: PanelSpec, start: Day, end: Day, k: int) -> Column:
    """Fold number by equal stretches of time."""
    days = (end - start).days + 1
    return F.least(F.floor(F.datediff(spec.date_col, F.lit(start)) * k / days), F.lit(k - 1))


def walk_forward_validation(df: DataFrame, spec: PanelSpec, state: dict[str, Column], forecast: Column, n_test: int, step: int = 1, horizon: int = 1) -> DataFrame:
    """Rolling-origin validation of a forecaster given as running state.

    ``state`` are window expressions evaluated at every row (what is known at an
    origin); ``forecast`` turns them and ``horizon`` into a value. No history is
    copied per origin: each key is passed once. On dates that several origins
    reach, the latest origin counts.
    """
    known = df.withColumns(state)
    placed = known.withColumn("_i", F.row_number().over(spec.in_order())).withColumn("_n", F.count("*").over(spec.per_key()))
    first = F.col("_n") - n_test
    origins = placed.filter((F.col("_i") >= first) & (F.col("_i") + horizon <= F.col("_n")) & (F.pmod(F.col("_i") - first, F.lit(step)) == 0))
    ahead = origins.select(*spec.key_cols, F.col(spec.date_col).alias("_origin"), "_i", *state, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon"))
    made = ahead.select(*spec.key_cols, (F.col("_i") + F.col("horizon")).alias("_i"), F.col("_i").alias("_from"), "horizon", forecast.alias("_f"))
    latest = made.filter(F.col("_f").isNotNull()).groupBy(*spec.key_cols, "_i").agg(F.max_by("_f", "_from").alias("predicted"))
    actual = placed.select(*spec.key_cols, spec.date_col, "_i", F.col(spec.target_col).alias("actual"))
    return join_on_keys(actual, latest, [*spec.key_cols, "_i"], "inner").drop("_i")


