"""One feature builder for training, validation and prediction."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import add_calendar_features
from seriesloom.operators.encode import apply_label_encoding, fit_labels, label_encode
from seriesloom.operators.linear import let
from seriesloom.operators.recurrence import add_ewm_features, ewm_name
from seriesloom.operators.windows import by_blocks, rolling_columns
from seriesloom.session import reliable_checkpoint
from seriesloom.spec import PanelSpec

CALENDAR = ("year", "quarter", "month", "week", "day", "day_of_week", "day_of_year", "is_weekend", "is_month_start", "is_month_end", "is_quarter_end")
WAVES = ("dow_sin", "dow_cos", "month_sin", "month_cos", "doy_sin", "doy_cos")


@dataclass(frozen=True)
class FeatureBuilder:
    """Calendar, lag, rolling and exponentially weighted features of one panel.

    The feature list follows from the settings alone, so it is the same for
    every table. All ordered features use one partitioning by the keys.
    ``rolling_min_lag=0`` lets features see the row's own value (direct models).
    ``block`` spreads a very long series over several tasks: all ordered features
    are then built per key and block of that many periods, weighted means in two
    levels (the panel must be a completed grid).
    """

    spec: PanelSpec
    lags: Sequence[int] = (1, 7, 14, 28)
    rolling_windows: Sequence[int] = (7, 14, 28)
    rolling_stats: Sequence[str] = ("mean", "std")
    ewm_halflives: Sequence[float] = (7.0, 28.0)
    rolling_min_lag: int = 1
    cyclical_calendar: bool = True
    encode_keys: bool = False
    exogenous: Sequence[str] = ()
    block: int | None = None
    #: Codes of key values, see :meth:`fitted`.
    codes: Mapping[str, DataFrame] | None = field(default=None, compare=False, repr=False)

    @property
    def calendar_names(self) -> list[str]:
        return [*CALENDAR, *(WAVES if self.cyclical_calendar else ())]

    @property
    def history_names(self) -> list[str]:
        y = self.spec.target_col
        return [
            *[f"{y}_lag_{k}" for k in self.lags],
            *[f"{y}_roll_{s}_{w}" for w in self.rolling_windows for s in self.rolling_stats],
            *[ewm_name(y, h) for h in self.ewm_halflives],
        ]

    @property
    def feature_names(self) -> list[str]:
        codes = [f"{k}_code" for k in self.spec.key_cols] if self.encode_keys else []
        return [*self.calendar_names, *self.history_names, *self.exogenous, *codes]

    @property
    def reach(self) -> int:
        """Rows of history that the finite-window features look back."""
        windows = [self.rolling_min_lag + w for w in self.rolling_windows]
        return max([*self.lags, *windows, 1])

    def _ordered(self, df: DataFrame, spec: PanelSpec) -> DataFrame:
        y, w = spec.target_col, spec.in_order()
        lagged: dict[str, Column] = {f"{y}_lag_{k}": F.lag(y, k).over(w) for k in self.lags}
        return df.withColumns(lagged | rolling_columns(spec, y, self.rolling_windows, self.rolling_stats, self.rolling_min_lag))

    def transform(self, df: DataFrame) -> DataFrame:
        spec, y = self.spec, self.spec.target_col
        # Windows sort what they carry: the weighted means, which sort most often, come first, and calendar columns last.
        out = add_ewm_features(df, spec, y, self.ewm_halflives, self.rolling_min_lag, self.block) if self.ewm_halflives else df
        out = by_blocks(out, spec, self.reach, self.block, self._ordered) if self.block else self._ordered(out, spec)
        out = add_calendar_features(out, spec.date_col, self.cyclical_calendar)
        out = out.select(*df.columns, *[c for c in (*self.calendar_names, *self.history_names) if c not in df.columns])
        return self.with_codes(out)

    def fitted(self, train: DataFrame) -> FeatureBuilder:
        """A builder whose key codes come from ``train`` and are the same for every table; unseen and null keys get -1."""
        if not self.encode_keys or self.codes is not None:
            return self
        return replace(self, codes={f"{k}_code": reliable_checkpoint(fit_labels(train, k)) for k in self.spec.key_cols})

    def with_codes(self, df: DataFrame) -> DataFrame:
        """Adds the key codes, if the builder has them."""
        if not self.encode_keys:
            return df
        copies = df.withColumns({f"{k}_code": F.col(k) for k in self.spec.key_cols})
        if self.codes is not None:
            return apply_label_encoding(copies, dict(self.codes))
        return label_encode(copies, [f"{k}_code" for k in self.spec.key_cols])[0]


def causal_features(names: Sequence[str], builder: FeatureBuilder, extra: Sequence[str] = ()) -> list[str]:
    """Features that use nothing after their date: the builder's calendar and history, keys in any encoding, and ``extra``.

    Exogenous columns are left out unless ``extra`` declares that they are known ahead.
    """
    keys = [f"{k}{end}" for k in builder.spec.key_cols for end in ("", "_code", "_te")]
    known = {*builder.calendar_names, *builder.history_names, *keys, *extra}
    return [n for n in names if n in known]


# --- the same history features from an array of recent values ---------------------------


def _known(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values).cast("double"))


def _var(values: Column) -> Column:
    mu = _mean(values)
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mu) * (v - mu)), (F.size(values) - 1).cast("double"))


def _median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(values)
    lo, hi = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.try_element_at(ordered, lo) + F.try_element_at(ordered, hi)) / 2)


def _shape(values: Column, use: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """``use(n, m2, m3, m4)`` with sums of powers around the mean; equal values have sums of exactly zero."""
    base = F.get(values, F.lit(0))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "abc"])

    def around(mu: Column) -> Column:
        def add(s: Column, v: Column) -> Column:
            return F.struct(*[(s[c] + F.pow(v - base - mu, F.lit(p))).alias(c) for c, p in zip("abc", (2, 3, 4), strict=True)])

        return let(F.aggregate(values, zero, add), lambda s: use(F.size(values).cast("double"), s["a"], s["b"], s["c"]))

    return let(_mean(F.transform(values, lambda v: v - base)), around)


def _skew(values: Column) -> Column:
    def of(n: Column, m2: Column, m3: Column, _: Column) -> Column:
        g = F.try_divide(F.sqrt(n) * m3, F.pow(m2, F.lit(1.5)))
        return F.when(n > 2, F.when(m2 > 0, F.try_divide(g * F.sqrt(n * (n - 1)), n - 2)).otherwise(0.0))

    return _shape(values, of)


def _kurt(values: Column) -> Column:
    def of(n: Column, m2: Column, _: Column, m4: Column) -> Column:
        g = F.try_divide(n * m4, m2 * m2) - 3.0
        return F.when(n > 3, F.when(m2 > 0, F.try_divide((n - 1) * ((n + 1) * g + 6), (n - 2) * (n - 3))).otherwise(-3.0))

    return _shape(values, of)


ARRAY_STATS = {
    "mean": _mean,
    "std": lambda v: F.sqrt(_var(v)),
    "var": _var,
    "min": F.array_min,
    "max": F.array_max,
    "median": _median,
    "sum": lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x)),
    "skew": _skew,
    "kurt": _kurt,
}


def next_step_features(builder: FeatureBuilder, recent: str) -> dict[str, Column]:
    """Lag and rolling features of the period after an array of recent values (oldest first)."""
    y, arr = builder.spec.target_col, F.col(recent)
    n = F.size(arr)
    out = {f"{y}_lag_{k}": F.try_element_at(arr, F.lit(-k)) for k in builder.lags}
    end = n - builder.rolling_min_lag + 1
    for w in builder.rolling_windows:
        start = F.greatest(end - w + 1, F.lit(1))
        part = _known(F.slice(arr, start, F.greatest(end - start + 1, F.lit(0))))
        for s in builder.rolling_stats:
            if s not in ARRAY_STATS:
                raise ValueError(f"rolling statistic {s!r} is not available in a roll-out")
            out[f"{y}_roll_{s}_{w}"] = ARRAY_STATS[s](part)
    return out
