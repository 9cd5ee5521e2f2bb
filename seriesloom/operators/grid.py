"""Regular grids: building, completing and extending the calendar of each key.

Completion never joins facts to a generated calendar. Every row knows the
period of its successor (one ``lead``), so it emits itself plus the periods up
to that successor. One exchange on the keys serves completion and all the
windows that follow it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.session import dealt, reliable_checkpoint
from seriesloom.spec import Frequency, PanelSpec

INSERTED = "_was_imputed"


def to_panel(df: DataFrame, spec: PanelSpec, measures: Mapping[str, Column]) -> DataFrame:
    """Reduce raw records to one row per key and date.

    The aggregation is partial on the map side, so a key that owns a large share
    of the records reaches the exchange as one row per date and task.
    """
    return df.groupBy(*spec.key_cols, spec.date_col).agg(*[c.alias(n) for n, c in measures.items()])


def collapse_duplicates(df: DataFrame, spec: PanelSpec, how: str = "sum") -> DataFrame:
    """One row per key and date.

    ``first`` keeps the row that is smallest when its columns are compared in
    order; ``sum``, ``mean``, ``min`` and ``max`` aggregate the target and keep
    the smallest non-null value of every other column.
    """
    ident = [*spec.key_cols, spec.date_col]
    rest = [c for c in df.columns if c not in ident]
    if how == "first":
        picked = df.groupBy(*ident).agg(F.min(F.struct(*rest)).alias("_row"))
        return picked.select(*ident, "_row.*").select(*df.columns)
    reducers = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    if how not in reducers:
        raise ValueError(f"unknown way to resolve duplicates: {how}")
    aggs = [(reducers[how] if c == spec.target_col else F.min)(c).alias(c) for c in rest]
    return df.groupBy(*ident).agg(*aggs).select(*df.columns)


def _spread(df: DataFrame, spec: PanelSpec, last: Column | None = None) -> DataFrame:
    """Rows plus the missing periods after each; ``_step`` is 0 on original rows."""
    f = spec.freq
    rows = df.filter(F.col(spec.date_col).isNotNull()).withColumn("_at", f.strict_index(spec.date_col))
    final = F.col("_at") if last is None else F.greatest(F.col("_at"), f.index(last))
    rows = rows.withColumn("_next", F.lead("_at").over(spec.in_order()))
    until = F.when(F.col("_next").isNull(), final).otherwise(F.greatest(F.col("_at"), F.col("_next") - 1))
    rows = rows.withColumn("_until", until)
    wide = rows.select("*", F.posexplode(F.sequence("_at", "_until")).alias("_step", "_period"))
    kept = {c for c in (*spec.key_cols, spec.date_col)}
    columns = [
        f.date("_period").alias(c) if c == spec.date_col
        else F.col(c) if c in kept
        else F.when(F.col("_step") == 0, F.col(c)).alias(c)
        for c in df.columns
    ]
    return wide.select(*columns, (F.col("_step") > 0).alias(INSERTED))


def _finish(grid: DataFrame, spec: PanelSpec, fill_value: float | None, add_indicator: bool) -> DataFrame:
    if fill_value is not None:
        grid = grid.withColumn(spec.target_col, F.coalesce(spec.target_col, F.lit(fill_value)))
    return grid if add_indicator else grid.drop(INSERTED)


def dealt_by_periods(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """The rows, stored and dealt by their keys into parts that hold a bounded number of periods once they are completed.

    A key with two rows may become years of days: parts by the bytes of the rows would then be too large to sort in memory.
    """
    stored = reliable_checkpoint(df)
    at = spec.freq.index(spec.date_col)
    spans = stored.groupBy(*spec.key_cols).agg((F.max(at) - F.min(at) + 1).cast("bigint").alias("_periods"))
    return dealt(stored, *spec.key_cols, rows=spans.agg(F.sum("_periods")).first()[0] or 0)


def fill_time_gaps(
    df: DataFrame, spec: PanelSpec, fill_value: float | None = None, add_indicator: bool = True
) -> DataFrame:
    """Insert missing periods between the first and last date of each key.

    Inserted rows carry null in every non-key column and ``_was_imputed`` true.
    ``fill_value`` replaces every null target.
    """
    return _finish(_spread(df, spec), spec, fill_value, add_indicator)


def complete_panel(df: DataFrame, spec: PanelSpec, fill_value: float | None = 0.0) -> DataFrame:
    """:func:`fill_time_gaps` for demand panels: no row means no demand."""
    return fill_time_gaps(df, spec, fill_value, add_indicator=False)


def extend_to_last_date(
    df: DataFrame, spec: PanelSpec, last: Column | None = None, fill_value: float | None = None, add_indicator: bool = False
) -> DataFrame:
    """Grid from the first date of each key to ``last`` (default: latest date of all keys)."""
    columns = df.columns
    if last is None:
        # One row, so the broadcast has a fixed size.
        latest = df.agg(F.max(spec.date_col).alias("_latest"))
        df, last = df.join(F.broadcast(latest)), F.col("_latest")
    grid = _spread(df, spec, last).select(*columns, INSERTED)
    return _finish(grid, spec, fill_value, add_indicator)


def future_dates(df: DataFrame, spec: PanelSpec, horizon: int) -> DataFrame:
    """The ``horizon`` periods after the last date of each key."""
    last = df.groupBy(*spec.key_cols).agg(F.max(spec.date_col).alias("_last"))
    return explode_horizon(last, spec, "_last", horizon).drop("_last")


def explode_horizon(origins: DataFrame, spec: PanelSpec, origin: str, horizon: int) -> DataFrame:
    """One row per step ahead: ``horizon`` and the forecast date."""
    f: Frequency = spec.freq
    steps = origins.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.withColumn(spec.date_col, f.shift(origin, F.col("horizon")))


def keys_by_dates(df: DataFrame, spec: PanelSpec, dates: list[str]) -> DataFrame:
    """Every key with every given date; the date list is a literal of the plan."""
    target = "timestamp_ntz" if spec.freq.hourly else "date"
    literal = F.array(*[F.lit(d).cast(target) for d in dates])
    return df.select(*spec.key_cols).distinct().withColumn(spec.date_col, F.explode(literal))
