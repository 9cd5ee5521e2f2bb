"""Readers: panels and single series from CSV or parquet."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.grid import fill_time_gaps
from seriesloom.operators.impute import impute_missing
from seriesloom.spec import PanelSpec

PARQUET_SUFFIXES = (".parquet", ".pq")


def _scan(spark: SparkSession, path: str, file_format: str, schema: T.StructType | str | None, options: Mapping) -> DataFrame:
    if file_format == "auto":
        file_format = "parquet" if str(path).lower().rstrip("/").endswith(PARQUET_SUFFIXES) else "csv"
    if file_format not in ("csv", "parquet"):
        raise ValueError(f"unsupported file format: {file_format}")
    reader = spark.read.options(**{"header": "true", **options}) if file_format == "csv" else spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(str(path)) if file_format == "csv" else reader.parquet(str(path))


def _as_date(df: DataFrame, name: str, frequency: str, pattern: str | None = None) -> Column:
    """Date column of the right type; text that is no date becomes null."""
    target = "timestamp_ntz" if frequency.upper().startswith("H") else "date"
    if isinstance(df.schema[name].dataType, T.StringType):
        parsed = F.try_to_timestamp(F.col(name), F.lit(pattern)) if pattern else F.try_to_timestamp(F.col(name))
        return parsed.cast(target)
    return F.col(name).cast(target)


def _as_number(df: DataFrame, name: str) -> Column:
    """Double column in which NaN and unreadable text are null."""
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        value = value.try_cast("double")
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def load_data(
    spark: SparkSession,
    path: str,
    spec: PanelSpec,
    file_format: str = "auto",
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """Panel with parsed date and numeric target; all declared columns must exist.

    Rows keep the order of the files. Order by key and date only where a result
    is shown: every operator sorts inside its own windows.
    """
    df = spec.check(_scan(spark, path, file_format, schema, options))
    return df.withColumns(
        {spec.date_col: _as_date(df, spec.date_col, spec.frequency), spec.target_col: _as_number(df, spec.target_col)}
    )


def resolve_excluded(columns: Sequence[str], patterns: Sequence[str], protected: Sequence[str]) -> list[str]:
    """Columns named by exact names or trailing-``*`` prefixes."""
    hits = {
        p: [c for c in columns if c.startswith(p[:-1])] if p.endswith("*") else [c for c in columns if c == p]
        for p in patterns
    }
    chosen = list(dict.fromkeys(c for found in hits.values() for c in found))
    clash = [c for c in chosen if c in set(protected)]
    if clash:
        raise ValueError(f"date, target and key columns cannot be excluded: {clash}")
    unmatched = [p for p, found in hits.items() if not found]
    if unmatched:
        warnings.warn(f"no column matches {unmatched}", stacklevel=3)
    return chosen


def load_forecasting_data(
    spark: SparkSession,
    path: str,
    date_col: str,
    target_col: str,
    key_cols: Sequence[str],
    parse_dates: bool = True,
    sort: bool = False,
    exclude_cols: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
    frequency: str = "D",
    **options: str,
) -> DataFrame:
    """Panel without the excluded columns; the drop prunes the scan itself."""
    df = _scan(spark, path, "auto", schema, options)
    absent = [c for c in (date_col, target_col, *key_cols) if c not in df.columns]
    if absent:
        raise ValueError(f"columns absent from the data: {absent}")
    if exclude_cols:
        df = df.drop(*resolve_excluded(df.columns, exclude_cols, [date_col, target_col, *key_cols]))
    if parse_dates:
        df = df.withColumn(date_col, _as_date(df, date_col, frequency))
    df = df.withColumn(target_col, _as_number(df, target_col))
    return df.orderBy(*key_cols, date_col) if sort else df


def load_timeseries(
    spark: SparkSession,
    path: str,
    date_col: str,
    value_col: str,
    freq: str | None = None,
    fill_method: str | None = None,
    sep: str = ",",
    date_format: str | None = None,
    series_name: str = "series",
) -> DataFrame:
    """One series as a panel with a constant key column ``series``."""
    raw = _scan(spark, path, "auto", None, {"sep": sep})
    frequency = freq or "D"
    df = raw.select(
        F.lit(series_name).alias("series"),
        _as_date(raw, date_col, frequency, date_format).alias(date_col),
        _as_number(raw, value_col).alias(value_col),
    )
    spec = PanelSpec(date_col, value_col, ("series",), frequency=frequency)
    if freq is not None:
        df = fill_time_gaps(df, spec, add_indicator=False)
    methods = {"ffill": "ffill", "bfill": "bfill", "interpolate": "time"}
    if fill_method is not None:
        df = impute_missing(df, spec, value_col, methods[fill_method], fill_leading=False)
    return df


def read_tables(
    spark: SparkSession,
    folder: str,
    tables: Mapping[str, Mapping],
    file_format: str = "csv",
) -> dict[str, DataFrame]:
    """Several tables of one folder.

    ``tables`` maps a table name to ``{"dates": [...], "drop": [...], "schema": ...}``.
    """
    out = {}
    for name, want in tables.items():
        df = _scan(spark, f"{folder}/{name}.{file_format}", file_format, want.get("schema"), {})
        df = df.drop(*want.get("drop", ()))
        out[name] = df.withColumns({c: _as_date(df, c, "D") for c in want.get("dates", ())})
    return out


def date_from_parts(year: str, month: str, pattern: str = "yyyy-MMM-dd") -> Column:
    """First day of a month given as a year and a month name."""
    return F.to_date(F.concat_ws("-", F.col(year).cast("string"), F.col(month), F.lit("01")), pattern)
