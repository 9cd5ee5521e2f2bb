"""Persisting a reproducible sample of a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.select import sample_keys
from seriesloom.sources.writers import write_csv
from seriesloom.spec import PanelSpec


def sample_panel(df: DataFrame, spec: PanelSpec, n_keys: int = 500, columns: Sequence[str] | None = None, until: str | None = None, seed: int = 42) -> DataFrame:
    """Chosen columns of ``n_keys`` keys up to a date; both limits reach the scan."""
    rows = df.select(*columns) if columns else df
    if until is not None:
        rows = rows.filter(F.col(spec.date_col) <= F.lit(until).cast("date"))
    return sample_keys(rows, spec, n_keys, seed)


def save_sample(df: DataFrame, spec: PanelSpec, path: str, **options) -> None:
    write_csv(sample_panel(df, spec, **options), path)
