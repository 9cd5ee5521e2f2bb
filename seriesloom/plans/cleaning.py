"""The cleaning recipe: gaps, then static columns, then missing values, then outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from seriesloom.operators.grid import fill_time_gaps
from seriesloom.operators.impute import ffill_bfill_static, impute_missing
from seriesloom.operators.outliers import winsorize
from seriesloom.spec import PanelSpec


def clean_panel(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None, method: str = "linear", limits: tuple[float, float] | None = (0.01, 0.99)) -> DataFrame:
    """One lazy plan with a single exchange on the keys after the panel is built."""
    out = ffill_bfill_static(fill_time_gaps(df, spec), spec)
    for c in cols or [spec.target_col]:
        out = impute_missing(out, spec, c, method)
        if limits is not None:
            out = winsorize(out, spec, c, *limits)
    return out
