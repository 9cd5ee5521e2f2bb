"""Aggregate expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    """Number of rows where the condition holds (null counts as no)."""
    return F.count(F.when(condition, True))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def variation(y: Column) -> Column:
    """Coefficient of variation; null for a zero mean or fewer than two values."""
    return F.try_divide(F.stddev_samp(y), F.avg(y))


def adjusted_skewness(y: Column) -> Column:
    """Sample skewness G1 from the population moment ratio; 0 for constant values."""
    n = F.count(y).cast("double")
    ratio = F.skewness(y) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n > 2, F.when(F.var_pop(y) > 0, ratio).otherwise(0.0))


def adjusted_kurtosis(y: Column) -> Column:
    """Sample excess kurtosis G2 from the population moment ratio; 0 for constant values."""
    n = F.count(y).cast("double")
    ratio = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(y) + 6)
    return F.when(n > 3, F.when(F.var_pop(y) > 0, ratio).otherwise(0.0))
