"""Forecast metrics as aggregate expressions over actual ``y`` and forecast ``f``.

Rows with a null on either side do not count. Scaled metrics take the scale as
a column (see ``operators.scoring.naive_scale``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: guard of the panel metrics against near-zero denominators.
EPS = 1e-8


def _paired(y: Column, f: Column, value: Column) -> Column:
    return F.when(y.isNotNull() & f.isNotNull(), value)


def mae(y: Column, f: Column) -> Column:
    return F.avg(F.abs(y - f))


def mse(y: Column, f: Column) -> Column:
    return F.avg((y - f) * (y - f))


def rmse(y: Column, f: Column) -> Column:
    return F.sqrt(mse(y, f))


def mape(y: Column, f: Column, eps: float = 0.0) -> Column:
    """Percent error over rows whose actual is farther from zero than ``eps``."""
    return F.avg(F.when(F.abs(y) > eps, F.abs((y - f) / y))) * 100


def smape(y: Column, f: Column) -> Column:
    """Symmetric percent error; rows with both sides zero are left out."""
    return F.avg(F.try_divide(F.abs(y - f), (F.abs(y) + F.abs(f)) / 2)) * 100


def smape_eps(y: Column, f: Column, eps: float = EPS) -> Column:
    """Symmetric percent error with a guarded denominator; zero rows count as zero."""
    return F.avg(F.abs(y - f) / ((F.abs(y) + F.abs(f)) / 2 + eps)) * 100


def _volume(y: Column, f: Column) -> Column:
    total = F.sum(_paired(y, f, F.abs(y)))
    return F.when(total >= EPS, total)


def wape(y: Column, f: Column) -> Column:
    return F.try_divide(F.sum(F.abs(y - f)), _volume(y, f)) * 100


def bias(y: Column, f: Column) -> Column:
    """Mean of actual minus forecast: positive means the forecast is too low."""
    return F.avg(y - f)


def me(y: Column, f: Column) -> Column:
    """Mean of forecast minus actual."""
    return F.avg(f - y)


def pct_bias(y: Column, f: Column) -> Column:
    return F.try_divide(F.sum(y - f), _volume(y, f)) * 100


def cfe(y: Column, f: Column) -> Column:
    """Cumulative forecast error."""
    return F.sum(y - f)


def mase(y: Column, f: Column, scale: Column) -> Column:
    """MAE in units of the naive training error of each row's key."""
    return F.avg(F.when(scale >= EPS, F.abs(y - f) / scale))


def rmsse(y: Column, f: Column, squared_scale: Column) -> Column:
    return F.sqrt(F.avg(F.when(squared_scale >= EPS, (y - f) * (y - f) / squared_scale)))


def pinball_loss(y: Column, f: Column, q: Column | float) -> Column:
    d = y - f
    q = F.lit(q) if isinstance(q, float) else q
    return F.avg(F.when(d.isNotNull(), F.greatest(q * d, (q - 1) * d)))


def coverage(y: Column, lower: Column, upper: Column) -> Column:
    return F.avg(y.between(lower, upper).cast("double"))


def rmsle(y: Column, f: Column) -> Column:
    d = F.log1p(F.greatest(y, F.lit(0.0))) - F.log1p(F.greatest(f, F.lit(0.0)))
    return F.sqrt(F.avg(_paired(y, f, d * d)))


def weighted_mae(y: Column, f: Column, w: Column) -> Column:
    return F.try_divide(F.sum(w * F.abs(y - f)), F.sum(_paired(y, f, w)))


def poisson_loss(y: Column, f: Column) -> Column:
    """Negative log likelihood without the term that depends on y only."""
    return F.avg(F.when(f > 0, f - y * F.ln(f)))


def tweedie_deviance(y: Column, f: Column, power: float = 1.2) -> Column:
    """Deviance for a variance power between 1 and 2."""
    a, b = 1.0 - power, 2.0 - power
    term = F.pow(F.greatest(y, F.lit(0.0)), F.lit(b)) / (a * b) - y * F.pow(f, F.lit(a)) / a + F.pow(f, F.lit(b)) / b
    return F.avg(F.when(f > 0, 2 * term))


def report(y: Column, f: Column) -> dict[str, Column]:
    """Columns of the point-forecast report."""
    return {
        "MAE": mae(y, f),
        "RMSE": rmse(y, f),
        "WAPE": wape(y, f),
        "sMAPE": smape_eps(y, f),
        "MAPE": mape(y, f, EPS),
        "Bias": bias(y, f),
        "PctBias": pct_bias(y, f),
    }
