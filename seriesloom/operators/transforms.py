"""Numeric transforms and scaling, fitted by aggregation and applied as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.exact import exact_quantiles
from seriesloom.spec import PanelSpec


def log_transform(c: Column, plus_one: bool = True) -> Column:
    return F.log1p(c) if plus_one else F.ln(c)


def boxcox(c: Column, lam: Column | float) -> Column:
    lam = F.lit(lam) if isinstance(lam, (int, float)) else lam
    return F.when(F.abs(lam) < 1e-12, F.ln(c)).otherwise(F.try_divide(F.pow(c, lam) - 1, lam))


def inverse_boxcox(c: Column, lam: Column | float) -> Column:
    lam = F.lit(lam) if isinstance(lam, (int, float)) else lam
    return F.when(F.abs(lam) < 1e-12, F.exp(c)).otherwise(F.pow(c * lam + 1, F.try_divide(F.lit(1.0), lam)))


def yeo_johnson(c: Column, lam: Column | float) -> Column:
    lam = F.lit(lam) if isinstance(lam, (int, float)) else lam
    mirrored = 2 - lam
    upper = F.when(F.abs(lam) < 1e-12, F.log1p(c)).otherwise(F.try_divide(F.pow(c + 1, lam) - 1, lam))
    lower = F.when(F.abs(mirrored) < 1e-12, -F.log1p(-c)).otherwise(-F.try_divide(F.pow(1 - c, mirrored) - 1, mirrored))
    return F.when(c >= 0, upper).otherwise(lower)


def _likelihood(transformed: Column, lam: Column, jacobian: Column) -> Column:
    """Profile log likelihood of a power transform under a normal model."""
    n = F.count(transformed).cast("double")
    return -n / 2 * F.ln(F.var_pop(transformed)) + (lam - 1) * F.sum(jacobian)


#: Values beyond each end of the grid; their distances double, up to 127.5 beyond it.
BEYOND = 8


def _best_lambda(df: DataFrame, keys: Sequence[str], col: str, form, jacobian: Column, lo: float, hi: float, steps: int, rounds: int) -> DataFrame:
    """Grid maximum refined ``rounds`` times; each round is one aggregation.

    The grid is even from ``lo`` to ``hi`` and goes on beyond both ends in steps that
    double, so a maximum outside is found as well. A round divides the distance to
    the neighbouring values by five.
    """
    y = F.col(col).cast("double")
    width = (hi - lo) / steps
    inside = [(lo + i * width, width) for i in range(steps + 1)]
    outside = [(0.5 * (2**i - 1), 0.5 * 2**i) for i in range(1, BEYOND + 1)]
    grid = [(lo - far, gap) for far, gap in reversed(outside)] + inside + [(hi + far, gap) for far, gap in outside]
    found = _grid_pass(df, keys, y, form, jacobian, [(F.lit(g), F.lit(gap)) for g, gap in grid])
    for _ in range(rounds):
        # The next grid surrounds each key's own best value.
        joined = _join_fit(df, found, keys)
        inner = F.col("_gap") / 5
        found = _grid_pass(joined, keys, y, form, jacobian, [(F.col("_lam") + inner * i, inner) for i in range(-5, 6)], own=True)
    return found.drop("_gap")


def _join_fit(df: DataFrame, fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    from seriesloom.operators.impute import join_on_keys

    return join_on_keys(df, fit.withColumnRenamed("lambda", "_lam").drop("loglik"), keys)


def _grid_pass(df, keys, y, form, jacobian, lams, own=False) -> DataFrame:
    """Best of the given (lambda, gap) per key.

    A row meets every grid value inside its task and is summed there at once: an aggregate with an expression for each
    value would be too large a method for the JVM to compile.
    """
    row = F.struct(y.alias("y"), jacobian.cast("double").alias("jacobian"))
    pairs = F.array(*[F.struct(lam.alias("lam"), gap.alias("gap")) for lam, gap in lams])
    # Literals are the same for all rows of a key, own values too: they are part of the group.
    wide = df.select(*keys, row.alias("_row"), F.inline(pairs).alias("_at", "_step"))
    met = wide.select(*keys, "_at", "_step", form(F.col("_row.y"), F.col("_at")).alias("_value"), F.col("_row.jacobian").alias("_jacobian"))
    each = met.groupBy(*keys, "_at", "_step").agg(_likelihood(F.col("_value"), F.col("_at"), F.col("_jacobian")).alias("_fit"))
    usable = F.col("_fit").isNotNull() & (F.abs("_fit") < float("inf"))
    best = each.groupBy(*keys).agg(F.max(F.when(usable, F.struct("_fit", "_at", "_step"))).alias("_best"))
    return best.select(*keys, F.col("_best")["_at"].alias("lambda"), F.col("_best")["_fit"].alias("loglik"), F.col("_best")["_step"].alias("_gap"))


def fit_boxcox(df: DataFrame, col: str, keys: Sequence[str] = (), lo: float = -2.0, hi: float = 2.0, steps: int = 40, rounds: int = 2) -> DataFrame:
    """Lambda per key (or one for the table) that makes positive values most normal."""
    y = F.col(col)
    positive = F.when(y.isNull() | (y > 0), y).otherwise(F.raise_error("Box-Cox needs values above zero").cast("double"))
    data = df.select(*keys, positive.alias(col)).dropna(subset=[col])
    return _best_lambda(data, keys, col, boxcox, F.ln(F.col(col)), lo, hi, steps, rounds)


def fit_yeo_johnson(df: DataFrame, col: str, keys: Sequence[str] = (), lo: float = -2.0, hi: float = 4.0, steps: int = 40, rounds: int = 2) -> DataFrame:
    y = F.col(col)
    data = df.select(*keys, y.cast("double").alias(col)).dropna(subset=[col])
    return _best_lambda(data, keys, col, yeo_johnson, F.signum(y) * F.log1p(F.abs(y)), lo, hi, steps, rounds)


def boxcox_transform(df: DataFrame, col: str, keys: Sequence[str] = (), out: str | None = None, **grid) -> DataFrame:
    """Adds the transformed column and ``lambda``."""
    fitted = _join_fit(df, fit_boxcox(df, col, keys, **grid), keys)
    return fitted.withColumn(out or f"{col}_bc", boxcox(F.col(col), F.col("_lam"))).withColumnRenamed("_lam", "lambda")


def yj_transform(df: DataFrame, col: str, keys: Sequence[str] = (), out: str | None = None, **grid) -> DataFrame:
    fitted = _join_fit(df, fit_yeo_johnson(df, col, keys, **grid), keys)
    return fitted.withColumn(out or f"{col}_yj", yeo_johnson(F.col(col), F.col("_lam"))).withColumnRenamed("_lam", "lambda")


def fit_scaler(train: DataFrame, cols: Sequence[str], method: str = "standard") -> DataFrame:
    """One row with ``<col>_center`` and ``<col>_scale``; a zero scale becomes 1."""
    if method == "robust":
        q = exact_quantiles(train, cols, [0.25, 0.5, 0.75])
        pick = lambda c, p: F.max(F.when((F.col("column") == c) & (F.col("prob") == p), F.col("value")))
        stats = {c: (pick(c, 0.5), pick(c, 0.75) - pick(c, 0.25)) for c in cols}
        source = q
    elif method in ("standard", "minmax"):
        source = train
        stats = {
            c: (F.avg(c), F.stddev_pop(c)) if method == "standard" else (F.min(c), F.max(c) - F.min(c)) for c in cols
        }
    else:
        raise ValueError(f"unknown scaler: {method}")
    out = []
    for c, (center, scale) in stats.items():
        out += [center.cast("double").alias(f"{c}_center"), F.when(scale == 0, 1.0).otherwise(scale.cast("double")).alias(f"{c}_scale")]
    return source.agg(*out)


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Scaled columns from a one-row fit."""
    wide = df.join(F.broadcast(scaler))
    out = wide.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"{c}_center")) / F.col(f"{c}_scale") for c in cols})
    return out.drop(*scaler.columns)


def power_target(c: Column, exponent: float = 0.5) -> Column:
    return F.pow(c, F.lit(exponent))


def invert_power_target(c: Column, exponent: float = 0.5) -> Column:
    """Inverse of :func:`power_target`; negative predictions become zero."""
    return F.pow(F.greatest(c, F.lit(0.0)), F.lit(1.0 / exponent))


def z_score_per_key(df: DataFrame, spec: PanelSpec, col: str, name: str) -> DataFrame:
    """Standardised within the key; zero for a constant column.

    Means and deviations are aggregated per key and joined, so a key with very
    many rows is reduced before any exchange.
    """
    from seriesloom.operators.impute import join_on_keys

    stats = df.groupBy(*spec.key_cols).agg(F.avg(col).alias("_mu"), F.stddev_samp(col).alias("_sd"))
    z = F.when(F.col("_sd") == 0, 0.0).otherwise((F.col(col) - F.col("_mu")) / F.col("_sd"))
    return join_on_keys(df, stats, spec.key_cols).withColumn(name, z).drop("_mu", "_sd")


def remove_group_mean(df: DataFrame, groups: Sequence[str], col: str, name: str) -> DataFrame:
    from seriesloom.operators.impute import join_on_keys

    means = df.groupBy(*groups).agg(F.avg(col).alias("_mu"))
    return join_on_keys(df, means, groups).withColumn(name, F.col(col) - F.col("_mu")).drop("_mu")
