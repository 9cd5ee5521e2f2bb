"""Autocorrelation, stationarity tests and decompositions per key.

Series reach these operators at one row per period, so an array of a series is
bounded by its calendar.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.impute import join_on_keys, next_value, previous_value
from seriesloom.operators.linear import at, diagonal, let, sweep, sweep_all, usable
from seriesloom.spec import PanelSpec


def _known_first(spec: PanelSpec) -> WindowSpec:
    """Known values in date order, then the null ones: neighbours are known values, and no key is lost."""
    return Window.partitionBy(*spec.key_cols).orderBy(F.col("_v").isNull(), spec.date_col)


def _centred(df: DataFrame, spec: PanelSpec, col: str) -> DataFrame:
    kept = df.select(*spec.key_cols, spec.date_col, F.col(col).cast("double").alias("_v"))
    return kept.withColumn("_c", F.col("_v") - F.avg("_v").over(spec.per_key()))


def autocorrelation(df: DataFrame, spec: PanelSpec, col: str | None = None, nlags: int = 40, limit: str = "n-1") -> DataFrame:
    """``(keys, n, lag, acf)`` for lags 0.. with denominator n.

    All lagged products come from one window over the keys and one aggregation
    on the same keys. Lags stop at n-1, or at n/2-1 with ``limit='half'``. A key
    with fewer than two values, or a constant one, has lag 0 with a null value.
    """
    col = col or spec.target_col
    base = _centred(df, spec, col)
    lagged = base.withColumns({f"_p{k}": F.col("_c") * F.lag("_c", k).over(_known_first(spec)) for k in range(1, nlags + 1)})
    sums = lagged.groupBy(*spec.key_cols).agg(
        F.count("_v").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_s0"), *[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(1, nlags + 1)]
    )
    values = F.array(*[F.try_divide(F.coalesce(f"_s{k}", F.lit(0.0)), F.col("_s0")) for k in range(nlags + 1)])
    top = F.col("n") - 1 if limit == "n-1" else F.greatest(F.floor(F.col("n") / 2) - 1, F.lit(1))
    top = F.when(F.col("n") > 1, F.least(F.lit(nlags), top)).otherwise(0)
    kept = F.slice(values, 1, top.cast("int") + 1)
    return sums.select(*spec.key_cols, "n", F.posexplode(kept).alias("lag", "acf"))


def _levinson(r: Column) -> Column:
    """Partial autocorrelations from autocorrelations by the Durbin-Levinson recursion."""

    def extend(st: Column, k: Column) -> Column:
        phi = st["phi"]
        dot = lambda other: F.aggregate(F.zip_with(phi, other, lambda a, b: a * b), F.lit(0.0), lambda x, v: x + v)
        back = F.reverse(F.slice(r, 2, k - 1))
        a = F.try_divide(F.element_at(r, k + 1) - dot(back), 1.0 - dot(F.slice(r, 2, k - 1)))
        new = F.concat(F.zip_with(phi, F.reverse(phi), lambda x, y: x - a * y), F.array(a))
        return F.struct(new.alias("phi"), F.concat(st["pacf"], F.array(a)).alias("pacf"))

    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), F.array(F.lit(1.0)).alias("pacf"))
    return F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), start, extend)["pacf"]


def acf_pacf(df: DataFrame, spec: PanelSpec, col: str | None = None, nlags: int = 40, z: float = 1.959963984540054, limit: str = "n-1") -> DataFrame:
    """``(keys, lag, acf, pacf, ...)`` with interval half-widths.

    ``acf_half`` is Bartlett's, ``pacf_half`` is z/sqrt(n), ``white_half`` is the
    constant 1.96/sqrt(n) band. A key with fewer than two values has one row, with nulls.
    """
    acf = autocorrelation(df, spec, col, nlags, limit)
    listed = acf.groupBy(*spec.key_cols, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias("_r"))
    partial = F.when(F.size("_r") > 1, _levinson(F.col("_r"))).otherwise(F.array(F.lit(None).cast("double")))
    both = listed.select(*spec.key_cols, "n", "_r", partial.alias("_p"))
    rows = both.select(*spec.key_cols, "n", F.posexplode(F.arrays_zip(F.col("_r").alias("acf"), F.col("_p").alias("pacf"))).alias("lag", "_z"))
    out = rows.select(*spec.key_cols, "n", "lag", F.col("_z")["acf"].alias("acf"), F.col("_z")["pacf"].alias("pacf"))
    before = Window.partitionBy(*spec.key_cols).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(before), F.lit(0.0))
    root = F.sqrt(F.col("n").cast("double"))
    zero = F.col("lag") == 0
    return out.withColumns(
        {
            "acf_half": F.when(zero, 0.0).otherwise(z * F.sqrt(1 + 2 * squares) / root),
            "pacf_half": F.when(zero, 0.0).otherwise(z / root),
            "white_half": F.try_divide(F.lit(1.96), root),
        }
    )


def cross_correlation(df: DataFrame, spec: PanelSpec, x: str, y: str, nlags: int = 20) -> DataFrame:
    """``(keys, lag, ccf)``: correlation of x at t+lag with y at t, denominator n."""
    kept = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = spec.per_key()
    base = kept.select(
        *spec.key_cols, spec.date_col,
        (F.col(x) - F.avg(x).over(w)).alias("_x"), (F.col(y) - F.avg(y).over(w)).alias("_y"),
    )
    lagged = base.withColumns({f"_p{k}": F.col("_x") * F.lag("_y", k).over(spec.in_order()) for k in range(nlags + 1)})
    sums = lagged.groupBy(*spec.key_cols).agg(
        F.sum(F.col("_x") * F.col("_x")).alias("_xx"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"),
        *[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(nlags + 1)],
    )
    scale = F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))
    values = F.array(*[F.try_divide(F.col(f"_s{k}"), scale) for k in range(nlags + 1)])
    return sums.select(*spec.key_cols, F.posexplode(values).alias("lag", "ccf"))


# --- Ljung-Box -------------------------------------------------------------------------

def _upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function for the chi-square tail."""
    out = np.ones_like(x)
    lg = np.array([math.lgamma(v) for v in a])
    low = (x > 0) & (x < a + 1)
    term = 1.0 / a
    total = term.copy()
    for i in range(1, 500):
        term = term * x / (a + i)
        total = total + np.where(low, term, 0.0)
    front = np.exp(np.where(x > 0, -x + a * np.log(np.where(x > 0, x, 1.0)) - lg, 0.0))
    out = np.where(low, 1.0 - front * total, out)
    high = x >= a + 1
    tiny = 1e-300
    b = x + 1.0 - a
    c = np.full_like(x, 1.0 / tiny)
    d = 1.0 / np.where(np.abs(b) < tiny, tiny, b)
    h = d.copy()
    for i in range(1, 500):
        an = -i * (i - a)
        b = b + 2.0
        d = 1.0 / np.where(np.abs(an * d + b) < tiny, tiny, an * d + b)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * np.where(high, d * c, 1.0)
    return np.where(high, front * h, out)


@F.pandas_udf(T.DoubleType())
def chi_square_tail(q: pd.Series, df: pd.Series) -> pd.Series:
    x = q.to_numpy(dtype=float) / 2.0
    a = df.to_numpy(dtype=float) / 2.0
    ok = np.isfinite(x)
    p = _upper_gamma(a, np.where(ok, x, 1.0))
    return pd.Series(np.where(ok, np.clip(p, 0.0, 1.0), np.nan))


def ljung_box_statistic(df: DataFrame, spec: PanelSpec, col: str | None = None, lags: int = 10) -> DataFrame:
    """``(keys, lag, lb_stat)``: n(n+2) times the running sum of acf²/(n-k).

    A key with fewer than two values has lag 0 with a null statistic.
    """
    acf = autocorrelation(df, spec, col, lags).filter((F.col("lag") > 0) | (F.col("n") < 2))
    n = F.col("n").cast("double")
    upto = Window.partitionBy(*spec.key_cols).orderBy("lag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stat = n * (n + 2) * F.sum(F.try_divide(F.col("acf") * F.col("acf"), n - F.col("lag"))).over(upto)
    return acf.select(*spec.key_cols, "lag", stat.alias("lb_stat"))


def ljung_box_test(df: DataFrame, spec: PanelSpec, col: str | None = None, lags: int = 10) -> DataFrame:
    """Statistic and p-value per lag; ``white_noise`` when all p-values exceed 0.05.

    Python sees one row per key and lag, in Arrow batches.
    """
    stats = ljung_box_statistic(df, spec, col, lags)
    tested = stats.withColumn("lb_pvalue", chi_square_tail(F.col("lb_stat"), F.col("lag").cast("double")))
    return tested.withColumn("white_noise", F.min(F.col("lb_pvalue") > 0.05).over(spec.per_key()))


# --- stationarity ----------------------------------------------------------------------

# KPSS (1992) critical values at 10, 5, 2.5 and 1 percent.
KPSS_LEVELS = (0.10, 0.05, 0.025, 0.01)
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
# MacKinnon (2010) response surfaces, coefficients of 1, 1/n, 1/n², 1/n³ at 1, 5 and 10 percent.
ADF_SURFACE = {
    "n": ((-2.56574, -2.2358, -3.627, 0.0), (-1.94100, -0.2686, -3.365, 31.223), (-1.61682, 0.2656, -2.714, 25.364)),
    "c": ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0)),
    "ct": ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380)),
}


def kpss_test(df: DataFrame, spec: PanelSpec, col: str | None = None, regression: str = "c") -> DataFrame:
    """KPSS statistic, automatic bandwidth, interpolated p-value and verdict per key.

    Residual products are array expressions over one ordered array per key. A key
    with fewer than three values has nulls and the reason in ``error``.
    """
    if regression not in KPSS_CRITICAL:
        raise ValueError("regression must be 'c' or 'ct'")
    col = col or spec.target_col
    kept = df.select(*spec.key_cols, spec.date_col, F.col(col).cast("double").alias("_v"))
    w, known = spec.per_key(), F.col("_v").isNotNull()
    placed = kept.withColumn("_i", F.when(known, F.row_number().over(_known_first(spec))).cast("double"))
    if regression == "c":
        fitted = F.avg("_v").over(w)
    else:
        slope = F.try_divide(F.covar_pop("_v", "_i").over(w), F.var_pop("_i").over(w))
        fitted = F.avg("_v").over(w) + slope * (F.col("_i") - F.avg("_i").over(w))
    resid = placed.withColumn("_e", F.col("_v") - fitted)
    upto = _known_first(spec).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = resid.withColumn("_s", F.when(known, F.sum("_e").over(upto)))
    series = summed.groupBy(*spec.key_cols).agg(
        F.count("_v").alias("n_obs"),
        F.sum(F.col("_s") * F.col("_s")).alias("_eta"),
        F.transform(F.array_sort(F.collect_list(F.when(known, F.struct("_i", "_e")))), lambda s: s["_e"]).alias("_e"),
    )
    e, n = F.col("_e"), F.col("n_obs").cast("double")

    def cov(k: Column) -> Column:
        # slice starts at k+1; pairs (e[t], e[t-k])
        pairs = F.greatest(F.size(e) - k, F.lit(0))
        return F.aggregate(
            F.zip_with(F.slice(e, k + 1, pairs), F.slice(e, F.lit(1), pairs), lambda a, b: a * b),
            F.lit(0.0), lambda acc, v: acc + v,
        )

    pilot = F.floor(F.pow(n, F.lit(2.0 / 9.0))).cast("int")
    zero = F.try_divide(cov(F.lit(0)), n)
    lagsum = lambda weight: F.aggregate(F.sequence(F.lit(1), F.col("_pilot")), F.lit(0.0), lambda acc, k: acc + F.try_divide(weight(k) * cov(k), n / 2))
    with_pilot = series.withColumn("_pilot", F.greatest(pilot, F.lit(1)))
    ratio = F.try_divide(lagsum(lambda k: k.cast("double")), zero + lagsum(lambda k: F.lit(1.0)))
    banded = with_pilot.withColumn(
        "n_lags", F.least(F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1.0 / 3.0)) * F.pow(n, F.lit(1.0 / 3.0))), F.col("n_obs") - 1).cast("int")
    )
    tail = F.when(
        F.col("n_lags") > 0,
        F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n_lags"), F.lit(1))), F.lit(0.0), lambda acc, k: acc + (1.0 - k / (F.col("n_lags") + 1.0)) * cov(k)),
    ).otherwise(0.0)
    long_run = F.try_divide(cov(F.lit(0)) + 2 * tail, n)
    enough = F.col("n_obs") > 2
    stat = F.when(enough, F.try_divide(F.col("_eta"), n * n * long_run))
    tested = banded.withColumn("statistic", stat)
    crit = KPSS_CRITICAL[regression]
    p = F.when(F.col("statistic") <= crit[0], KPSS_LEVELS[0])
    for (c0, p0), (c1, p1) in zip(zip(crit, KPSS_LEVELS, strict=True), list(zip(crit, KPSS_LEVELS, strict=True))[1:], strict=False):
        p = p.when(F.col("statistic") <= c1, p0 + (F.col("statistic") - c0) * ((p1 - p0) / (c1 - c0)))
    p = p.when(F.col("statistic").isNotNull(), KPSS_LEVELS[-1])
    return tested.select(
        *spec.key_cols, "n_obs", "statistic", p.alias("p_value"), F.when(enough, F.col("n_lags")).alias("n_lags"),
        F.lit(crit[1]).alias("critical_5pct"), (F.col("statistic") < crit[1]).alias("stationary"),
        F.when(~enough, "fewer than 3 observations").when(F.col("statistic").isNull(), "constant series").alias("error"),
    )


def _adf_sums(df: DataFrame, spec: PanelSpec, col: str, extra: int, max_lag: int | None) -> DataFrame:
    """One row per key: length, largest lag, sums of lagged products and the first and last differences.

    The products of two lagged differences depend on their distance but for the rows at both ends, so a sum for each
    distance and the ends give the whole matrix.
    """
    keys, order = list(spec.key_cols), spec.in_order()
    known = df.select(*keys, spec.date_col, F.col(col).cast("double").alias("_y")).filter(F.col("_y").isNotNull())
    size = F.count("*").over(spec.per_key())
    # Shifted to mean zero, which changes no statistic once there is a constant.
    level = F.col("_y") - F.avg("_y").over(spec.per_key()) if extra else F.col("_y")
    rows = known.withColumns({"_n": size, "_t": F.row_number().over(order) - 1, "_l": level, "_d": F.lead("_y").over(order) - F.col("_y")})
    auto = F.ceil(12.0 * F.pow(F.col("_n") / 100.0, F.lit(0.25))).cast("int") if max_lag is None else F.lit(max_lag)
    top = F.greatest(F.least(auto, (F.floor(F.col("_n") / 2) - extra - 1).cast("int")), F.lit(0))
    rows = rows.withColumn("_top", top)
    if max_lag is None:
        longest = rows.agg(F.max("_top")).first()[0] or 0  # one number: how many lags the plan has
    else:
        longest = max_lag
    rows = rows.withColumns({f"_d{k}": F.lag("_d", k).over(order) for k in range(1, longest + 1)}).withColumn("_d0", F.col("_d"))
    used = (F.col("_t") >= F.col("_top")) & F.col("_d").isNotNull()
    sums = lambda of: F.array(*[F.sum(F.when(used, of(F.col(f"_d{k}")))) for k in range(longest + 1)])
    l, t, d = F.col("_l"), F.col("_t").cast("double"), F.col("_d")
    one = lambda x: F.sum(F.when(used, x))
    back = F.col("_n") - 2 - F.col("_t")
    ends = lambda keep, value: F.transform(F.array_sort(F.collect_list(F.when(keep & d.isNotNull(), F.struct("_t", value.alias("v"))))), lambda s: s["v"])
    return rows.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.max("_top").alias("_top"), (F.max("_y") - F.min("_y")).alias("_range"),
        sums(lambda x: d * x).alias("_dd"), sums(lambda x: l * x).alias("_ld"), sums(lambda x: x).alias("_sd"), sums(lambda x: t * x).alias("_td"),
        F.array(one(F.lit(1.0)), one(t), one(l)).alias("_s1"), F.array(one(t * t), one(t * l), one(l * l)).alias("_s2"),
        ends(F.col("_t") < F.col("_top"), d).alias("_head"), ends(F.col("_t") < F.col("_top"), l).alias("_first"), ends(back < F.col("_top"), d).alias("_tail"),
    )


def _adf_matrix(extra: int) -> Column:
    """Products of constant, trend, level, lagged differences and the difference itself (last), as a flat array."""
    top, size = F.col("_top"), F.col("_m")

    def differences(i: Column, j: Column) -> Column:
        """Sum of d[t - i] * d[t - j] over the rows, i <= j, from the sum of its distance and both ends."""
        gap = j - i
        gained = F.when(i > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(0.0), lambda a, s: a + F.get("_head", top - s) * F.get("_head", top - s - gap)
            - F.get("_tail", top - s) * F.get("_tail", top - s - gap))).otherwise(0.0)
        return F.get("_dd", gap) + gained

    def entry(k: Column) -> Column:
        q = k % size
        p = ((k - q) / size).cast("int")
        lag = lambda x: F.when(x == size - 1, 0).otherwise(x - extra)
        lo, hi = F.least(p, q), F.greatest(p, q)
        with_lag = F.when(lo == extra, F.get("_ld", lag(hi)))
        small = F.when((lo == extra) & (hi == extra), F.get("_s2", F.lit(2)))
        if extra >= 1:
            with_lag = with_lag.when(lo == 0, F.get("_sd", lag(hi)))
            small = small.when((lo == 0) & (hi == extra), F.get("_s1", F.lit(2))).when((lo == 0) & (hi == 0), F.get("_s1", F.lit(0)))
        if extra == 2:
            with_lag = with_lag.when(lo == 1, F.get("_td", lag(hi)))
            small = small.when((lo == 1) & (hi == extra), F.get("_s2", F.lit(1))).when((lo == 1) & (hi == 1), F.get("_s2", F.lit(0))).when((lo == 0) & (hi == 1), F.get("_s1", F.lit(1)))
        a, b = F.least(lag(p), lag(q)), F.greatest(lag(p), lag(q))
        return F.when(hi <= extra, small).when(lo <= extra, with_lag).otherwise(differences(a, b))

    return F.transform(F.sequence(F.lit(0), size * size - 1), entry)


def _adf_earlier(extra: int) -> Column:
    """The matrix with the rows between the chosen and the largest lag added: the final fit uses all rows it can."""
    size, best = F.col("_m"), F.col("_best")

    def value(x: Column, t: Column) -> Column:
        lag = F.when(x == size - 1, 0).otherwise(x - extra)
        out = F.when(x == extra, F.get("_first", t))
        if extra >= 1:
            out = out.when(x == 0, 1.0)
        if extra == 2:
            out = out.when(x == 1, t.cast("double"))
        # Lags beyond the chosen one are not read.
        return out.when(lag > best, 0.0).otherwise(F.get("_head", t - lag))

    def entry(v: Column, k: Column) -> Column:
        q = k % size
        p = ((k - q) / size).cast("int")
        more = F.aggregate(F.sequence(best, F.greatest(F.col("_top") - 1, best)), F.lit(0.0), lambda a, t: a + value(p, t) * value(q, t))
        return v + F.when(best < F.col("_top"), more).otherwise(0.0)

    return F.transform("_g", entry)


def adf_test(df: DataFrame, spec: PanelSpec, col: str | None = None, regression: str = "c", max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller per key: statistic, lag of smallest AIC, critical values, 5 % verdict.

    Sums of lagged products are aggregates; the fits of all lag orders follow from them by sweeping one lag after the other
    into the regression, so every order is judged from one pass over the rows. Below ten observations or for a constant
    series only ``n_obs`` and ``error`` are set.
    """
    col = col or spec.target_col
    extra = {"n": 0, "c": 1, "ct": 2}[regression]
    sums = _adf_sums(df, spec, col, extra, max_lag)
    enough = (F.col("_n") >= 10) & (F.col("_range") > 0)
    size, last = F.col("_m"), F.col("_m") - 1
    fit = sums.withColumn("_m", F.col("_top") + extra + 2).withColumn("_g", F.when(enough, _adf_matrix(extra)))
    fit = fit.withColumn("_diag", diagonal(F.col("_g"), size))
    base = F.sequence(F.lit(0), F.lit(extra))
    rows = (F.col("_n") - 1 - F.col("_top")).cast("double")

    def judged(acc: Column, k: Column) -> Column:
        p = k + extra
        pivot = at(acc["g"], size, p, p)
        gain = F.when((k > 0) & usable(pivot, F.get("_diag", p)), at(acc["g"], size, last, p) * at(acc["g"], size, p, last) / pivot).otherwise(0.0)
        # The swept half of the matrix changes sign, the products with the target do not.
        rss = at(acc["g"], size, last, last) - gain
        params = k + extra + 1
        aic = rows * (F.log(2 * math.pi * rss / rows) + 1) + 2 * params
        better = (rss > 1e-14 * F.get("_diag", last)) & (rows > params) & (aic < acc["aic"])
        g = F.when(k > 0, sweep(acc["g"], size, p, F.col("_diag"))).otherwise(acc["g"])
        return F.struct(g.alias("g"), F.when(better, k).otherwise(acc["best"]).alias("best"), F.when(better, aic).otherwise(acc["aic"]).alias("aic"))

    start = F.struct(sweep_all(F.col("_g"), size, base, F.col("_diag")).alias("g"), F.lit(0).alias("best"), F.lit(float("inf")).alias("aic"))
    fit = fit.withColumn("_best", F.aggregate(F.sequence(F.lit(0), F.col("_top")), start, judged)["best"])
    fit = fit.withColumn("_g", _adf_earlier(extra)).withColumn("_diag", diagonal(F.col("_g"), size))
    chosen = F.sequence(F.lit(0), F.col("_best") + extra)
    done = fit.withColumn("_g", sweep_all(F.col("_g"), size, chosen, F.col("_diag")))
    n_used = F.col("_n") - 1 - F.col("_best")
    dof = n_used - F.col("_best") - extra - 1
    variance = at(F.col("_g"), size, last, last) / dof * at(F.col("_g"), size, F.lit(extra), F.lit(extra))
    stat = F.when((dof > 0) & (variance > 0), at(F.col("_g"), size, F.lit(extra), last) / F.sqrt(variance))
    reason = F.when(F.col("_n") < 10, "fewer than 10 observations").when(~enough, "constant series")
    tested = done.select(
        *spec.key_cols, F.when(enough, stat).alias("statistic"), F.when(enough, F.col("_best")).alias("used_lag"),
        F.when(enough, n_used).otherwise(F.col("_n")).cast("int").alias("n_obs"), reason.alias("error"),
    )
    empty = df.select(*spec.key_cols).distinct()
    tested = join_on_keys(empty, tested, spec.key_cols)
    tested = tested.withColumns({"n_obs": F.coalesce("n_obs", F.lit(0)), "error": F.when(F.col("n_obs").isNull(), "fewer than 10 observations").otherwise(F.col("error"))})
    n = F.col("n_obs").cast("double")
    crit = {
        level: sum((F.lit(c) / F.pow(n, F.lit(float(i))) for i, c in enumerate(coef)), F.lit(0.0))
        for level, coef in zip(("1pct", "5pct", "10pct"), ADF_SURFACE[regression], strict=True)
    }
    return tested.withColumns({f"critical_{k}": F.when(F.col("error").isNull(), v) for k, v in crit.items()}).withColumn(
        "stationary", F.col("statistic") < F.col("critical_5pct")
    )


def stationarity_report(df: DataFrame, spec: PanelSpec, col: str | None = None) -> DataFrame:
    """Combined ADF and KPSS verdict per key."""
    a = adf_test(df, spec, col).select(*spec.key_cols, F.col("statistic").alias("adf_statistic"), F.col("stationary").alias("adf_stationary"))
    k = kpss_test(df, spec, col).select(*spec.key_cols, F.col("statistic").alias("kpss_statistic"), F.col("stationary").alias("kpss_stationary"))
    both = join_on_keys(a, k, spec.key_cols)
    u, v = F.col("adf_stationary"), F.col("kpss_stationary")
    verdict = (
        F.when(u & v, "stationary")
        .when(~u & ~v, "non-stationary")
        .when(u & ~v, "difference-stationary")
        .when(~u & v, "trend-stationary")
    )
    return both.withColumn("verdict", verdict)


# --- decomposition ---------------------------------------------------------------------

def fill_both_ways(df: DataFrame, spec: PanelSpec, col: str) -> DataFrame:
    return df.withColumn(col, F.coalesce(previous_value(F.col(col), spec), next_value(F.col(col), spec)))


def seasonal_decompose(df: DataFrame, spec: PanelSpec, period: int, model: str = "additive", extrapolate: bool = True) -> DataFrame:
    """Adds ``trend``, ``seasonal``, ``resid`` by centred moving averages.

    ``extrapolate`` continues the trend at both edges along the line fitted to
    its nearest ``period`` values; otherwise edges are null and rows without a
    value are left out. A key with values for less than two periods keeps its rows,
    with nulls and the reason in ``error``.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError("model must be 'additive' or 'multiplicative'")
    add = model == "additive"
    y = F.col(spec.target_col)
    keys = list(spec.key_cols)
    w, per = spec.in_order(), spec.per_key()
    filled = fill_both_ways(df, spec, spec.target_col) if extrapolate else df
    filled = filled.withColumn("_n", F.count(y).over(per))
    if not extrapolate:
        filled = filled.filter(y.isNotNull() | (F.col("_n") == 0))
    enough = F.col("_n") >= 2 * period
    base = filled.withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
    half = period // 2
    frame = w.rowsBetween(-half, half)
    full = F.count(y).over(frame) == 2 * half + 1
    total = F.sum(y).over(frame)
    if period % 2 == 0:
        # Ends of the 2 x m average carry half weight.
        total = total - (F.lag(y, half).over(w) + F.lead(y, half).over(w)) / 2
    base = base.withColumn("trend", F.when(full & enough, total / period))
    if extrapolate:
        n, i = F.col("_n"), F.col("_i")
        known = F.col("trend").isNotNull()
        # Lines use the `period` known values next to the edge; the last known one is left out.
        back = n - 1 - half
        head = known & (i < F.least(F.lit(half + period), back))
        tail = known & (i >= back - period) & (i < back)

        def line(inside: Column) -> tuple[Column, Column]:
            t, x = F.when(inside, F.col("trend")), F.when(inside, i)
            slope = F.try_divide(F.covar_pop(t, x).over(per), F.var_pop(x).over(per))
            return slope, F.avg(t).over(per) - slope * F.avg(x).over(per)

        (hs, hi), (ts, ti) = line(head), line(tail)
        base = base.withColumn("_head", hs * i + hi).withColumn("_tail", ts * i + ti)
        base = base.withColumn("trend", F.coalesce("trend", F.when(i < half, F.col("_head")).otherwise(F.col("_tail"))))
    base = base.withColumn("trend", F.when(enough, F.col("trend")))
    free = y - F.col("trend") if add else y / F.col("trend")
    base = base.withColumn("_slot", F.pmod(F.col("_i").cast("int"), F.lit(period))).withColumn("_free", free)
    # Slot means: one row per key and slot, re-centred over the key.
    means = base.groupBy(*keys, "_slot").agg(F.avg("_free").alias("_m"))
    level = F.avg("_m").over(Window.partitionBy(*keys))
    means = means.withColumn("seasonal", F.col("_m") - level if add else F.col("_m") / level).drop("_m")
    out = join_on_keys(base, means, [*keys, "_slot"])
    seasonal, trend = F.col("seasonal"), F.col("trend")
    resid = y - trend - seasonal if add else y / seasonal / trend
    error = F.when(~enough, "fewer than two periods of values").alias("error")
    return out.withColumn("resid", resid).select(*df.columns, "trend", "seasonal", "resid", error)


def seasonal_strength(decomposed: DataFrame, spec: PanelSpec, ddof: int = 1) -> DataFrame:
    """Trend and seasonal strength per key on the rows with a residual."""
    var = F.var_samp if ddof == 1 else F.var_pop
    rows = decomposed.filter(F.col("resid").isNotNull())

    def strength(part: str) -> Column:
        ratio = F.try_divide(var("resid"), var(F.col(part) + F.col("resid")))
        return F.coalesce(F.greatest(F.lit(0.0), 1 - ratio), F.lit(0.0))

    return rows.groupBy(*spec.key_cols).agg(strength("trend").alias("trend_strength"), strength("seasonal").alias("seasonal_strength"))


def seasonally_adjusted(decomposed: DataFrame, spec: PanelSpec) -> DataFrame:
    return decomposed.withColumn("adjusted", F.col(spec.target_col) - F.col("seasonal"))


def _loess(y: np.ndarray, span: int, at: np.ndarray, weights: np.ndarray, degree: int = 1) -> np.ndarray:
    """Local regression of evenly spaced ``y`` at positions ``at`` (may lie outside)."""
    n = len(y)
    x = np.arange(n, dtype=float)
    k = min(span, n)
    first = np.clip(np.floor(at - (k - 1) / 2.0 + 0.5).astype(int), 0, n - k)
    idx = first[:, None] + np.arange(k)[None, :]
    dist = np.abs(x[idx] - at[:, None])
    reach = np.maximum(at - x[first], x[first + k - 1] - at)
    if span > n:
        reach = reach + (span - n) // 2
    u = dist / np.maximum(reach, 1e-12)[:, None]
    wt = np.where(u <= 0.001, 1.0, np.where(u < 0.999, (1 - u**3) ** 3, 0.0)) * weights[idx]
    total = wt.sum(axis=1)
    wt = wt / np.where(total > 0, total, 1.0)[:, None]
    if degree > 0:
        centre = (wt * x[idx]).sum(axis=1)
        off = x[idx] - centre[:, None]
        spread = (wt * off**2).sum(axis=1)
        ok = np.sqrt(spread) > 0.001 * (n - 1)
        slope = np.where(ok, (at - centre) / np.where(ok, spread, 1.0), 0.0)
        wt = wt * (1 + slope[:, None] * off)
    return np.where(total > 0, (wt * y[idx]).sum(axis=1), np.nan)


def _moving_average(y: np.ndarray, m: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([[0.0], y]))
    return (c[m:] - c[:-m]) / m


def stl_arrays(y: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, robust: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal of one series by seasonal-trend LOESS (Cleveland et al. 1990)."""
    n = len(y)
    if trend is None:
        trend = int(math.ceil(1.5 * period / (1 - 1.5 / seasonal)))
        trend += trend % 2 == 0
    low = period + 1 if period % 2 == 0 else period + 2
    rw, t, s = np.ones(n), np.zeros(n), np.zeros(n)
    inner, outer = (2, 15) if robust else (5, 0)
    for round_ in range(outer + 1):
        for _ in range(inner):
            free = y - t
            cyc = np.empty(n + 2 * period)
            for p in range(period):
                sub, wsub = free[p::period], rw[p::period]
                fit = _loess(sub, seasonal, np.arange(-1, len(sub) + 1, dtype=float), wsub)
                cyc[p :: period][: len(fit)] = fit
            smooth = _moving_average(_moving_average(_moving_average(cyc, period), period), 3)
            smooth = _loess(smooth, low, np.arange(n, dtype=float), np.ones(len(smooth)))
            s = cyc[period : period + n] - smooth
            t = _loess(y - s, trend, np.arange(n, dtype=float), rw)
        if round_ < outer:
            r = np.abs(y - t - s)
            h = 6 * np.median(r)
            rw = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / h) ** 2) ** 2, 0.0)) if h > 0 else np.ones(n)
    return t, s


def _local_lines(span: int, length: int, before: int, after: int) -> np.ndarray:
    """Weights of the values in the fitted value, for positions from ``-before`` to ``length - 1 + after``: local lines are linear in them."""
    at_ = np.arange(-before, length + after, dtype=float)
    return np.column_stack([_loess(unit, span, at_, np.ones(length)) for unit in np.eye(length)])


def _doubles(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in np.ravel(values)])


def _smoothed(value: Callable[[Column], Column], length: Column, position: Column, span: int, outside: int) -> Column:
    """The local line of ``span`` (odd) values at a position of a series with at least as many, up to ``outside`` beyond its ends.

    Weights depend on the distance from the nearer end only, so one row of them serves all positions inside.
    """
    half = span // 2
    wide = _local_lines(span, 2 * span, outside, 0)[: half + 1 + outside]
    first = [max(i - outside - half, 0) for i in range(half + 1 + outside)]
    table = _doubles(np.stack([row[f : f + span] for row, f in zip(wide, first, strict=True)]))
    from_end = length - 1 - position
    row = F.least(position, from_end, F.lit(half)) + outside
    start = F.least(F.greatest(position - half, F.lit(0)), length - span)
    step = lambda acc, j: acc + F.get(table, (row * span + F.when(position > from_end, span - 1 - j).otherwise(j)).cast("int")) * value(start + j)
    return F.aggregate(F.sequence(F.lit(0), F.lit(span - 1)), F.lit(0.0), step)


def _smoothed_short(value: Callable[[Column], Column], length: Column, position: Column, span: int, least: int, outside: int) -> Column:
    """The same for series of ``least`` to ``span - 1`` values: all of them take part, with weights for every length."""
    blocks = [_local_lines(span, size, outside, outside).ravel() for size in range(least, span)]
    table, begin = _doubles(np.concatenate(blocks)), F.array(*[F.lit(int(x)) for x in np.cumsum([0, *map(len, blocks)])])
    row = F.get(begin, length - least) + (position + outside) * length
    return F.aggregate(F.sequence(F.lit(0), length - 1), F.lit(0.0), lambda acc, j: acc + F.get(table, (row + j).cast("int")) * value(j))


def _line(value: Callable[[Column], Column], length: Column, position: Column, span: int, least: int, outside: int = 0) -> Column:
    """The local line at a position of a series with ``least`` values or more."""
    long_ = _smoothed(value, length, position, span, outside)
    return F.when(length >= span, long_).otherwise(_smoothed_short(value, length, position, span, least, outside)) if span > least else long_


def _stl_native(slim: DataFrame, spec: PanelSpec, period: int, seasonal: int, trend: int) -> DataFrame:
    """Non-robust STL as array expressions: every smoother is a linear filter, whose weights are known when the plan is made."""
    keys, y = list(spec.key_cols), spec.target_col
    low = period + 1 if period % 2 == 0 else period + 2
    rows = F.array_sort(F.collect_list(F.struct(F.col(spec.date_col).alias("d"), F.nanvl(F.col(y), F.lit(None).cast("double")).alias("v"))))
    series = slim.groupBy(*keys).agg(rows.alias("_s"))

    def over(size: Column, of: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), size - 1), of)

    def moving(values: Column, m: int, size: Column) -> Column:
        return over(size, lambda i: F.aggregate(F.slice(values, i + 1, m), F.lit(0.0), lambda acc, v: acc + v) / m)

    def cycles(free: Column, n: Column) -> Column:
        """Fits of the cycle-subseries, which begin one period before the series and end one after it."""
        def fit(i: Column) -> Column:
            p = i % period
            length = ((n - p + period - 1) / period).cast("int")
            return _line(lambda j: F.get(free, (p + j * period).cast("int")), length, ((i - p) / period).cast("int") - 1, seasonal, 2, 1)

        return over(n + 2 * period, fit)

    def line(values: Column, n: Column, span: int) -> Column:
        return over(n, lambda i: _line(lambda j: F.get(values, j), n, i, span, 2 * period))

    def round_(v: Column, n: Column, t: Column) -> Column:
        def parted(cyc: Column, smooth: Column) -> Column:
            sea = over(n, lambda i: F.get(cyc, i + period) - F.get(smooth, i))
            return let(sea, lambda s: let(F.zip_with(v, s, lambda a, b: a - b), lambda rest: F.struct(line(rest, n, trend).alias("t"), s.alias("s"))))

        def lowered(cyc: Column) -> Column:
            once = lambda use: let(moving(cyc, period, n + period + 1), use)
            return once(lambda a: let(moving(a, period, n + 2), lambda b: let(moving(b, 3, n), lambda c: let(line(c, n, low), lambda smooth: parted(cyc, smooth)))))

        return let(F.zip_with(v, t, lambda a, b: a - b), lambda free: let(cycles(free, n), lowered))

    def decomposed(v: Column) -> Column:
        zero = F.transform(v, lambda _: F.lit(0.0))
        start = F.struct(zero.alias("t"), zero.alias("s"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(5)), start, lambda acc, _: round_(v, F.size(v), acc["t"]))

    enough = (F.size("_s") >= 2 * period) & ~F.exists("_s", lambda r: r["v"].isNull())
    made = series.filter(enough).withColumn("_p", let(F.transform("_s", lambda r: r["v"]), decomposed))
    made = made.select(*keys, F.inline(F.arrays_zip("_s", F.col("_p")["t"].alias("_t"), F.col("_p")["s"].alias("_sea"))))
    made = made.select(*keys, F.col("_s.d").alias(spec.date_col), F.col("_s.v").alias(y), F.col("_t").alias("trend"), F.col("_sea").alias("seasonal"))
    made = made.withColumns({"resid": F.col(y) - F.col("trend") - F.col("seasonal"), "error": F.lit(None).cast("string")})
    none = F.lit(None).cast("double")
    rest = series.filter(~enough).select(*keys, F.inline("_s"))
    rest = rest.select(*keys, F.col("d").alias(spec.date_col), F.col("v").alias(y), none.alias("trend"), none.alias("seasonal"), none.alias("resid"), F.lit("fewer than two periods of values").alias("error"))
    return made.unionByName(rest)


def stl_decompose(df: DataFrame, spec: PanelSpec, period: int, seasonal: int = 7, trend: int | None = None, robust: bool = False) -> DataFrame:
    """Adds ``trend``, ``seasonal``, ``resid`` by LOESS.

    A key with values for less than two periods keeps its rows, with nulls and the
    reason in ``error``. Without ``robust`` no Python runs, unless ``trend`` spans
    many more values than two periods or a span is even.
    """
    filled = fill_both_ways(df, spec, spec.target_col)
    slim = filled.select(*spec.key_cols, spec.date_col, F.col(spec.target_col).cast("double").alias(spec.target_col))
    span = trend or math.ceil(1.5 * period / (1 - 1.5 / seasonal))
    span += trend is None and span % 2 == 0
    if not robust and period > 1 and span <= 2 * period + 8 and span % 2 and seasonal % 2 and seasonal > 1:
        return _stl_native(slim, spec, period, seasonal, span)
    added = [T.StructField(c, T.DoubleType()) for c in ("trend", "seasonal", "resid")] + [T.StructField("error", T.StringType())]
    schema = T.StructType(slim.schema.fields + added)
    date, target = spec.date_col, spec.target_col

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        y = pdf[target].to_numpy(dtype=float)
        if np.isnan(y).any() or len(y) < 2 * period:
            return pdf.assign(trend=np.nan, seasonal=np.nan, resid=np.nan, error="fewer than two periods of values")
        t, s = stl_arrays(y, period, seasonal, trend, robust)
        return pdf.assign(trend=t, seasonal=s, resid=y - t - s, error=None)

    made = slim.groupBy(*spec.key_cols).applyInPandas(fit, schema)
    return made.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("trend", "seasonal", "resid")})
