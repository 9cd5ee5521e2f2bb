"""Demand pattern classes from interval (ADI) and size variability (CV²)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.statistics import count_where, variation
from seriesloom.operators.impute import join_on_keys
from seriesloom.spec import PanelSpec

# Class boundaries.
ADI_THRESHOLD = 1.32
CV2_THRESHOLD = 0.49

INFINITY = float("inf")


def adi(y: Column) -> Column:
    """Periods per period with demand: infinite without demand, null without data."""
    periods, active = F.count(y), count_where(y != 0)
    return F.when(periods == 0, None).when(active == 0, INFINITY).otherwise(F.try_divide(periods, active))


def cv2(y: Column) -> Column:
    """Squared variation of non-zero demand; null below two demands."""
    return F.pow(variation(F.when(y != 0, y)), F.lit(2.0))


def _quadrant(interval: Column, size: Column, adi_cut: float, cv2_cut: float) -> Column:
    calm = size < cv2_cut
    return (
        F.when((interval < adi_cut) & calm, "smooth")
        .when(interval < adi_cut, "erratic")
        .when(calm, "intermittent")
        .otherwise("lumpy")
    )


def sb_classify(
    interval: Column, size: Column, adi_threshold: float = ADI_THRESHOLD, cv2_threshold: float = CV2_THRESHOLD
) -> Column:
    """Class of an (ADI, CV²) pair; a series without demand is ``no_demand``."""
    return (
        F.when(interval == INFINITY, "no_demand")
        .when(interval.isNull() | size.isNull(), "undefined")
        .otherwise(_quadrant(interval, size, adi_threshold, cv2_threshold))
    )


def classify_all_series(
    df: DataFrame, spec: PanelSpec, adi_threshold: float = ADI_THRESHOLD, cv2_threshold: float = CV2_THRESHOLD
) -> DataFrame:
    """One aggregation: n_obs, zero_share, adi, cv2 and sb_class per key."""
    y = F.col(spec.target_col)
    stats = df.groupBy(*spec.key_cols).agg(
        F.count(y).alias("n_obs"),
        F.try_divide(count_where(y == 0), F.count("*")).alias("zero_share"),
        adi(y).alias("adi"),
        cv2(y).alias("cv2"),
    )
    return stats.withColumn("sb_class", sb_classify(F.col("adi"), F.col("cv2"), adi_threshold, cv2_threshold))


def classification_summary(classes: DataFrame, column: str = "sb_class") -> DataFrame:
    """Series and share per class. The window runs over one row per class."""
    counts = classes.groupBy(column).agg(F.count("*").alias("n_series"))
    total = F.sum("n_series").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", F.col("n_series") * 100.0 / total)


def classify_demand(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Variant for forecasting panels: positive demand only, population deviation,
    and a key without demand counts as Intermittent."""
    y = F.col(spec.target_col)
    sold = F.when(y > 0, y)
    stats = df.groupBy(*spec.key_cols).agg(
        F.when(F.count(sold) == 0, INFINITY).otherwise(F.try_divide(F.count("*"), F.count(sold))).alias("ADI"),
        F.coalesce(F.pow(F.try_divide(F.stddev_pop(sold), F.avg(sold)), F.lit(2.0)), F.lit(0.0)).alias("CV2"),
        F.avg(y).alias("mean_demand"),
        F.try_divide(count_where(y == 0), F.count("*")).alias("zero_share"),
    )
    pattern = F.initcap(_quadrant(F.col("ADI"), F.col("CV2"), ADI_THRESHOLD, CV2_THRESHOLD))
    return stats.withColumn("pattern", pattern)


def classify_demand_pattern(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Variant for single series: negative demand is flagged in ``error`` and fewer
    than two demands are ``insufficient_data``."""
    y = F.col(spec.target_col)
    sold = F.when(y > 0, y)
    stats = df.groupBy(*spec.key_cols).agg(
        F.count(y).alias("n_obs"),
        F.count(sold).alias("n_nonzero"),
        variation(sold).alias("_cv"),
        count_where(y < 0).alias("_negative"),
    )
    n, active = F.col("n_obs"), F.col("n_nonzero")
    negative, enough = F.col("_negative") > 0, active >= 2
    measured = stats.select(
        *spec.key_cols,
        "n_obs",
        "n_nonzero",
        F.when(negative, None).when(enough, F.try_divide(n, active)).otherwise(INFINITY).alias("ADI"),
        F.when(~negative & enough, F.col("_cv") * F.col("_cv")).alias("CV2"),
        F.when(~negative, F.try_divide((n - active) * 100.0, n)).alias("pct_zero"),
        F.when(negative, "negative demand").alias("error"),
    )
    quadrant = _quadrant(F.col("ADI"), F.col("CV2"), ADI_THRESHOLD, CV2_THRESHOLD)
    return measured.withColumn(
        "category",
        F.when(F.col("error").isNotNull(), None).when(~enough, "insufficient_data").otherwise(quadrant),
    )


# Training objective per demand class.
OBJECTIVES = {"smooth": "regression", "erratic": "huber", "intermittent": "tweedie", "lumpy": "tweedie"}

STRATEGIES = {
    "smooth": "exponential smoothing or regression; score with MAE and RMSE",
    "erratic": "variance-stabilising transform, robust or quantile regression",
    "intermittent": "Croston family or compound counts; do not score with MAPE",
    "lumpy": "bias-corrected Croston or TSB; consider forecasting at a coarser level",
    "no_demand": "forecast zero until outside information says otherwise",
    "undefined": "too few demands to choose",
}

# Training losses: common name, domain of the target, when each applies, and its risk.
LOSSES = [
    ("regression_l2", "squared error", "regression", "real", "steady demand with symmetric errors", "a few outliers dominate the fit"),
    ("regression_l1", "absolute error", "regression_l1", "real", "heavy tails, median forecasts", "forecasts of sparse demand become zero"),
    ("huber", "Huber", "huber", "real", "mostly steady demand with some outliers", "the turning point has to be tuned"),
    ("poisson", "Poisson deviance", "poisson", "count", "counts whose variance is near the mean", "too narrow where the variance is larger"),
    ("tweedie", "Tweedie deviance", "tweedie", "non-negative", "many zeros and a long right tail", "the variance power has to be tuned between 1 and 2"),
    ("quantile", "pinball loss", "quantile", "real", "intervals and service levels", "quantiles of separate fits may cross"),
]


def _lookup(column: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.lower(column)]


def recommend_strategy(sb_class: Column) -> Column:
    return F.coalesce(_lookup(sb_class, STRATEGIES), F.lit("unknown class"))


def recommend_loss(pattern: Column) -> Column:
    """Objective name of a class; null for an unknown class."""
    return _lookup(pattern, OBJECTIVES)


def loss_catalog(spark) -> DataFrame:
    return spark.createDataFrame(LOSSES, "loss string, name string, objective string, domain string, use_when string, watch_out string")


def pick_personas(summary: DataFrame, keys: Sequence[str], length: str, zeros: str) -> DataFrame:
    """Keys to look at first: the longest, the one of median length, the one with most zeros.

    Extremes are aggregates; the median key is found by a distributed rank.
    """
    from seriesloom.operators.exact import running_total

    ident = F.struct(*keys)
    ends = summary.agg(
        F.min_by(ident, F.struct(-F.col(length), ident)).alias("longest"),
        F.min_by(ident, F.struct(-F.col(zeros), ident)).alias("most_zeros"),
        F.count("*").alias("_n"),
    )
    ranked = running_total(summary.select(F.col(length).alias("_len"), *keys), ["_len", *keys], None, "_rank")
    middle = ranked.join(F.broadcast(ends.select("_n"))).filter(
        F.col("_rank") == F.floor(F.col("_n") / 2) + 1
    )
    tagged = ends.select(F.explode(F.create_map(F.lit("longest"), "longest", F.lit("most_zeros"), "most_zeros")).alias("persona", "_k"))
    return tagged.select("persona", "_k.*").unionByName(middle.select(F.lit("median_length").alias("persona"), *keys))


def median_length_per_class(classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key of middle length within each class.

    Per class only the number of keys of each length is ordered; the key itself
    is picked from the rows of the chosen length.
    """
    lengths = classes.groupBy("sb_class", "n_obs").agg(F.count("*").alias("_n"))
    cls = Window.partitionBy("sb_class")
    upto = F.sum("_n").over(cls.orderBy("n_obs").rowsBetween(Window.unboundedPreceding, 0))
    placed = lengths.withColumn("_upto", upto).withColumn("_mid", F.floor(F.sum("_n").over(cls) / 2) + 1)
    chosen = placed.filter((F.col("_upto") >= F.col("_mid")) & (F.col("_upto") - F.col("_n") < F.col("_mid")))
    hits = join_on_keys(classes.select("sb_class", "n_obs", *keys), chosen.select("sb_class", "n_obs"), ["sb_class", "n_obs"], "left_semi")
    return hits.groupBy("sb_class", "n_obs").agg(F.min(F.struct(*keys)).alias("_k")).select("sb_class", "n_obs", "_k.*")
