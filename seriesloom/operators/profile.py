"""Profiles of tables, keys and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.statistics import adjusted_kurtosis, adjusted_skewness, count_where, percent, variation
from seriesloom.operators.demand import adi, cv2
from seriesloom.operators.exact import average_rank, exact_quantiles, grouped_quantiles, running_total
from seriesloom.operators.impute import join_on_keys
from seriesloom.session import counted_parts, reliable_checkpoint
from seriesloom.spec import PanelSpec


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def label_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def inspect_data(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, non-null, missing, distinct values, an example.

    Distinct counts are exact. They come from one (column, value) aggregation,
    which a table with many columns shares, instead of one expansion of the
    whole row set per distinct aggregate; ``approximate`` replaces them by a
    fixed-size sketch in a single pass.
    """
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.col(f"`{c}`").cast("string").alias("v"))
            for i, c in enumerate(df.columns)
        ]
    )
    long = df.select(F.inline(entries))
    if approximate:
        stats = long.groupBy("pos").agg(
            F.count("*").alias("rows"),
            F.count("v").alias("non_null"),
            F.approx_count_distinct("v").alias("n_unique"),
            F.min("v").alias("example"),
        )
    else:
        values = long.groupBy("pos", "v").agg(F.count("*").alias("n"))
        stats = values.groupBy("pos").agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
            F.count("v").alias("n_unique"),
            F.min("v").alias("example"),
        )
    names = F.array(*[F.struct(F.lit(f.name).alias("c"), F.lit(f.dataType.simpleString()).alias("t")) for f in df.schema.fields])
    missing = F.col("rows") - F.col("non_null")
    return stats.select(
        names[F.col("pos")]["c"].alias("column"),
        names[F.col("pos")]["t"].alias("dtype"),
        "non_null",
        missing.alias("missing"),
        percent(missing, F.col("rows")).alias("missing_pct"),
        "n_unique",
        percent(F.col("n_unique"), F.col("rows")).alias("unique_pct"),
        "example",
    )


def summarize_keys(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per key: observations, date span, target moments, zeros and missing values."""
    y, d = F.col(spec.target_col), F.col(spec.date_col)
    stats = df.groupBy(*spec.key_cols).agg(
        F.count(d).alias("n_obs"),
        F.min(d).alias("date_min"),
        F.max(d).alias("date_max"),
        F.avg(y).alias("target_mean"),
        F.stddev_samp(y).alias("target_std"),
        F.min(y).alias("target_min"),
        F.max(y).alias("target_max"),
        F.sum(y).alias("target_sum"),
        count_where(y == 0).alias("n_zeros"),
        count_where(y.isNull()).alias("n_missing"),
    )
    n = F.col("n_obs")
    return stats.withColumns(
        {
            "span_days": F.datediff("date_max", "date_min"),
            "zero_pct": percent(F.col("n_zeros"), n),
            "missing_pct": percent(F.col("n_missing"), n),
        }
    )


def coverage_report(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row for the dataset. Keys are counted after a reduction to one row per key."""
    per_key = df.groupBy(*spec.key_cols).agg(
        F.count("*").alias("n"), F.min(spec.date_col).alias("lo"), F.max(spec.date_col).alias("hi")
    )
    total = per_key.agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("n_forecast_keys"),
        F.min("lo").alias("min_date"),
        F.max("hi").alias("max_date"),
    )
    return total.withColumns(
        {
            "total_days": F.datediff("max_date", "min_date") + 1,
            "avg_rows_per_key": F.try_divide(F.col("rows"), F.col("n_forecast_keys")),
        }
    )


def per_series_stats(df: DataFrame, spec: PanelSpec) -> DataFrame:
    y = F.col(spec.target_col)
    return df.groupBy(*spec.key_cols).agg(
        F.count("*").alias("n_obs"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        variation(y).alias("cv"),
        variation(F.when(y != 0, y)).alias("cv_nonzero"),
        F.try_divide(count_where(y == 0), F.count("*")).alias("zero_share"),
        adi(y).alias("adi"),
        cv2(y).alias("cv2"),
    )


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Moments and exact quartiles of whole columns.

    Moments are one aggregation that yields a single row; quartiles come from
    :func:`exact_quantiles`, which never orders a whole column.
    """
    cols = list(cols or numeric_columns(df))
    moments = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(c).alias("count"),
                    F.avg(c).alias("mean"),
                    F.stddev_samp(c).alias("std"),
                    F.min(F.col(c).cast("double")).alias("min"),
                    F.max(F.col(c).cast("double")).alias("max"),
                    adjusted_skewness(F.col(c)).alias("skewness"),
                    adjusted_kurtosis(F.col(c)).alias("kurtosis"),
                    variation(F.col(c)).alias("cv"),
                    percent(count_where(F.col(c) == 0), F.count(c)).alias("zero_pct"),
                )
                for c in cols
            ]
        ).alias("_m")
    ).select(F.inline("_m"))
    quartiles = (
        exact_quantiles(df, cols, [0.25, 0.5, 0.75])
        .groupBy("column")
        .agg(
            F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("p25"),
            F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"),
            F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("p75"),
        )
        .withColumn("iqr", F.col("p75") - F.col("p25"))
    )
    return moments.join(quartiles, "column")


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None, top_n: int = 5) -> DataFrame:
    """Cardinality, missing, mode and leading values of label columns.

    Values are counted first. The ``row_number <= top_n`` filter is planned as a
    group limit in every map task, so only leaders reach the final ordering.
    """
    cols = list(cols or label_columns(df))
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols]))
    )
    counts = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.count("v").alias("n_unique"),
        F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing"),
    )
    label = F.coalesce("v", F.lit("null"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), label))
    leaders = (
        counts.withColumn("r", rank)
        .filter(F.col("r") <= top_n)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("r", label.alias("label"), "n"))).alias("top"))
    )
    first = F.col("top")[0]
    return totals.join(leaders, "column").select(
        "column",
        "n_unique",
        "missing",
        first["label"].alias("mode"),
        percent(first["n"], F.col("rows")).alias("mode_share_pct"),
        F.array_join(
            F.transform("top", lambda t: F.concat(t["label"], F.lit("("), t["n"].cast("string"), F.lit(")"))), ", "
        ).alias("top_values"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def describe_by_group(df: DataFrame, group: str, col: str) -> DataFrame:
    """Count, moments and exact quartiles of one column per group of a report."""
    v = F.col(col)
    moments = df.groupBy(group).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    names = {0.25: "p25", 0.5: "median", 0.75: "p75"}
    q = grouped_quantiles(df, group, col, list(names))
    wide = q.groupBy(group).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()])
    return join_on_keys(moments, wide, [group]).select(group, "count", "mean", "std", "min", "p25", "median", "p75", "max")


def resample(df: DataFrame, spec: PanelSpec, unit: str, how: str = "sum") -> DataFrame:
    """Coarser periods (``week``, ``month``, ``quarter``, ``year``), labelled by their first day."""
    agg = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[how]
    bucket = F.trunc(spec.date_col, unit)
    return df.groupBy(*spec.key_cols, bucket.alias(spec.date_col)).agg(agg(spec.target_col).alias(spec.target_col))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Correlation of every pair of columns on the rows where both are present: ``(x, y, corr)``."""
    cols = list(cols or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if method == "pearson":
        row = df.agg(
            F.array(
                *[
                    F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr"))
                    for a, b in pairs
                ]
            ).alias("_c")
        )
        return row.select(F.inline("_c"))
    if method not in ("spearman", "kendall"):
        raise ValueError(f"unknown correlation: {method}")
    if not pairs:
        return df.sparkSession.createDataFrame([], "x string, y string, corr double")
    with counted_parts(df.sparkSession, df.count() * len(pairs)):
        # Read for the ranks and for the sums.
        cells = reliable_checkpoint(_contingency(df, pairs))
        found = reliable_checkpoint((_spearman if method == "spearman" else _kendall)(cells))
    names = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs])
    listed = df.sparkSession.range(1).select(F.posexplode(names).alias("pair", "_n")).select("pair", "_n.*")
    return listed.join(found, "pair", "left").select("x", "y", "corr")


def _contingency(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, a, b, n): distinct value pairs of all column pairs with their counts, in one pass; rows lacking either are left out."""
    cells = []
    for i, names in enumerate(pairs):
        a, b = (F.col(c).cast("double") for c in names)
        whole = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
        cells.append(F.when(whole, F.struct(F.lit(i).alias("pair"), a.alias("a"), b.alias("b"))))
    return df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("pair", "a", "b").agg(F.count("*").alias("n"))


def _margins(cells: DataFrame) -> DataFrame:
    """(pair, side, v, m): the values of both sides of every pair with their counts."""
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in ("a", "b")])
    return cells.select("pair", "n", F.inline(sides)).groupBy("pair", "side", "v").agg(F.sum("n").alias("m"))


def _spearman(cells: DataFrame) -> DataFrame:
    """Pearson correlation of average ranks per pair, on distinct value pairs with their counts.

    One rank index holds both sides of all pairs.
    """
    index = average_rank(_margins(cells), "v", "m", "rank", ["pair", "side"])
    for c in ("a", "b"):
        own = index.where(F.col("side") == c).select("pair", F.col("v").alias(c), F.col("rank").alias(f"r{c}"))
        cells = cells.join(own, ["pair", c])
    n, x, y = F.sum("n"), F.sum(F.col("n") * F.col("ra")), F.sum(F.col("n") * F.col("rb"))
    sums = cells.groupBy("pair").agg(
        n.alias("n"), x.alias("x"), y.alias("y"),
        F.sum(F.col("n") * F.col("ra") * F.col("ra")).alias("xx"),
        F.sum(F.col("n") * F.col("rb") * F.col("rb")).alias("yy"),
        F.sum(F.col("n") * F.col("ra") * F.col("rb")).alias("xy"),
    )
    return sums.selectExpr("pair", "try_divide(n*xy - x*y, sqrt(n*xx - x*x) * sqrt(n*yy - y*y)) AS corr")


def _kendall(cells: DataFrame) -> DataFrame:
    """Kendall tau-b per pair from counts of concordant pairs of rows, without forming them.

    Two cells with different ``b`` differ first at one bit of the dense rank of
    ``b``. Per bit and shared higher bits, the pairs ordered by ``a`` are counted
    with running sums: n log n work. Running sums stay inside the rank index's
    stretches of ``a``, so that the level where all cells share one group is not one task.
    """
    index = running_total(_margins(cells), ["v"], None, "dense", ["pair", "side"], keep_part=True)
    sides = {c: index.where(F.col("side") == c) for c in ("a", "b")}
    cells = cells.join(sides["b"].select("pair", F.col("v").alias("b"), F.col("dense").alias("rb")), ["pair", "b"])
    cells = cells.join(sides["a"].select("pair", F.col("v").alias("a"), F.col("_part").alias("slice")), ["pair", "a"])
    # A row for each pair: as many levels as its highest rank has bits.
    top = sides["b"].groupBy("pair").agg(F.length(F.bin(F.max("dense"))).alias("_bits"))
    bits = F.transform(
        F.sequence(F.lit(0), F.col("_bits") - 1),
        lambda k: F.struct(
            k.alias("level"),
            F.call_function("shiftright", F.col("rb"), k + 1).alias("prefix"),
            F.call_function("shiftright", F.col("rb"), k).bitwiseAND(F.lit(1)).cast("int").alias("bit"),
        ),
    )
    levels = cells.join(F.broadcast(top), "pair").select("pair", "a", "slice", "n", F.inline(bits))
    group = ["pair", "level", "prefix"]
    grouped = levels.groupBy(*group, "slice", "a").agg(
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("ones"),
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("zeros"),
    )
    within = Window.partitionBy(*group, "slice").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    local = grouped.withColumn("z0", F.coalesce(F.sum("zeros").over(within), F.lit(0))).withColumn(
        "o0", F.coalesce(F.sum("ones").over(within), F.lit(0))
    )
    slices = local.groupBy(*group, "slice").agg(
        F.sum("zeros").alias("z"), F.sum("ones").alias("o"),
        F.sum(F.col("ones") * F.col("z0")).alias("up"), F.sum(F.col("zeros") * F.col("o0")).alias("down"),
    )
    across = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("zb", F.coalesce(F.sum("z").over(across), F.lit(0))).withColumn(
        "ob", F.coalesce(F.sum("o").over(across), F.lit(0))
    )
    concord = carried.groupBy("pair").agg(
        F.sum(F.col("up") + F.col("o") * F.col("zb")).cast("double").alias("con"),
        F.sum(F.col("down") + F.col("z") * F.col("ob")).cast("double").alias("dis"),
    )
    tied = lambda c: F.sum(F.when(F.col("side") == c, F.col("m") * (F.col("m") - 1) / 2.0))
    ties = index.groupBy("pair").agg(tied("a").alias("ta"), tied("b").alias("tb"), F.sum(F.when(F.col("side") == "a", F.col("m"))).cast("double").alias("na"))
    return concord.join(ties, "pair").selectExpr("pair", "try_divide(con - dis, sqrt(na*(na-1)/2 - ta) * sqrt(na*(na-1)/2 - tb)) AS corr")
