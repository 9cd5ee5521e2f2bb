"""Edge series, invariants and parity with pandas on small panels."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom import PanelSpec, make_spec
from seriesloom.functions import metrics as M
from seriesloom.operators import (
    additive, chartdata, demand, encode, exact, explain, features, forecast, grid, impute, learners, outliers, profile,
    quality, recurrence, scoring, select, splits, transforms, tsstats, tuning, windows,
)
from seriesloom.plans import subset
from seriesloom.sources import readers, writers

D = dt.date
SPEC = PanelSpec("d", "y", ("k",), ("s",), ("x",), "D")
SCHEMA = "k string, d date, y double, s string, x double"


def day(i):
    return D(2024, 1, 1) + dt.timedelta(days=i)


EDGE = {
    "empty": [(0, None), (1, None)],
    "one": [(0, 5.0)],
    "zeros": [(i, 0.0) for i in range(5)],
    "single_nz": [(i, 7.0 if i == 3 else 0.0) for i in range(6)],
    "gap": [(0, 1.0), (1, 2.0), (5, 6.0), (6, 7.0)],
    "null_target": [(0, 1.0), (1, None), (2, 3.0)],
    "lead_null": [(0, None), (1, 4.0), (2, 5.0)],
    "tail_null": [(0, 4.0), (1, 5.0), (2, None)],
    "dup": [(0, 1.0), (0, 2.0), (1, 3.0)],
    "neg": [(0, -1.0), (1, 2.0), (2, 3.0)],
    "const": [(i, 4.0) for i in range(6)],
    None: [(0, 1.0), (2, 3.0)],
}


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(k, day(i), y, "a" if i != 1 else None, float(i)) for k, v in EDGE.items() for i, y in v]
    return spark.createDataFrame(rows, SCHEMA)


def as_map(df, value):
    return {r["k"]: r[value] for r in df.collect()}


def random_panel(spark, keys=3, n=40, seed=1, nulls=0.0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame([(f"k{k}", day(i), float(rng.poisson(3) * 10 ** (k - 1)), "s", float(i % 5)) for k in range(keys) for i in range(n)], columns=["k", "d", "y", "s", "x"])
    if nulls:
        pdf.loc[rng.random(len(pdf)) < nulls, "y"] = np.nan
    sdf = spark.createDataFrame([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)], SCHEMA)
    return pdf, sdf


def collected(df, col):
    return df.orderBy("k", "d").toPandas()[col].to_numpy(dtype=float)


def test_classes_of_edge_series(edge):
    got = as_map(demand.classify_all_series(edge, SPEC), "sb_class")
    assert got["zeros"] == "no_demand" and got["empty"] == "undefined" and got["single_nz"] == "undefined"
    assert got["const"] == "smooth" and None in got
    pattern = as_map(demand.classify_demand(edge, SPEC), "pattern")
    assert pattern["zeros"] == "Intermittent"
    single = {r["k"]: r for r in demand.classify_demand_pattern(edge, SPEC).collect()}
    assert single["neg"]["error"] and single["neg"]["category"] is None
    assert single["single_nz"]["category"] == "insufficient_data" and math.isinf(single["single_nz"]["ADI"])


def test_gap_filling_closes_every_gap_and_is_idempotent(edge):
    filled = grid.fill_time_gaps(edge, SPEC)
    gaps = as_map(quality.detect_time_gaps(filled, SPEC), "missing_dates")
    assert set(gaps.values()) == {0}
    again = grid.fill_time_gaps(filled.drop("_was_imputed"), SPEC)
    assert again.count() == filled.count() and again.filter("_was_imputed").count() == 0
    inserted = as_map(filled.groupBy("k").agg(F.count(F.when(F.col("_was_imputed"), 1)).alias("n")), "n")
    assert inserted["gap"] == 3 and inserted["null_target"] == 0 and inserted[None] == 1 and inserted["dup"] == 0


def test_gap_report(edge):
    row = {r["k"]: r for r in quality.detect_time_gaps(edge, SPEC).collect()}["gap"]
    assert (row["missing_dates"], row["first_gap"], row["last_gap"], row["expected_obs"]) == (3, day(2), day(4), 7)
    assert {r["k"] for r in quality.detect_duplicates(edge, SPEC).collect()} == {"dup"}
    audit = {r["k"]: r for r in quality.validate_panel(edge, SPEC).collect()}
    assert audit["dup"]["missing_dates"] == 0 and audit["neg"]["n_negatives"] == 1 and audit["empty"]["n_nans"] == 2


@pytest.mark.parametrize(
    "freq,start,n,alias",
    [("D", "2024-02-27", 5, "D"), ("W", "2024-01-01", 5, "W-MON"), ("W-SUN", "2024-01-07", 4, "W-SUN"), ("MS", "2023-11-01", 5, "MS"), ("M", "2024-01-31", 5, "ME"), ("QS", "2023-10-01", 4, "QS"), ("Q", "2023-12-31", 4, "QE"), ("YS", "2020-01-01", 4, "YS"), ("Y", "2019-12-31", 4, "YE"), ("B", "2024-01-04", 6, "B")],
)
def test_frequencies_follow_pandas(spark, freq, start, n, alias):
    spec = PanelSpec("d", "y", ("k",), frequency=freq)
    df = spark.createDataFrame([("a", D.fromisoformat(start), 1.0)], "k string, d date, y double")
    got = [r["d"] for r in grid.future_dates(df, spec, n).orderBy("horizon").collect()]
    assert got == [t.date() for t in pd.date_range(start, periods=n + 1, freq=alias)[1:]]


def test_hourly_grid(spark):
    spec = PanelSpec("d", "y", ("k",), frequency="H")
    df = spark.sql("SELECT 'a' k, d, 1.0D y FROM VALUES (TIMESTAMP_NTZ'2024-01-01 22:00:00'), (TIMESTAMP_NTZ'2024-01-02 01:00:00') AS t(d)")
    assert [r["d"].hour for r in grid.fill_time_gaps(df, spec).orderBy("d").collect()] == [22, 23, 0, 1]


def test_dates_off_the_grid_are_rejected(spark):
    spec = PanelSpec("d", "y", ("k",), frequency="MS")
    df = spark.createDataFrame([("a", D(2024, 1, 31), 1.0), ("a", D(2024, 3, 1), 1.0)], "k string, d date, y double")
    with pytest.raises(Exception, match="off the MS grid"):
        grid.fill_time_gaps(df, spec).collect()


@pytest.mark.parametrize("method", ["linear", "ffill", "bfill", "mean", "median", "rolling_mean", "rolling_median", "seasonal_naive_7", "mode"])
def test_imputation_follows_pandas(spark, method):
    pdf, sdf = random_panel(spark, nulls=0.3)
    got = collected(impute.impute_missing(sdf, SPEC, "y", method), "y")
    rules = {
        "linear": lambda s: s.interpolate(limit_direction="both"), "ffill": lambda s: s.ffill(), "bfill": lambda s: s.bfill(),
        "mean": lambda s: s.fillna(s.mean()), "median": lambda s: s.fillna(s.median()), "mode": lambda s: s.fillna(s.mode().iloc[0]),
        "rolling_mean": lambda s: s.fillna(s.rolling(7, min_periods=1).mean()), "rolling_median": lambda s: s.fillna(s.rolling(7, min_periods=1).median()),
        "seasonal_naive_7": lambda s: s.fillna(s.shift(7)).ffill().bfill(),
    }
    want = pdf.groupby("k")["y"].transform(rules[method]).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("alpha", [0.05, 0.6])
def test_weighted_mean_follows_pandas_over_many_blocks(spark, adjust, alpha):
    pdf, sdf = random_panel(spark, keys=2, n=4000, nulls=0.2, seed=3)
    got = collected(recurrence.ewm_mean(sdf, SPEC, F.col("y"), alpha, "m", adjust), "m")
    want = pdf.groupby("k")["y"].transform(lambda s: s.ewm(alpha=alpha, adjust=adjust).mean()).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_rolling_features_follow_pandas_and_stay_in_their_key(spark):
    pdf, sdf = random_panel(spark)
    stats = ["mean", "std", "min", "max", "median", "sum", "var", "skew", "kurt"]
    out = windows.add_rolling_features(sdf, SPEC, windows=(7,), stats=stats)
    for s in stats:
        want = pdf.groupby("k")["y"].transform(lambda v, s=s: getattr(v.shift(1).rolling(7, min_periods=1), s)()).to_numpy()
        np.testing.assert_allclose(collected(out, f"y_roll_{s}_7"), want, rtol=1e-6, atol=1e-6)
    alone = windows.add_rolling_features(sdf.filter("k = 'k1'"), SPEC, windows=(7,), stats=["mean"])
    both = out.filter("k = 'k1'")
    np.testing.assert_array_equal(collected(alone, "y_roll_mean_7"), collected(both, "y_roll_mean_7"))


def test_features_do_not_see_their_own_row(spark):
    _, sdf = random_panel(spark)
    builder = features.FeatureBuilder(SPEC, lags=(1, 7), rolling_windows=(7,), ewm_halflives=(3.0,))
    changed = sdf.withColumn("y", F.when(F.col("d") == day(39), 1e6).otherwise(F.col("y")))
    a, b = builder.transform(sdf), builder.transform(changed)
    for c in builder.history_names:
        np.testing.assert_allclose(collected(a, c), collected(b, c), rtol=1e-9)


@pytest.mark.parametrize("block", [13, 20])
def test_blocks_give_the_same_features(spark, block):
    _, sdf = random_panel(spark, n=100)

    def build(df, spec):
        return windows.add_rolling_features(windows.add_lag_features(df, spec, lags=(1, 12)), spec, windows=(12,), stats=("mean", "std"))

    a, b = build(sdf, SPEC), windows.by_blocks(sdf, SPEC, 13, block, build)
    assert a.count() == b.count()
    for c in ("y_lag_1", "y_lag_12", "y_roll_mean_12", "y_roll_std_12"):
        np.testing.assert_allclose(collected(a, c), collected(b, c))


def test_roll_out_state_equals_window_features(spark):
    _, sdf = random_panel(spark)
    builder = features.FeatureBuilder(SPEC, lags=(1, 3), rolling_windows=(5,), rolling_stats=("mean", "std", "min", "max", "median", "sum"), ewm_halflives=(2.0,))
    history, last = sdf.filter(F.col("d") < day(39)), sdf.filter(F.col("d") == day(39))
    state = learners.RecursiveForecaster(builder)._start(history)
    ahead = state.withColumns(features.next_step_features(builder, "_recent")).withColumn("d", F.lit(day(39)))
    want = builder.transform(history.unionByName(last)).filter(F.col("d") == day(39))
    for c in builder.history_names:
        np.testing.assert_allclose(collected(ahead, c), collected(want, c), rtol=1e-9)


@pytest.mark.parametrize("probs", [[0.0, 0.25, 0.5, 1.0], [0.01, 0.99]])
def test_exact_quantiles(spark, probs):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=3000), np.zeros(3000), [np.pi]])
    df = spark.createDataFrame([(float(v), float(v) ** 2) for v in values], "a double, b double")
    got = {(r["column"], r["prob"]): r["value"] for r in exact.exact_quantiles(df, ["a", "b"], probs).collect()}
    for c, v in (("a", values), ("b", values**2)):
        for p in probs:
            assert got[c, p] == pytest.approx(np.quantile(v, p), abs=1e-12)


@pytest.mark.parametrize("most", [5, 50, 10**6])
def test_quantile_rounds_reach_the_value(spark, monkeypatch, most):
    """Brackets narrow to a stated size on ties at both ends, extremes and all-distinct values, and no window is used."""
    monkeypatch.setattr(exact, "FINAL_VALUES", most)
    monkeypatch.setattr(exact, "SKETCH_ACCURACY", 100)
    rng = np.random.default_rng(7)
    columns = {
        "ties": np.repeat([1.0, 2.0], 2000),
        "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 3999), [-1e300]]),
        "distinct": rng.permutation(4000) / 7,
        "holes": np.where(rng.random(4000) < 0.5, np.nan, rng.integers(0, 40, 4000)),
    }
    rows = [tuple(None if np.isnan(x) else float(x) for x in r) for r in zip(*columns.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).withColumn("none", F.lit(None).cast("double"))
    probs = [0.0, 0.001, 0.25, 0.4999, 0.5, 0.77, 0.9999, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in exact.exact_quantiles(df, [*columns, "none"], probs).collect()}
    assert not any(c == "none" for c, _ in got)
    for c, values in columns.items():
        known = values[~np.isnan(values)]
        for p in probs:
            assert got[c, p] == pytest.approx(np.quantile(known, p), rel=1e-12)
    for size in (1, 2, 3):
        few = exact.exact_quantiles(df.where(F.col("ties") == 1).limit(size), ["ties"], probs)
        assert {r["value"] for r in few.collect()} == {1.0}
    brackets = [exact.Bracket("wide", 10, 0, 4000, 1.0, 1e9)]
    assert "Window" not in exact.values_inside(df, brackets)._jdf.queryExecution().executedPlan().toString()


def test_running_totals_by_group_and_null(spark):
    rng = np.random.default_rng(9)
    pairs = {(int(g) if g else None, int(v)) for g, v in zip(rng.integers(0, 4, 300), rng.integers(0, 500, 300), strict=True)}
    rows = [(g, v, int(rng.integers(1, 5))) for g, v in pairs]
    df = spark.createDataFrame(rows, "g int, v int, w int")
    got = {(r.g, r.v): r.upto for r in exact.running_total(df, ["v"], "w", "upto", ["g"]).collect()}
    assert got == {(g, v): sum(w for h, u, w in rows if h == g and u <= v) for g, v, _ in rows}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    whole = {(r.g, r.v): r.pos for r in exact.running_total(df, ["g", "v"], None, "pos").collect()}
    assert [whole[g, v] for g, v, _ in order] == list(range(1, len(rows) + 1))


def test_rank_correlations_take_all_pairs_at_once(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 30, 500), "b": rng.normal(size=500), "c": rng.integers(0, 3, 500)}).astype(float)
    pdf.loc[rng.random(500) < 0.2, "b"] = np.nan
    pdf["constant"] = 1.0
    pdf["none"] = np.nan
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in pdf))
    for method in ("spearman", "kendall"):
        for r in profile.correlation_matrix(sdf, list(pdf), method).collect():
            both = pdf[[r.x, r.y]].dropna()
            x, y = (both[c].rank().to_numpy() for c in (r.x, r.y))
            if "none" in (r.x, r.y) or "constant" in (r.x, r.y):
                assert r["corr"] is None
                continue
            sx, sy = (x, y) if method == "spearman" else (np.sign(x[:, None] - x).ravel(), np.sign(y[:, None] - y).ravel())
            want = np.corrcoef(x, y)[0, 1] if method == "spearman" else (sx * sy).sum() / math.sqrt((sx**2).sum() * (sy**2).sum())
            assert r["corr"] == pytest.approx(want)


def test_rank_correlations_follow_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.integers(0, 12, 400), "b": rng.integers(0, 9, 400)}).astype(float)
    pdf["b"] += 0.4 * pdf["a"]
    sdf = spark.createDataFrame(pdf)
    ranks = pdf.rank()
    assert profile.correlation_matrix(sdf, ["a", "b"], "spearman").first()["corr"] == pytest.approx(ranks["a"].corr(ranks["b"]))
    x, y = pdf["a"].to_numpy(), pdf["b"].to_numpy()
    sa, sb = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    tau = (sa * sb).sum() / math.sqrt((sa**2).sum() * (sb**2).sum())
    assert profile.correlation_matrix(sdf, ["a", "b"], "kendall").first()["corr"] == pytest.approx(tau)


def test_outliers_and_winsorizing_on_constant_series(edge):
    for name in outliers.DETECTORS:
        assert as_map(outliers.outlier_summary(edge, SPEC, name), "n_outliers")["const"] == 0
    assert outliers.winsorize(edge, SPEC, "y").filter("y IS NULL").count() == edge.filter("y IS NULL").count()


def test_croston_rules(spark, edge):
    history = edge.filter("k IN ('zeros', 'single_nz', 'const')")
    got = {r["k"]: r["yhat"] for r in forecast.croston(history, SPEC, 1).collect()}
    assert got["zeros"] == 0 and got["single_nz"] == pytest.approx(7 / 6) and got["const"] == pytest.approx(4.0)
    drift = {r["k"]: r["yhat"] for r in forecast.drift_forecast(edge.filter("k = 'one'"), SPEC, 1).collect()}
    assert drift["one"] == 5.0
    short = forecast.seasonal_naive_forecast(edge.filter("k = 'one'"), SPEC, 2, 7)
    assert [r["yhat"] for r in short.collect()] == [None, None]


def test_shared_baselines_equal_single_ones(spark):
    _, sdf = random_panel(spark)
    together = forecast.forecast_all(sdf, SPEC, 5, 7, list(forecast.SIMPLE))
    for m in forecast.SIMPLE:
        one = forecast.forecasters(7)[m](sdf, SPEC, 5).orderBy("k", "d").toPandas()
        many = together.filter(F.col("model") == m).orderBy("k", "d").toPandas()
        np.testing.assert_allclose(one["yhat"], many["yhat"])


def test_walk_forward_keeps_the_latest_origin(spark):
    pdf, sdf = random_panel(spark, keys=1)
    out = splits.walk_forward_validation(sdf, SPEC, {"_y": F.col("y")}, F.col("_y"), 10, 1, 2)
    got = collected(out, "predicted")
    y = pdf["y"].to_numpy()
    # The last origin that leaves room for two steps predicts the last two rows.
    np.testing.assert_allclose(got, [*y[29:38], y[37]])


def test_splits_reject_disorder_and_detect_overlap(spark):
    _, sdf = random_panel(spark)
    with pytest.raises(ValueError):
        splits.time_based_split(sdf, SPEC, "2024-02-01", "2024-01-20")
    good = splits.holdout_horizon_split(sdf, SPEC, 5, 5)
    splits.assert_no_leakage(good)
    bad = splits.SplitResult(good.frame.withColumn("split", F.when(F.col("x") == 1, "train").otherwise("test")), SPEC, day(1), None, day(39))
    with pytest.raises(AssertionError):
        splits.assert_no_leakage(bad)
    with pytest.raises(ValueError):
        splits.expanding_day_folds(sdf, SPEC, 4, 28)


def test_metrics_follow_numpy(spark):
    rng = np.random.default_rng(0)
    y, f = rng.poisson(2, 200).astype(float), rng.gamma(2, 1, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, f)], "y double, f double")
    Y, P = F.col("y"), F.col("f")
    row = df.agg(
        M.wape(Y, P).alias("wape"), M.smape(Y, P).alias("smape"), M.mape(Y, P).alias("mape"), M.pinball_loss(Y, P, 0.3).alias("pin"),
        M.rmsle(Y, P).alias("rmsle"), M.bias(Y, P).alias("bias"), M.me(Y, P).alias("me"),
    ).first()
    d = y - f
    assert row["wape"] == pytest.approx(100 * abs(d).sum() / abs(y).sum())
    both = (abs(y) + abs(f)) / 2
    assert row["smape"] == pytest.approx(100 * (abs(d)[both > 0] / both[both > 0]).mean())
    assert row["mape"] == pytest.approx(100 * (abs(d)[y != 0] / y[y != 0]).mean())
    assert row["pin"] == pytest.approx(np.maximum(0.3 * d, -0.7 * d).mean())
    assert row["rmsle"] == pytest.approx(math.sqrt(((np.log1p(y) - np.log1p(f)) ** 2).mean()))
    assert row["bias"] == pytest.approx(d.mean()) and row["me"] == pytest.approx(-d.mean())
    zero = df.withColumn("y", F.lit(0.0)).agg(M.wape(Y, P).alias("w"), M.mape(Y, P).alias("m")).first()
    assert zero["w"] is None and zero["m"] is None


def test_scale_of_constant_history_gives_no_mase(spark):
    df = spark.createDataFrame([("a", day(i), 4.0) for i in range(6)], "k string, d date, y double")
    scale = scoring.naive_scale(df, PanelSpec("d", "y", ("k",)), 1).first()
    assert scale["scale"] == 0
    assert spark.sql("SELECT 1.0D y, 2.0D f, 0.0D s").agg(M.mase(F.col("y"), F.col("f"), F.col("s"))).first()[0] is None


def test_power_transforms_round_trip(spark):
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(4).lognormal(0, 0.5, 500)], "y double")
    out = transforms.boxcox_transform(df, "y")
    back = out.withColumn("b", transforms.inverse_boxcox(F.col("y_bc"), F.col("lambda")))
    assert back.filter(F.abs(F.col("b") - F.col("y")) > 1e-9).count() == 0
    assert abs(out.first()["lambda"]) < 0.3
    with pytest.raises(Exception, match="above zero"):
        transforms.fit_boxcox(spark.sql("SELECT -1.0D y"), "y").collect()


def test_target_encoding_of_unseen_value_is_the_mean(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0)], "c string, y double")
    fits = encode.fit_target_encoding(train, ["c"], "y", 10.0)
    got = {r["c"]: r["c_te"] for r in encode.apply_target_encoding(spark.sql("SELECT * FROM VALUES ('a'), ('z') AS t(c)"), fits).collect()}
    assert got["z"] == pytest.approx(4.0) and got["a"] == pytest.approx((4 + 40) / 12)


def test_decomposition_adds_up(spark):
    rows = [("a", day(i), 10 + 0.1 * i + 3 * math.sin(2 * math.pi * i / 7) + 0.05 * ((i * 7919) % 13), None, None) for i in range(70)]
    sdf = spark.createDataFrame(rows, SCHEMA)
    for made in (tsstats.seasonal_decompose(sdf, SPEC, 7), tsstats.stl_decompose(sdf, SPEC, 7), tsstats.stl_decompose(sdf, SPEC, 7, robust=True)):
        p = made.toPandas()
        np.testing.assert_allclose(p["trend"] + p["seasonal"] + p["resid"], p["y"])
        strength = tsstats.seasonal_strength(made, SPEC).first()
        assert strength["seasonal_strength"] > 0.9 and strength["trend_strength"] > 0.8


def test_stationarity_verdicts(spark):
    rng = np.random.default_rng(11)
    series = {"noise": rng.normal(size=300)} | {f"walk{i}": np.cumsum(rng.normal(size=300)) for i in range(40)}
    rows = [(k, day(i), float(v), None, None) for k, s in series.items() for i, v in enumerate(s)]
    got = {r["k"]: r for r in tsstats.stationarity_report(spark.createDataFrame(rows, SCHEMA), SPEC).collect()}
    assert got.pop("noise")["verdict"] == "stationary"
    # A 5 % test may reject a true unit root now and then.
    assert sum(r["adf_stationary"] for r in got.values()) <= 6
    assert sum(not r["kpss_stationary"] for r in got.values()) >= 30


def test_chi_square_tail_known_values(spark):
    df = spark.createDataFrame([(3.841458820694124, 1.0), (18.307038053275146, 10.0), (0.0, 3.0)], "q double, df double")
    p = [r[0] for r in df.select(tsstats.chi_square_tail("q", "df")).collect()]
    np.testing.assert_allclose(p, [0.05, 0.05, 1.0], atol=1e-9)


def test_normal_quantile(spark):
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(chartdata.normal_quantile(F.col("p"))).collect()]
    np.testing.assert_allclose(got, [NormalDist().inv_cdf(p) for p in ps], atol=1e-7)


def test_linear_contributions_add_up(spark):
    _, sdf = random_panel(spark)
    builder = features.FeatureBuilder(SPEC, lags=(1,), rolling_windows=(7,), ewm_halflives=())
    rows = builder.transform(sdf)
    model = learners.PanelRegressor(builder, {"objective": "poisson"}).fit(rows, "y")
    parts = explain.linear_contributions(rows, model, ["k", "d"])
    sums = parts.groupBy("k", "d").agg((F.sum("contribution") + F.first("base_value")).alias("total"), F.first("link").alias("link"))
    scored = model.predict(rows).join(sums, ["k", "d"])
    assert scored.filter(F.abs(F.col("total") - F.ln("yhat")) > 1e-6).count() == 0


def test_quantiles_do_not_cross_and_cover(spark):
    _, sdf = random_panel(spark, n=120)
    builder = features.FeatureBuilder(SPEC, lags=(1,), rolling_windows=(7,), ewm_halflives=())
    fit, cal = splits.cutoff_split(sdf, SPEC, day(80))
    model = learners.QuantileForecaster(builder, (0.1, 0.5, 0.9), {"objective": "regression", "max_iter": 3}, by=["k"]).fit(fit, cal)
    out = scoring.align(cal, model.predict(cal, fit), SPEC)
    assert out.filter("q0_10 > q0_50 OR q0_50 > q0_90").count() == 0
    cover = out.agg(M.coverage(F.col("y"), F.col("q0_10"), F.col("q0_90"))).first()[0]
    assert 0.7 <= cover <= 0.95


def test_additive_model_recovers_a_wave(spark):
    rows = [("a", day(i), 50 + 0.2 * i + 5 * math.sin(2 * math.pi * (i % 7) / 7), None, None) for i in range(140)]
    sdf = spark.createDataFrame(rows, SCHEMA)
    model = additive.AdditiveModel(SPEC, yearly_order=0)
    out = model.predict(sdf, grid.future_dates(sdf, SPEC, 14)).orderBy("d").toPandas()
    want = [50 + 0.2 * i + 5 * math.sin(2 * math.pi * (i % 7) / 7) for i in range(140, 154)]
    np.testing.assert_allclose(out["yhat"], want, atol=1.0)


def test_parameter_tables(spark):
    g = tuning.parameter_grid(spark, {"a": [1, 2, 3], "b": ["x", "y"]})
    assert [tuple(r) for r in g.orderBy("trial").collect()][:3] == [(0, 1, "x"), (1, 1, "y"), (2, 2, "x")]
    space = {"n": {"type": "int", "low": 16, "high": 64, "step": 16}, "lr": {"type": "log_float", "low": 1e-3, "high": 1e-1}, "c": {"type": "categorical", "choices": ["p", "q"]}}
    a, b = tuning.sample_space(spark, space, 50).collect(), tuning.sample_space(spark, space, 50).collect()
    assert a == b and {r["n"] for r in a} == {16, 32, 48, 64} and all(1e-3 <= r["lr"] <= 1e-1 for r in a)


def test_sources_and_sinks(spark, tmp_path, edge):
    folder = str(tmp_path / "panel")
    writers.write_csv(edge.filter("k IS NOT NULL"), folder)
    spec = make_spec("d", "y", "k", ["s"], ["x"])
    back = readers.load_data(spark, folder, spec)
    assert back.schema["d"].dataType.simpleString() == "date" and back.schema["y"].dataType.simpleString() == "double"
    assert back.count() == edge.filter("k IS NOT NULL").count()
    with pytest.raises(ValueError):
        readers.load_data(spark, folder, make_spec("d", "y", "k", ["nope"]))
    writers.write_parquet(edge, str(tmp_path / "p.parquet"))
    slim = readers.load_forecasting_data(spark, str(tmp_path / "p.parquet"), "d", "y", ["k"], exclude_cols=["s*", "x"])
    assert slim.columns == ["k", "d", "y"]
    with pytest.raises(ValueError):
        readers.load_forecasting_data(spark, str(tmp_path / "p.parquet"), "d", "y", ["k"], exclude_cols=["k"])
    (tmp_path / "one.csv").write_text("when;value\n2024-01-01;1\nbad;9\n2024-01-04;4\n")
    one = readers.load_timeseries(spark, str(tmp_path / "one.csv"), "when", "value", "D", "interpolate", sep=";")
    assert [r["value"] for r in one.orderBy("when").collect()] == [1.0, 2.0, 3.0, 4.0]
    parts = spark.sql("SELECT 1949 y, 'Feb' m").select(readers.date_from_parts("y", "m")).first()[0]
    assert parts == D(1949, 2, 1)
    subset.save_sample(edge.filter("k IS NOT NULL"), SPEC, str(tmp_path / "sample"), n_keys=3)
    assert readers.load_data(spark, str(tmp_path / "sample"), spec).select("k").distinct().count() == 3


def test_selection_rules(spark, edge):
    with pytest.raises(ValueError):
        select.get_series(edge, SPEC, ("a", "b"))
    assert select.get_series(edge, SPEC, (None,)).count() == 2
    assert select.sample_keys(edge, SPEC, 4, 1).select("k").distinct().count() == 4
    picked = select.evenly_spaced(spark.range(100).withColumnRenamed("id", "i"), ["i"], 5)
    assert sorted(r["i"] for r in picked.collect()) == [0, 24, 49, 74, 99]
