"""Shapes of physical plans: exchanges, pushdown, no Python, no unpartitioned windows."""

import re

import pytest

from seriesloom.operators import demand, windows
from seriesloom.operators.features import FeatureBuilder
from seriesloom.operators.grid import complete_panel
from workload import ORACLES, QUERIES
from workload import panels as P
from workload.registry import table

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_features_add_no_exchange_to_the_grid(spark):
    full = complete_panel(P.supplier_week(spark, FOLDER), P.WEEKLY)
    built = FeatureBuilder(P.WEEKLY, lags=(1, 4), rolling_windows=(4, 13), ewm_halflives=(4.0,)).transform(full)
    # One exchange builds the panel, one serves grid, lags, rolling and weighted features.
    assert exchanges(full) == exchanges(built) == 2


def test_classes_use_the_partitioning_of_the_grid(spark):
    full = complete_panel(P.supplier_week(spark, FOLDER), P.WEEKLY)
    assert exchanges(demand.classify_all_series(full, P.WEEKLY)) == 2


def test_scan_reads_only_needed_columns(spark):
    text = plan(P.supplier_week(spark, FOLDER))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_suppkey", "l_quantity", "l_shipdate"}


def test_key_and_date_filters_reach_the_scan(spark):
    rows = table(spark, FOLDER, "orders").filter("o_custkey = 7 AND o_orderdate >= TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    pushed = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    assert "EqualTo(o_custkey,7)" in pushed and "GreaterThanOrEqual(o_orderdate" in pushed


def test_blocks_partition_by_key_and_block(spark):
    full = complete_panel(P.supplier_week(spark, FOLDER), P.WEEKLY)
    out = windows.by_blocks(full, P.WEEKLY, 4, 52, lambda df, s: windows.add_lag_features(df, s, lags=(4,)))
    assert re.search(r"hashpartitioning\(k#\d+L?, _block#\d+L?", plan(out))


# A sample of query families; the whole set would only repeat them.
@pytest.mark.parametrize("name", ["supplier_week_class_summary", "impute_linear", "feature_table", "model_comparison", "partial_autocorrelations", "kpss_statistics", "outlier_counts", "croston_forecasts", "ewm_features"])
def test_queries_stay_in_the_jvm_with_partitioned_windows(spark, name):
    assert name in ORACLES
    text = plan(QUERIES[name](spark, FOLDER))
    assert not re.search(r"Python|Pandas|CartesianProduct", text)
    for w in re.findall(r"\bWindow \[.*", text):
        # The share of a class is a sum over one row per class.
        small = "sum(n_series" in w
        assert small or not re.search(r"windowspecdefinition\((?:specifiedwindowframe|[^,)]* ASC|[^,)]* DESC)", w)
