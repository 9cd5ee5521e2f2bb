"""Rank correlations hold a bounded number of groups in a task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom import session
from seriesloom.operators import profile

PARTS, MERGED = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def by_force(x, y, method):
    if method == "spearman":
        return np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    a, b = (np.sign(v[:, None] - v[None, :]).astype(np.int8) for v in (x, y))
    return (a * b).sum() / np.sqrt((a != 0).sum() * float((b != 0).sum()))


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_value_pairs_are_dealt_by_their_number(spark, monkeypatch, method):
    """6000 distinct pairs at 300 a part: no part of the stored pairs holds many more; settings are put back."""
    monkeypatch.setattr(session, "NARROW_ROWS", 300)
    own, stored = {name: spark.conf.get(name, None) for name in (PARTS, MERGED)}, []
    plain = profile.reliable_checkpoint
    monkeypatch.setattr(profile, "reliable_checkpoint", lambda df: stored.append(plain(df)) or stored[-1])
    rng = np.random.default_rng(1)
    x = rng.permutation(6000)
    y = x + rng.integers(0, 3000, 6000)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y, strict=True)], "x int, y int")
    # Merging of small parts has a least size of its own.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = profile.correlation_matrix(df, ["x", "y"], method).first()["corr"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in stored[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 2 * 300 + 100
    assert {name: spark.conf.get(name, None) for name in own} == own
    assert got == pytest.approx(by_force(x, y, method), abs=1e-9)
