"""Clusters that meet in many buckets, sketches of long sets, plans of benchmark windows."""

import random

import numpy as np

from seriesloom.llm import decontaminate, jaccard


def _sketch(rng, n):
    return rng.integers(0, 2**63, n).astype(np.uint64)


def test_sketches_rule_out_all_but_pairs_near_the_limit():
    """Sets of any size: those that link stay, those of similarity 0.77 and less are ruled out before texts are read."""
    rng = np.random.default_rng(3)
    for n in (60, 300, 2000, 9000, 30_000):
        for turned in (0, 1, n // 10, n // 9, n // 7, n // 4, n):
            base = _sketch(rng, n)
            other = np.concatenate([base[turned:], _sketch(rng, turned)])
            both = np.concatenate([np.sort(base), np.sort(other)])
            sketch, ends = jaccard.set_sketches(both, np.array([0, n, 2 * n]))
            a, b = (sketch[ends[i] : ends[i + 1]].tobytes() for i in range(2))
            near = jaccard._near(np.array([n]), np.array([n]), [a], [b])[0]
            similarity = (n - turned) / (n + turned)
            assert near if similarity >= 0.8 else (similarity > 0.77 or not near), (n, turned)


def test_sketches_of_different_lengths_are_folded():
    rng = np.random.default_rng(4)
    base = _sketch(rng, 2100)
    sketch, ends = jaccard.set_sketches(np.concatenate([np.sort(base), np.sort(base[:2000])]), np.array([0, 2100, 4100]))
    assert ends[1] == 2 * (ends[2] - ends[1])
    words, levels = jaccard._by_length([sketch[ends[i] : ends[i + 1]].tobytes() for i in range(2)])
    least = levels[int(words.min())]
    assert 0 < int(jaccard._apart(least[0], least[1])) <= 100


def test_pairs_of_a_cluster_are_told_in_one_task(spark, monkeypatch):
    """100 sets of one cluster meet in 40 buckets: their pairs are told once, however many tasks there are."""
    told = spark.sparkContext.accumulator(0)
    plain = jaccard.lean

    def counting(run):
        def counted(batches):
            for batch in run(batches):
                told.add(batch.num_rows)
                yield batch

        return plain(counted)

    monkeypatch.setattr(jaccard, "lean", counting)
    n, buckets, partners = 100, 40, 2
    rng = random.Random(9)
    reps = [(k, k, 1000, bytes(rng.randint(0, 1) for _ in range(jaccard.BINS))) for k in range(n + buckets)]
    reps = spark.createDataFrame(reps, "key long, doc_id long, n long, sketch binary")
    groups = spark.createDataFrame([([0, *sorted(rng.sample(range(1, n), n // 2)), n + b],) for b in range(buckets)], "members array<long>")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        found = jaccard.crossing_pairs(groups, spark.createDataFrame([], "node long, root long"), reps, partners).collect()
    finally:
        spark.conf.set(name, before)
    assert told.value == len(found) <= partners * (n + buckets)
    assert {r["u"] for r in found} | {r["v"] for r in found} == set(range(n + buckets))


def test_windows_of_all_kinds_take_one_pass(spark):
    """One plan for each width, not one for each width and kind."""
    items = spark.createDataFrame([(1, "The runner covered the same long road in 3 hours before noon"), (2, "Four words stand here")], "item_id long, text string")
    windows, _ = decontaminate.benchmark_windows(items)
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 2
    assert {r["kind"] for r in windows.where("item_id = 1").collect()} == set(decontaminate.KINDS)
