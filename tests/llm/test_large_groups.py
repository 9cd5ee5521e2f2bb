"""Large index buckets, planted passages and whole runs against brute force."""

import random

import pytest

from seriesloom.llm import jaccard, repeats
from tests.llm.test_operators import components_by_force, frame, removed_by_force, sentence


@pytest.fixture(scope="module")
def crowd():
    """Sets that share most of their shingles, in several components that sketches cannot tell apart."""
    rng = random.Random(31)
    words = sentence(rng, 100).split()
    rows = []
    for branch in range(12):
        base = list(words)
        for k in rng.sample(range(0, 100, 6), 5):
            base[k] = f"b{branch}x{k}"
        for _ in range(20):
            copy = list(base)
            copy[rng.randrange(100)] = f"own{len(rows)}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


def test_rounds_link_all_of_a_large_bucket(spark, crowd, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    made = []
    plain = jaccard.crossing_pairs

    def counted(groups, roots, reps, partners):
        out = jaccard.stored(plain(groups, roots, reps, partners), "counted")
        made.append((partners, out.count()))
        return out

    monkeypatch.setattr(jaccard, "crossing_pairs", counted)
    got = sorted(tuple(r) for r in jaccard.similar_documents(frame(spark, crowd)).collect())
    want = components_by_force(crowd)
    assert got == want and len({c for _, _, c in want}) > 1
    # A round gives each member at most its partners in each pair of blocks and bucket, never all pairs.
    assert made and made[0][0] == jaccard.FIRST_PARTNERS


def test_a_round_has_linear_rows(spark):
    """2000 members of one bucket in as many components: each names one partner."""
    rng = random.Random(17)
    import numpy as np
    from pyspark.sql import functions as F

    n = 2000
    sketches = [bytes(np.random.default_rng(k).integers(0, 2, jaccard.BINS).astype(np.uint8)) for k in range(n)]
    reps = spark.createDataFrame([(k, k, 1000, s) for k, s in enumerate(sketches)], "key long, doc_id long, n long, sketch binary")
    groups = spark.createDataFrame([(sorted(rng.sample(range(n), n)),)], "members array<long>")
    roots = spark.createDataFrame([], "node long, root long")
    found = jaccard.crossing_pairs(groups, roots, reps, 1)
    blocks = -(-n // jaccard.BLOCK)
    assert 0 < found.count() <= n * blocks
    assert found.where(~F.col("more")).count() == 0


def test_planted_passages_equal_brute_force(spark):
    """Passages of 51 to 90 words around the limit of 400 bytes, in up to six documents each, beside texts without any."""
    rng = random.Random(13)
    rows, i = [], 0
    for size in (300, 350, 398, 399, 400, 401, 402, 450, 600):
        for _ in range(3):
            passage = sentence(rng, 200, "abcdefghijklmnopq")[:size]
            for _ in range(rng.randint(2, 6)):
                rows.append((i, sentence(rng, rng.randint(0, 60)) + passage + sentence(rng, rng.randint(0, 60))))
                i += 1
    rows += [(i + k, sentence(rng, 120)) for k in range(40)]
    got = sorted((tuple(r)[:5] for r in repeats.removal_report(frame(spark, rows).repartition(4)).collect()), key=repr)
    want = removed_by_force(rows, repeats.LENGTH)
    assert got == want
    assert sum(r[2] > 0 for r in want) >= 30 and sum(r[2] == 0 for r in want) >= 40
