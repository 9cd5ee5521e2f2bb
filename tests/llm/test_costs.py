"""What tasks hand on and hold: pairs told once, small batches, few calls of a tokenizer."""

import random

from public_tokenizers import path
from pyspark.sql import functions as F

from seriesloom.llm import alignment, common, jaccard, repeats
from tests.llm.test_operators import frame, removed_by_force, sentence


def test_pairs_of_many_buckets_are_told_once_a_task(spark, monkeypatch):
    """200 sets of as many components meet in 30 large buckets: a task tells each pair once, not once a bucket."""
    n, buckets, partners = 200, 30, 4
    told = spark.sparkContext.accumulator(0)
    plain = jaccard.lean

    def counting(run):
        def counted(batches):
            for batch in run(batches):
                told.add(batch.num_rows)
                yield batch

        return plain(counted)

    monkeypatch.setattr(jaccard, "lean", counting)
    rng = random.Random(5)
    reps = [(k, k, 1000, bytes(rng.randint(0, 1) for _ in range(jaccard.BINS))) for k in range(n + buckets)]
    reps = spark.createDataFrame(reps, "key long, doc_id long, n long, sketch binary")
    groups = spark.createDataFrame([([*range(n), n + b],) for b in range(buckets)], "members array<long>")
    found = jaccard.crossing_pairs(groups, spark.createDataFrame([], "node long, root long"), reps, partners).collect()
    pairs = {(r["u"], r["v"]) for r in found}
    assert len(pairs) == len(found) and all(r["more"] for r in found)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Two ends of a pair, in each of the tasks at most: 30 buckets would tell 24,000 rows and more.
    assert len(pairs) <= told.value <= tasks * len(pairs) < buckets * n * partners


def test_batches_of_stored_steps_are_small(spark):
    """4000 texts of 4000 bytes in one task come in batches of some 4 MB; the session's setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("a"), 4000).alias("text")).mapInArrow(sizes, "n long")
    assert common.stored(rows, "plain").agg(F.max("n")).first()[0] > 2 * common.BATCH_BYTES
    assert repeats.stored(rows, "small").agg(F.max("n")).first()[0] < 2 * common.BATCH_BYTES
    assert jaccard.stored(rows, "small").agg(F.max("n")).first()[0] < 2 * common.BATCH_BYTES
    assert spark.conf.get(name, None) == before


def test_texts_cut_in_slices_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "ROWS_AT_ONCE", 3)
    rng = random.Random(8)
    passage = sentence(rng, 200)[:500]
    rows = [(k, sentence(rng, 30) + (passage if k % 3 == 0 else "") + sentence(rng, 30)) for k in range(20)]
    got = {r["doc_id"]: len(r["text"]) for r in repeats.without_repeats(frame(spark, rows).repartition(1)).collect()}
    assert got == {r[0]: r[1] - r[2] for r in removed_by_force(rows, repeats.LENGTH)}


def test_new_words_are_told_many_to_a_text(monkeypatch):
    """1000 new words go to the library in few texts, with the same ids; known ones not at all."""
    encode, _ = alignment.first_tokenizer(path("byte_bpe_50k.json"))
    encode.forget()
    told = []
    plain = encode.coder.encode_batch_fast

    class Coder:
        def encode_batch_fast(self, texts, add_special_tokens):
            told.extend(texts)
            return plain(texts, add_special_tokens=add_special_tokens)

    monkeypatch.setattr(encode, "coder", Coder())
    rng = random.Random(2)
    texts = [" " + " ".join("".join(rng.choice("abcdeéß") for _ in range(9)) for _ in range(50)) for _ in range(20)]
    want = [e.ids for e in plain(texts, add_special_tokens=False)]
    assert [list(x) for x in encode(texts)] == want and 0 < len(told) <= 1000 // alignment.WORDS_AT_ONCE + 2
    told.clear()
    assert [list(x) for x in encode(texts)] == want and not told
