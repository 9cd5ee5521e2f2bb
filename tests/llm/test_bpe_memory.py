"""What an encoding worker holds: new pieces some at a time, remembered ones in flat arrays, small batches."""

import random

import numpy as np
from public_tokenizers import path
from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm import bpe

RANKS = path("byte_bpe_50k.tiktoken")


def test_new_pieces_are_encoded_some_at_a_time(monkeypatch):
    """1000 new words of one text: never more than 100 at once, and ids and bytes are those of each word."""
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 100)
    coder, told = bpe.Coder(RANKS), []
    plain = coder.encode
    monkeypatch.setattr(coder, "encode", lambda words: told.append(len(words)) or plain(words))
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdeéß") for _ in range(9)).encode() for _ in range(1000)})
    places = rng.choices(range(len(words)), k=3000) + list(range(len(words)))
    body = np.frombuffer(b"".join(words[i] for i in places), np.uint8)
    ends = np.cumsum([len(words[i]) for i in places])
    slots = coder.slots_of(body, np.append(0, ends[:-1]), ends)
    assert max(told) <= 100 and sum(told) == len(words)
    assert isinstance(coder.decoded, np.ndarray) and len(coder.decoded) == sum(map(len, words))
    assert np.array_equal(coder.bytes_of(slots), body)
    assert coder.ids_of(slots).tolist() == [t for i in places for t in plain([words[i]])[0].tolist()]


def test_the_last_stage_takes_small_batches(spark, monkeypatch):
    """4000 texts of 4000 bytes in one task: the stage that encodes gets them in batches of some 4 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    large = spark.sparkContext.accumulator(0)
    plain = bpe.coded_chunks

    def counted(batches, ranks):
        for batch in batches:
            large.add(int(batch.nbytes > 8 << 20))
            yield from plain(iter([batch]), ranks)

    monkeypatch.setattr(bpe, "coded_chunks", counted)
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 1333).alias("text"))
    out = corpus_pipeline.to_tokens(spark, docs, "")
    assert out.columns == ["doc_id", "n_tokens", "token_ids"] and out.count() == 4000
    assert large.value == 0 and spark.conf.get(name, None) == before
