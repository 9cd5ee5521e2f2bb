"""Context-triggered piecewise hashing of documents, and their comparison by edit distance.

A hash of the last seven bytes marks boundaries where its low bits are zero; the number of bits (the block size is a power
of two) is the smallest that leaves at most ``MOST`` pieces. Each piece gives one of 64 signs. A fingerprint
``bits:signature:signature of twice the block size`` so keeps its signs where a text stays the same. Two fingerprints
compare at equal block sizes: 1 - distance / longer length, the best of those that both have; 0 without a common one.

The empty text has the fingerprint ``0::``, which is like itself (1) and like no other text (0). Null texts are empty.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import CHUNK_BYTES, mix, span_hashes

MOST = 64
CONTEXT = 7
SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """(bits, signature, signature of twice the block size) of every text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    # Zeros before every text, the first one as well: a hash never sees another text.
    body = np.frombuffer((b"\0" * CONTEXT).join([b"", *texts]), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + CONTEXT)[:-1]]) + CONTEXT
    ends = starts + sizes
    rolling = np.zeros(len(body), np.uint64)
    for k in range(CONTEXT):
        rolling[k:] += (body[: len(body) - k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 ** (k + 1) & 0xFFFFFFFFFFFFFFFF | 1)
    mixed = mix(rolling)
    # Positions whose lowest ``bits`` bits are zero, for more and more bits; of each text the first that are few enough.
    at, bits = np.arange(len(body)), np.zeros(len(texts), np.int64)
    open_ = np.arange(len(texts))
    for level in range(64):
        if level:
            at = at[mixed[at] & np.uint64(1 << (level - 1)) == 0]
        count = np.searchsorted(at, ends[open_]) - np.searchsorted(at, starts[open_])
        few = count <= MOST - 1
        bits[open_[few]] = level
        open_ = open_[~few]
        if not len(open_):
            break
    bits[open_] = 63
    out = []
    for extra in (0, 1):
        mask = (np.uint64(1) << np.minimum(bits + extra, 63).astype(np.uint64)) - np.uint64(1)
        marks = np.flatnonzero(mixed & np.repeat(mask, sizes + CONTEXT) == 0)
        owner = np.searchsorted(starts, marks, "right") - 1
        inside = (owner >= 0) & (marks < ends[owner])
        marks, owner = marks[inside] + 1, owner[inside]
        # The rest of a text after its last boundary is a piece of its own.
        full = np.flatnonzero(sizes > 0)
        stops = np.unique(np.concatenate([marks, ends[full]]))
        owner = np.searchsorted(starts, stops - 1, "right") - 1
        begin = np.concatenate([[0], stops[:-1]])
        begin = np.maximum(begin, starts[owner])
        signs = SIGNS[(span_hashes(body, begin, stops) >> np.uint64(58)).astype(np.int64)].tobytes()
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        out.append([signs[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
    return bits, out[0], out[1]


def shown(bits: np.ndarray, one: list[bytes], two: list[bytes]) -> list[str]:
    return [f"{b}:{x.decode()}:{y.decode()}" for b, x, y in zip(bits.tolist(), one, two, strict=True)]


def parsed(prints: list[str]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    parts = [p.split(":") for p in prints]
    return np.array([int(p[0]) for p in parts], np.int64), [p[1].encode() for p in parts], [p[2].encode() for p in parts]


def edit_distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Edit distances of many pairs of strings of at most 64 signs, one bit for a sign of the left one."""
    n = len(left)
    m, k = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    score = m.copy()
    if not n:
        return score
    codes = np.zeros(256, np.int64)
    codes[SIGNS] = np.arange(64)
    rows = np.arange(n)
    a, b = (codes[np.frombuffer(b"".join(x.ljust(MOST, b"A") for x in side), np.uint8).reshape(n, MOST)] for side in (left, right))
    where = np.zeros((n, 64), np.uint64)
    for i in range(int(m.max(initial=0))):
        own = rows[m > i]
        where[own, a[own, i]] |= np.uint64(1 << i)
    plus, minus = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(n, np.uint64)
    top = np.maximum(m - 1, 0).astype(np.uint64)
    one = np.uint64(1)
    for j in range(int(k.max(initial=0))):
        same = where[rows, b[:, j]]
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | ~(across | plus), plus & across
        score += np.where(k > j, ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64), 0)
        up, down = (up << one) | one, down << one
        plus, minus = down | ~(vertical | up), up & vertical
    return np.where(m == 0, k, score)


def likeness(x: tuple, y: tuple) -> np.ndarray:
    """Similarity of many pairs of fingerprints, each side as ``fingerprints`` gives it."""
    best = np.zeros(len(x[0]))
    for i, j in ((1, 1), (2, 2), (2, 1), (1, 2)):
        at = np.flatnonzero(x[0] + (i - 1) == y[0] + (j - 1))
        left, right = [x[i][k] for k in at], [y[j][k] for k in at]
        longer = np.array([max(len(a), len(b)) for a, b in zip(left, right, strict=True)], np.int64)
        value = np.where(longer == 0, 1.0, 1 - edit_distances(left, right) / np.maximum(longer, 1))
        best[at] = np.maximum(best[at], value)
    empty = np.array([not a for a in x[1]], bool) != np.array([not a for a in y[1]], bool)
    best[empty] = 0
    return best


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown(*fingerprints([(t.as_py() or "").encode() for t in batch.column(1)])), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last quarter of a text replaced by as many first characters of another one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside its edited text and the next document by ascending id; after the last comes the first.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null ids come first,
    equal ids are ordered by text. Documents are dealt by ranges of ids; each range also gets the first document of the
    one after it, so no order over all rows is needed.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    cuts = slim.agg(F.percentile_approx("doc_id", [i / tasks for i in range(1, tasks)] or [0.5], 10_000).alias("c")).first()["c"] or []
    cuts = np.unique(np.array(cuts, np.int64))  # at most one a task

    def range_of(ids: pa.Array) -> np.ndarray:
        return np.where(np.asarray(ids.is_null()), 0, np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), "right"))

    def number(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(batch.column(0))), batch.column(0)], ["part", "doc_id"])

    low = slim.select("doc_id").mapInArrow(number, "part long, doc_id long").groupBy("part").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("none"))
    firsts = sorted((r["part"], None if r["none"] else r["least"]) for r in low.collect())  # one row a range
    before = {part: firsts[i - 1][0] for i, (part, _) in enumerate(firsts)}
    least = dict(firsts)

    def deal(batches):
        for batch in batches:
            part = range_of(batch.column(0))
            ids = batch.column(0).to_pylist()
            guests = [i for i, p in enumerate(part.tolist()) if ids[i] == least[p]]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(part), bool)), batch.column(0), batch.column(1)], ["part", "guest", "doc_id", "text"])
            if guests:
                own = batch.take(pa.array(guests))
                yield pa.RecordBatch.from_arrays([pa.array([before[int(part[i])] for i in guests], pa.int64()), pa.array([True] * len(guests)), own.column(0), own.column(1)], ["part", "guest", "doc_id", "text"])

    dealt = slim.mapInArrow(deal, "part long, guest boolean, doc_id long, text string").repartition(tasks, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")

    def compare(ids, texts, following):
        edited = [edited_text(a, b) for a, b in zip(texts, following, strict=True)]
        coded = [t.encode() for t in edited]
        n = len(texts)
        # A next document usually is the following row: its fingerprint is made once.
        distinct: dict[str, int] = {}
        place = [distinct.setdefault(t, len(distinct)) for t in [*texts, *following]]
        bits, one, two = fingerprints([*(t.encode() for t in distinct), *coded])
        pick = lambda at: (bits[at], [one[i] for i in at], [two[i] for i in at])
        own, after, changed = pick(np.array(place[:n])), pick(np.array(place[n:])), pick(np.arange(len(distinct), len(distinct) + n))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in coded]), pa.array(shown(*own)), pa.array(shown(*changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, after))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        held, at = None, None  # the row that waits for the next one, and its range
        ids, texts, following, size = [], [], [], 0
        for batch in batches:
            for part, guest, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                now = text.as_py()
                if held is not None and part == at:
                    ids.append(held[0])
                    texts.append(held[1])
                    following.append(now)
                    size += len(held[1])
                held, at = (None, None) if guest else ((doc, now), part)
                if size >= CHUNK_BYTES // 2:
                    yield compare(ids, texts, following)
                    ids, texts, following, size = [], [], [], 0
        if ids:
            yield compare(ids, texts, following)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
