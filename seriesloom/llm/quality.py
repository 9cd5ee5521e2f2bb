"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own form and that of its neighbours. A document's score is the mean of its
lines' forward-backward marginals of "good", weighted by line length. The field is fitted on the driver from a bounded
sample of labelled documents (``FIT_DOCUMENTS``, the first in the order of a hash of the id), whose lines all carry the
label of their document; scoring is one pass over the texts without a shuffle.

Only the text is an input of a score. A null or empty text is one empty line and is scored as such. Repeated rows and null
ids are scored row by row. Several labels of one document count as their maximum; null labels are left out. Without any
usable label every score is ``UNFITTED``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import given_back, id_and_text, span_hashes, text_chunks

FIT_DOCUMENTS = 4000
STEPS = 200
RIDGE = 1e-3
UNFITTED = 0.5
#: A document is kept from this score on.
ACCEPTED = 0.3

SIGNS = (b"!", b"#$%&*", b"|", b".,;:?", b"0123456789")
OWN = 16
NEAR = 6


def lines_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the first line of each text (with one more entry at the end)."""
    breaks = np.flatnonzero(body == 10)
    n_texts = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    text = np.concatenate([np.arange(n_texts), np.searchsorted(offsets, breaks, "right") - 1])
    starts = np.sort(starts[np.lexsort((starts, text))], kind="stable")
    ends = ends[np.lexsort((ends, text))]
    return starts, ends, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_texts))]).astype(np.int64)


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of features, first line of each text, line lengths)."""
    starts, ends, first = lines_of(body, offsets)
    size = (ends - starts).astype(np.float64)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[ends] - sums[starts]).astype(np.float64)

    some = np.maximum(size, 1)
    upper = count((body >= 65) & (body <= 90))
    lower = count(((body >= 97) & (body <= 122)) | (body >= 128))
    shares = [count(np.isin(body, np.frombuffer(s, np.uint8))) / some for s in SIGNS]
    solid = np.concatenate([[False], body > 32, [False]])
    begins, stops = np.flatnonzero(solid[1:-1] & ~solid[:-2]), np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1
    edge = np.searchsorted(begins, offsets[1:-1])
    # A word that runs from one text into the next is two words.
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(body))] if len(body) else offsets[:0]
    cut = np.unique(cut[solid[1:-1][cut] & solid[1:-1][cut - 1]]) if len(cut) else cut
    begins, stops = np.union1d(begins, cut), np.union1d(stops, cut)
    del edge
    line = np.searchsorted(starts, begins, "right") - 1
    words = np.bincount(line, minlength=len(starts)).astype(np.float64)
    hashes = span_hashes(body, begins, stops)
    again = np.zeros(len(begins))
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, weights=again, minlength=len(starts))
    keyed = np.unique(hashes ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(line[keyed], minlength=len(starts)).astype(np.float64)
    letters = np.maximum(upper + lower, 1)
    many = np.maximum(words, 1)
    own = [
        np.ones(len(starts)), np.log1p(size) / 8, np.log1p(words) / 5, upper / letters, 5 * shares[0], 5 * shares[1], 5 * shares[2], 5 * shares[3], shares[4],
        1 - distinct / many, repeats / many, size / many / 10, (shares[1] > 0.02) * 1.0, (shares[0] > 0.02) * 1.0, (shares[2] > 0.02) * 1.0, (upper > 0.6 * letters) * 1.0,
    ]
    here = np.stack(own, axis=1)
    near = here[:, [3, 4, 5, 6, 9, 10]]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([here, before, after], axis=1), first, size + 1


def chain(unary: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of state 1 of every line, and the expected transitions of all texts, by forward and backward sums.

    ``unary`` is the score of state 1 against state 0; one step of the loop handles that line of every text.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, sorted_lengths = first[:-1][order], -np.sort(-lengths)
    longest = int(sorted_lengths[0]) if len(sorted_lengths) else 0
    score = np.stack([np.zeros(len(unary)), unary], axis=1)
    ahead, back = np.zeros_like(score), np.zeros_like(score)
    active = np.searchsorted(-sorted_lengths, -np.arange(1, longest + 1), "right")
    for t in range(longest):
        at = begin[: active[t]] + t
        if t == 0:
            ahead[at] = score[at]
        else:
            ahead[at] = score[at] + np.logaddexp(ahead[at - 1, :1] + moves[0], ahead[at - 1, 1:] + moves[1])
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        rest = score[at + 1] + back[at + 1]
        back[at] = np.logaddexp(moves[:, 0] + rest[:, :1], moves[:, 1] + rest[:, 1:])
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(unary), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    pair = np.exp(ahead[at - 1][:, :, None] + moves[None] + (score[at] + back[at])[:, None, :] - total[at][:, None, None]).sum(axis=0) if len(at) else np.zeros((2, 2))
    return good, pair


@dataclass(frozen=True)
class LineField:
    """Weights of the features, of the moves between states, and the centring of the features."""

    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def fit_field(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS) -> LineField:
    """Maximum likelihood with a ridge, by gradient steps with momentum and per-weight scaling."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    mean[0], scale[0] = 0, 1
    z = (x - mean) / scale
    weights, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    y = np.repeat(label, np.diff(first)).astype(float)
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    m, v = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for step in range(1, steps + 1):
        good, pair = chain(z @ weights, moves, first)
        gradient = np.concatenate([z.T @ (y - good), (seen - pair).ravel()]) / len(y) - RIDGE * np.concatenate([weights, moves.ravel()])
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, moves = weights + move[:-4], moves + move[-4:].reshape(2, 2)
    return LineField(weights, moves, mean, scale)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = FIT_DOCUMENTS) -> LineField | None:
    """Fit on at most ``limit`` labelled documents; ``labels`` must hold only rows that may be learned from."""
    picked = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )

    def run(batches):
        for batch in batches:
            known = pa.RecordBatch.from_arrays([batch.column(2), batch.column(1)], ["label", "text"])
            for label, body, offsets in text_chunks(iter([known])):
                x, first, _ = features(body, offsets)
                for i, y in enumerate(label.to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([x[first[i] : first[i + 1]].astype(np.float32).tobytes()])], ["label", "lines"])

    # At most ``limit`` rows on the small side; the order makes the sums of the fit repeatable.
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")
    rows = texts.mapInArrow(run, "label int, lines binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["label"], bytes(r["lines"])))
    lines = [np.frombuffer(r["lines"], np.float32).reshape(-1, OWN + 2 * NEAR) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    field = fit_field(np.concatenate(lines).astype(float), first, np.array([min(max(r["label"], 0), 1) for r in rows]))
    del rows, lines
    given_back()
    return field


def score_documents(docs: DataFrame, field: LineField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_lines, n_bad_lines) of every whole text."""

    def run(batches):
        for ids, body, offsets in text_chunks(batches):
            x, first, weight = features(body, offsets)
            if field is None:
                good = np.full(len(x), UNFITTED)
            else:
                good, _ = chain(field.unary(x), field.moves, first)
            score = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
            bad = np.add.reduceat((good < 0.5).astype(np.int64), first[:-1])
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.clip(score, 0, 1)), pa.array(np.diff(first)), pa.array(bad)], ["doc_id", "score", "n_lines", "n_bad_lines"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, n_lines long, n_bad_lines long")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def accepted_documents(docs: DataFrame, field: LineField | None, threshold: float = ACCEPTED) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores ``threshold`` or more. Works on any columns, without a join."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            keep = []
            known = pa.RecordBatch.from_arrays([batch.column(names.index("text")), batch.column(names.index("text"))], ["t", "text"])
            for _, body, offsets in text_chunks(iter([known])):
                x, first, weight = features(body, offsets)
                good = np.full(len(x), UNFITTED) if field is None else chain(field.unary(x), field.moves, first)[0]
                keep.append(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]) >= threshold)
            yield batch.filter(pa.array(np.concatenate([*keep, np.zeros(0, bool)])))

    return docs.mapInArrow(run, docs.schema)
