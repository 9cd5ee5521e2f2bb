"""Alignment of two tokenizers over the same bytes, with counts of the id pairs that end together.

Texts are grouped by their full text first, so each distinct text is tokenised and aligned once, however many documents
hold it, and its pair counts are weighted by that number. The measures of a text are joined back to the ids of its rows.

Tokenizer A is a file of the tokenizers library (byte-level), B a sentencepiece model; A reads a space before the text, as B
adds one itself. Where the bytes of A's or B's tokens do not join to that text, there is no alignment and all measures are
zero. Special tokens are ordinary text in both.

Pair counts meet the texts' pairs in two joins: the most frequent pairs, at most ``HOT_PAIRS`` of them, are broadcast, and
only pairs beyond them are shuffled, so neither grows with the corpus and frequent pairs cause no skew.

Null and empty texts have no tokens. Repeated rows, repeated ids and null ids get a row each. Extra columns are not read. A
text is tokenised whole, as both libraries need it: a task holds one text of any length, or several up to ``TEXT_BYTES``,
and some 100 bytes for each of their bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import id_and_text, stored

#: Bytes of text that a task tokenises at a time.
TEXT_BYTES = 1 << 18
#: Pairs that are broadcast at most: 24 bytes each.
HOT_PAIRS = 1_000_000
#: Pairs whose counts a task sums before it hands them on.
PAIRS_AT_ONCE = 200_000
#: Pieces of text whose ids a worker remembers (more only within a call), their greatest length, and new words that go to
#: the library in one text.
PIECES, PIECE_CHARS, WORDS_AT_ONCE = 400_000, 40, 64
#: A pair is one number: A's id times this, plus B's id.
PAIR_BASE = 1 << 31


class Strings:
    """Byte strings in one buffer, joined by their numbers with array operations."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(b) for b in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, numbers: np.ndarray) -> bytes:
        n = self.size[numbers]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        return self.flat[np.repeat(self.start[numbers] - ends + n, n) + np.arange(ends[-1])].tobytes()


@dataclass(frozen=True)
class Vocabulary:
    """The bytes of each id; ``marked`` has each id as text before a comma, then each before the group's mark."""

    body: Strings
    marked: list[bytes]

    @property
    def entries(self) -> int:
        return len(self.body.size)


def _vocabulary(body: list[bytes], mark: bytes) -> Vocabulary:
    return Vocabulary(Strings(body), [b"%d%b" % (i, m) for m in (b",", mark) for i in range(len(body))])


@lru_cache(maxsize=2)
def _marked(first_path: str, second_path: str) -> Strings:
    """The marked ids of both vocabularies, one after the other."""
    return Strings(first_tokenizer(first_path)[1].marked + second_tokenizer(second_path)[1].marked)


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _latin(kind: str) -> str:
    """The Latin-1 characters of one class, for a pattern."""
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)


@lru_cache(maxsize=1)
def latin_pieces() -> re.Pattern:
    """The pieces that a byte-level tokenizer codes one by one, for texts of Latin-1 characters, whose classes are settled."""
    letter, number, blank = _latin("L"), _latin("N"), r"\t-\r \x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


class Remembering:
    """An encoder of many texts that hands each piece of a Latin-1 text to the library once, and other texts whole.

    A piece's ids are kept as a stretch of one array, so a text is a list of stretch numbers and one gather. New words after
    a space are told to the library many to a text, which it splits into the same pieces; the bytes of the ids say where one
    ends. Pieces whose ids do not give their bytes are not kept, and texts with such a piece go whole.
    """

    def __init__(self, coder, vocabulary: Vocabulary):
        self.coder, self.vocabulary = coder, vocabulary
        self.split = latin_pieces().findall
        self.word = re.compile(rf" [{_latin('L')}]+").fullmatch
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.stretches = 0

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        words = [x for x in new if self.word(x)]
        runs = ["".join(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        if not self._keep(words, runs):
            self._keep(words, words)
        rest = [x for x in new if not self.word(x)]
        if not self._keep(rest, rest):
            for x in rest:
                self._keep([x], [x])

    def _keep(self, new: list[str], texts: list[str]) -> bool:
        """Remember the new pieces, which the texts are made of, unless the library's tokens do not end with them."""
        if not new:
            return True
        ids = np.fromiter(chain.from_iterable(self.library(texts)), np.int64)
        whole = "".join(new)
        if self.vocabulary.body.joined(ids) != whole.encode():
            return False
        # Bytes of the pieces: a Latin-1 character has one below 128, two from there on.
        places = np.cumsum(1 + (np.frombuffer(whole.encode("latin-1"), np.uint8) >= 128))
        stops = places[np.cumsum(np.fromiter(map(len, new), np.int64)) - 1]
        ends = np.cumsum(self.vocabulary.body.size[ids])
        at = np.searchsorted(ends, stops, "right")
        if not np.array_equal(ends[at - 1], stops):
            return False
        used, n = int(self.ends[self.stretches]), self.stretches
        self.ids = _roomy(self.ids, used + len(ids))
        self.ends = _roomy(self.ends, n + len(new) + 1)
        self.ids[used : used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(new)] = used + at
        self.number.update(zip(new, range(n, n + len(new)), strict=True))
        self.stretches += len(new)
        return True

    def __call__(self, texts: list[str]) -> list[np.ndarray | list[int]]:
        if len(self.number) > PIECES:
            self.forget()
        latin = [_is_latin(t) for t in texts]
        pieces = [self.split(t) if own else [] for t, own in zip(texts, latin, strict=True)]
        self.learn([x for x in {*chain.from_iterable(pieces)}.difference(self.number) if len(x) <= PIECE_CHARS])
        size = np.array([len(p) for p in pieces], np.int64)
        number = np.fromiter(map(self.number.get, chain.from_iterable(pieces), repeat(-1)), np.int64, size.sum())
        bounds = np.concatenate([[0], np.cumsum(size)])
        # Pieces that are not known have number -1 and no ids here.
        start = np.where(number < 0, 0, self.ends[number])
        n = self.ends[number + 1] - start
        told = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(start - told[:-1], n) + np.arange(told[-1])]
        told = told[bounds].tolist()
        out: list[np.ndarray | list[int]] = [ids[a:b] for a, b in zip(told[:-1], told[1:], strict=True)]
        unknown = np.concatenate([[0], np.cumsum(number < 0)])[bounds]
        whole = [i for i in range(len(texts)) if not latin[i] or unknown[i + 1] > unknown[i]]
        for i, one in zip(whole, self.library([texts[i] for i in whole]), strict=True):
            out[i] = one
        return out


def _roomy(array: np.ndarray, n: int) -> np.ndarray:
    """The array, with room for ``n`` entries."""
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, len(array)), np.int64)])


def remembering(coder):
    """``Remembering`` as a function from texts to id lists."""
    encode = Remembering(coder, _byte_vocabulary(coder))
    return lambda texts: [np.asarray(ids, np.int64).tolist() for ids in encode(texts)]


def _byte_vocabulary(coder) -> Vocabulary:
    """The bytes of a byte-level tokenizer's entries."""
    signs = byte_of_sign()
    names = coder.get_vocab(with_added_tokens=True)
    body = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        body[i] = bytes(signs[c] for c in name) if all(c in signs for c in name) else name.encode()
    return _vocabulary(body, b"|")


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def first_tokenizer(path: str):
    """(encoder of many texts to id lists, vocabulary) of a byte-level file of the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    vocabulary = _byte_vocabulary(coder)
    setting = json.loads(coder.to_str())
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if setting["normalizer"] is None and usual.items() <= (setting["pre_tokenizer"] or {}).items():
        return Remembering(coder, vocabulary), vocabulary
    return lambda texts: [e.ids for e in coder.encode_batch_fast(texts, add_special_tokens=False)], vocabulary


@lru_cache(maxsize=2)
def second_tokenizer(path: str):
    """(encoder of many texts to id lists, vocabulary) of a sentencepiece model."""
    from sentencepiece import SentencePieceProcessor

    coder = SentencePieceProcessor(model_file=path)
    body = []
    for i in range(coder.get_piece_size()):
        piece = coder.id_to_piece(i)
        body.append(bytes([int(piece[3:5], 16)]) if coder.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda texts: coder.encode(texts, num_threads=1), _vocabulary(body, b";")


@dataclass(frozen=True)
class Alignment:
    """Tokens of one text as ids of A and B, the end of every group among them, and the pairs that end together."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    @property
    def pairs(self) -> np.ndarray:
        return self.a[self.a_ends] * PAIR_BASE + self.b[self.b_ends]

    def groups(self, marked: Strings, first_size: int, second_size: int) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of every group in order, from the marked ids of both vocabularies."""
        a, b = self.a.copy(), self.b + 2 * first_size
        a[self.a_ends] += first_size
        b[self.b_ends] += second_size
        # A's tokens of a group come before B's: each token moves by what the other side has placed before it.
        size_a, size_b = np.diff(self.a_ends, prepend=-1), np.diff(self.b_ends, prepend=-1)
        both = np.empty(len(a) + len(b), np.int64)
        both[np.arange(len(a)) + np.repeat(self.b_ends + 1 - size_b, size_a)] = a
        both[np.arange(len(b)) + np.repeat(self.a_ends + 1, size_b)] = b
        return marked.joined(both)[:-1]


def aligned(text: bytes, a: list[int] | np.ndarray, b: list[int], first: Vocabulary, second: Vocabulary) -> Alignment | None:
    """The alignment of two id lists, or None where either does not give the bytes of the text after a space."""
    whole = b" " + text
    ids = np.asarray(a, np.int64), np.array(b, np.int64)
    # An array comes from pieces whose bytes were compared when they were learnt.
    if not isinstance(a, np.ndarray) and first.body.joined(ids[0]) != whole or second.body.joined(ids[1]) != whole:
        return None
    ends = np.cumsum(first.body.size[ids[0]]), np.cumsum(second.body.size[ids[1]])
    common = []
    for mine, other in (ends, ends[::-1]):
        there = np.zeros(len(whole) + 1, bool)
        there[other] = True
        # Tokens without bytes end where the one before does; a group ends with the last of them.
        common.append(np.flatnonzero(there[mine] & np.append(mine[1:] != mine[:-1], True)))
    return Alignment(*ids, *common)


def text_measures(docs: DataFrame, first_path: str, second_path: str, text_col: str = "text") -> DataFrame:
    """(text_sha256, copies, n_a, n_b, groups_sha256, pairs, times) of every distinct text that is not empty.

    ``pairs`` are the distinct pairs of the text and ``times`` their number of occurrences in it.
    """
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    kind = "text_sha256 binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
    names = [x.split()[0] for x in kind.split(", ")]

    def coded(texts):
        (encode_a, first), (encode_b, second) = first_tokenizer(first_path), second_tokenizer(second_path)
        marked = _marked(first_path, second_path)
        raw = [t.encode() for t in texts]
        for text, a, b in zip(raw, encode_a([" " + t for t in texts]), encode_b(texts), strict=True):
            found = aligned(text, a, b, first, second)
            key = hashlib.sha256(text).digest()
            if found is None:
                yield key, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
            else:
                pairs, times = np.unique(found.pairs, return_counts=True)
                yield key, len(found.a), len(found.b), len(found.a_ends), hashlib.sha256(found.groups(marked, first.entries, second.entries)).hexdigest(), pairs, times

    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                end, size = at, 0
                while end < batch.num_rows and (end == at or size < TEXT_BYTES):
                    size += len(batch.column(0)[end].as_buffer())
                    end += 1
                rows = list(coded(batch.column(0).slice(at, end - at).to_pylist()))
                key, n_a, n_b, groups, digest, pairs, times = zip(*rows, strict=True)
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(x).astype(t))) for x, t in ((pairs, np.int64), (times, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), batch.column(1).slice(at, end - at), *[pa.array(x, pa.int64()) for x in (n_a, n_b, groups)], pa.array(digest, pa.string()), *lists], names)
                at = end
        pa.default_memory_pool().release_unused()

    return texts.where("text <> ''").mapInArrow(run, kind)


def pair_counts(measures: DataFrame) -> DataFrame:
    """(pair, n, best): links of the whole corpus that hold each pair, and whether no pair with the same B id has more."""

    def run(batches):
        held, weights = [], []
        waiting = 0

        def summed():
            pairs, at = np.unique(np.concatenate(held), return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, at, np.concatenate(weights))
            return pairs, total

        for batch in batches:
            pairs, times = batch.column(1), batch.column(2)
            size = np.diff(pairs.offsets.to_numpy())
            copies = np.repeat(batch.column(0).to_numpy(), size)
            held.append(pairs.flatten().to_numpy())
            weights.append(times.flatten().to_numpy().astype(np.int64) * copies)
            waiting += len(copies)
            if waiting >= PAIRS_AT_ONCE:
                one, total = summed()
                held, weights, waiting = [one], [total], 0
                if len(one) >= PAIRS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(total)], ["pair", "n"])
                    held, weights = [], []
        if held:
            one, total = summed()
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(total)], ["pair", "n"])

    counts = measures.select("copies", "pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("b", F.col("pair") % PAIR_BASE), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return stored(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def frequent(pairs: DataFrame) -> int:
    """The smallest power of two such that at most ``HOT_PAIRS`` pairs occur that often; 1 if all of them fit."""
    power = F.floor(F.log2("n")).cast("int")
    total = 0
    rows = {r["power"]: r["pairs"] for r in pairs.groupBy(power.alias("power")).agg(F.count("*").alias("pairs")).collect()}  # at most 63 rows
    for k in sorted(rows, reverse=True):
        total += rows[k]
        if total > HOT_PAIRS:
            return 1 << (k + 1)
    return 1


def scored(measures: DataFrame, pairs: DataFrame) -> DataFrame:
    """(text_sha256, n_links, n_best, count_sum): sums over the links of every text."""
    least = frequent(pairs)
    single = measures.select("text_sha256", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("text_sha256", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    sums = [F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    if least == 1:
        return single.join(F.broadcast(pairs), "pair").groupBy("text_sha256").agg(*sums)
    met = single.join(F.broadcast(pairs.where(F.col("n") >= least)), "pair", "left")
    hot = met.where("n is not null").groupBy("text_sha256").agg(*sums)
    rest = met.where("n is null").select("text_sha256", "pair", "times").join(pairs.where(F.col("n") < least), "pair").groupBy("text_sha256").agg(*sums)
    return hot.unionByName(rest).groupBy("text_sha256").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])


def align_documents(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    measures = stored(text_measures(docs, first_path, second_path, text_col), "text-measures")
    pairs = pair_counts(measures)
    whole = measures.select("text_sha256", "n_a", "n_b", "n_groups", "groups_sha256").join(scored(measures, pairs), "text_sha256", "left")
    ids = id_and_text(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_sha256"))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return ids.join(whole, "text_sha256", "left").select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
