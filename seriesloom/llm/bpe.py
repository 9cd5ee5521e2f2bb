"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark tasks.

Each task splits its texts into pieces (letters, digits, other signs, white space), keeps the distinct ones, and lets one
recursive query contract them: rows of (piece, position, token) join the merge table, the leftmost pair of the lowest rank
of each piece is replaced, and pieces without such a pair leave the recursion. Decoding is an ordered aggregation of the
tokens' bytes. Work per task is bounded by ``TEXT_BYTES`` of text; encoded pieces are remembered per worker up to
``REMEMBERED`` and then forgotten, which changes speed only. They lie in flat arrays, and new ones are encoded
``PIECES_AT_ONCE`` at a time: a worker shares its executor's memory with what earlier stages left there.

Null texts are empty and give no tokens. Repeated rows and null ids give a row each. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import given_back, id_and_text, pieces, span_hashes, text_chunks

REMEMBERED = 600_000
TEXT_BYTES = 1 << 19
#: Pieces that one recursive query contracts.
PIECES_AT_ONCE = 20_000

ENCODE = """
WITH RECURSIVE state(piece, toks) AS (
    SELECT piece, toks FROM seed
    UNION ALL
    SELECT state.piece, state.toks[: best.at % 65536 - 1] || [CAST(best.at // 65536 AS INTEGER)] || state.toks[best.at % 65536 + 2 :]
    FROM state JOIN (
        SELECT piece, min(CAST(merges.merged AS BIGINT) * 65536 + pos) AS at
        FROM (SELECT piece, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, unnest(range(1, len(toks))) AS pos FROM state) pairs
        JOIN merges ON merges.l = pairs.l AND merges.r = pairs.r
        GROUP BY piece
    ) best ON state.piece = best.piece
)
SELECT piece, arg_min(toks, len(toks)) AS toks FROM state GROUP BY piece ORDER BY piece
"""
#: Bytes of a piece from which one round takes all equal pairs.
LONG_PIECE = 2000

DECODE = """
SELECT piece, string_agg(vocabulary.hex, '' ORDER BY pos) AS hex
FROM (SELECT piece, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos FROM coded) t
JOIN vocabulary ON vocabulary.token = t.token
GROUP BY piece ORDER BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Coder:
    """The vocabulary of one rank file, its merge table in DuckDB, and the pieces encoded so far."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.tokens = set(self.ranks.values())
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        whole = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32())})
        words = pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self.con.register("merge_rows", whole)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.con.register("word_rows", words)
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM word_rows")
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)
        self.first_id = np.zeros(0, np.int64)
        self.n_ids = np.zeros(0, np.int32)
        self.decoded = np.zeros(0, np.uint8)
        self.first_byte = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int32)
        self.written: list[bytes] = []

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece: whole if it is a token, else by the recursive query."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        rest = []
        for i, w in enumerate(words):
            rank = self.ranks.get(w)
            if rank is not None:
                out[i] = np.array([rank], np.int32)
            elif w:
                rest.append(i)
        rest.sort(key=lambda i: len(words[i]))
        at = 0
        while at < len(rest):
            end, size = at, 0
            # Every round of the recursion repeats the rest of a piece, so that the square of its length counts.
            while end < len(rest) and end - at < PIECES_AT_ONCE and (end == at or size + len(words[rest[end]]) ** 2 <= 256 * PIECES_AT_ONCE):
                size += len(words[rest[end]]) ** 2
                end += 1
            part = rest[at:end]
            if len(words[part[-1]]) > LONG_PIECE:
                for i in part:
                    out[i] = self.encode_long(words[i])
            else:
                for i, toks in zip(part, self._contract([words[i] for i in part]), strict=True):
                    out[i] = toks
            at = end
        return out

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        lengths = np.array([len(w) for w in words])
        toks = pa.array(self.bytes[np.frombuffer(b"".join(words), np.uint8)])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), toks)
        self.con.register("seed", pa.table({"piece": pa.array(np.arange(len(words), dtype=np.int32)), "toks": lists}))
        rows = self.con.sql(ENCODE).to_arrow_table()
        self.con.unregister("seed")
        got = rows.column("toks").combine_chunks()
        values, ends = got.flatten().to_numpy(zero_copy_only=False).astype(np.int32), got.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        return [values[ends[i] : ends[i + 1]] for i in range(len(words))]

    def encode_long(self, word: bytes) -> np.ndarray:
        """One very long piece: as the recursion, but every occurrence of the lowest rank goes in one round.

        All leftmost, non-overlapping occurrences of the pair of lowest rank are merged together: merging one of them can
        only create pairs of a higher rank or later in the text, so the leftmost-first order takes the rest next.
        """
        toks = self.bytes[np.frombuffer(word, np.uint8)].astype(np.int64)
        while len(toks) > 1:
            self.con.register("line", pa.table({"pos": pa.array(np.arange(len(toks) - 1)), "l": pa.array(toks[:-1]), "r": pa.array(toks[1:])}))
            best = self.con.execute("SELECT merged, list(pos ORDER BY pos) FROM line JOIN merges USING (l, r) GROUP BY merged ORDER BY merged LIMIT 1").fetchall()
            self.con.unregister("line")
            if not best:
                break
            rank, at = best[0][0], np.array(best[0][1])
            run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
            first = np.searchsorted(run, run)
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            # One merge at a time where it makes a pair of its own or a lower rank.
            merged = np.delete(_with(toks, at, rank), at + 1)
            if len(at) > 1 and self._lower(np.concatenate([merged, [rank, toks[at[0]]]]), rank):
                at = at[:1]
                merged = np.delete(_with(toks, at, rank), at + 1)
            toks = merged
        return toks.astype(np.int32)

    def _lower(self, toks: np.ndarray, rank: int) -> bool:
        """Whether some pair now has a rank below ``rank``."""
        self.con.register("line", pa.table({"l": pa.array(toks[:-1]), "r": pa.array(toks[1:])}))
        found = self.con.execute("SELECT count(*) FROM line JOIN merges USING (l, r) WHERE merged < ?", [int(rank)]).fetchall()[0][0]
        self.con.unregister("line")
        return bool(found)

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """Bytes of each id list; an id outside the vocabulary is an error."""
        out = [b""] * len(lists)
        full = [i for i, x in enumerate(lists) if len(x)]
        if full:
            lengths = [len(lists[i]) for i in full]
            toks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.concatenate([lists[i] for i in full]).astype(np.int32)))
            self.con.register("coded", pa.table({"piece": pa.array(full, pa.int64()), "toks": toks}))
            rows = self.con.execute(DECODE).fetchall()
            self.con.unregister("coded")
            for i, text in rows:
                out[i] = bytes.fromhex(text)
            unknown = set(np.unique(np.concatenate([lists[i] for i in full])).tolist()) - self.tokens
            if unknown:
                raise ValueError(f"ids outside the vocabulary: {sorted(unknown)[:5]}")
        return out

    def slots_of(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each piece among the remembered ones; new pieces are encoded and decoded first."""
        hashes = span_hashes(body, starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) and len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        there = at < len(self.known)
        there[there] = self.known[at[there]] == distinct[there]
        new = np.flatnonzero(~there)
        if len(new):
            begin = len(self.n_ids)
            for k in range(0, len(new), PIECES_AT_ONCE):
                own = first[new[k : k + PIECES_AT_ONCE]]
                self._remember([body[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            self.known = np.insert(self.known, at[new], distinct[new])
            self.slots = np.insert(self.slots, at[new], np.arange(begin, begin + len(new), dtype=np.int32))
            at = np.searchsorted(self.known, distinct)
        return self.slots[at][inverse]

    def _remember(self, words: list[bytes]) -> None:
        """Ids and decoded bytes of new pieces, after those of the pieces before."""
        ids = self.encode(words)
        back = self.decode(ids)
        n_ids, lengths = (np.array([len(x) for x in each], np.int32) for each in (ids, back))
        self.first_id = np.concatenate([self.first_id, len(self.ids) + np.cumsum(n_ids, dtype=np.int64) - n_ids])
        self.first_byte = np.concatenate([self.first_byte, len(self.decoded) + np.cumsum(lengths, dtype=np.int64) - lengths])
        self.ids = np.concatenate([self.ids, *ids])
        self.decoded = np.concatenate([self.decoded, np.frombuffer(b"".join(back), np.uint8)])
        self.n_ids, self.lengths = np.concatenate([self.n_ids, n_ids]), np.concatenate([self.lengths, lengths])

    def write_out(self) -> list[bytes]:
        """Decimal ids of every remembered piece, each with a blank after it; made when first asked for."""
        for k in range(len(self.written), len(self.n_ids)):
            self.written.append("".join(f"{i} " for i in self.ids[self.first_id[k] : self.first_id[k] + self.n_ids[k]].tolist()).encode())
        return self.written

    def ids_of(self, slots: np.ndarray) -> np.ndarray:
        """Token ids of the given pieces, one after the other."""
        return self.ids[_runs(self.first_id[slots], self.n_ids[slots])]

    def bytes_of(self, slots: np.ndarray) -> np.ndarray:
        """Decoded bytes of the given pieces, one after the other."""
        return self.decoded[_runs(self.first_byte[slots], self.lengths[slots])]


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of runs of ``n`` entries from ``first`` on."""
    n = n.astype(np.int64)
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _with(toks: np.ndarray, at: np.ndarray, value: int) -> np.ndarray:
    out = toks.copy()
    out[at] = value
    return out


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


_KIND: list[np.ndarray] = []
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3


def kinds() -> np.ndarray:
    """Class of every code point, from the Unicode tables of the pattern library."""
    if not _KIND:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m.group()[0]), ord(m.group()[-1])
                if a < 0xD800 <= b:
                    out[a:0xD800] = kind
                    a = 0xE000
                out[a : b + 1] = kind
        _KIND.append(out)
    return _KIND[0]


def split_pieces(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pieces of all texts, and the number of pieces per text.

    The pattern in words: an English short form such as ``'ll``; else letters, digits or other signs, each with one
    blank before; else white space, of which the last sign stays apart if text follows.
    """
    n = len(offsets) - 1
    if len(body) == 0:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    lead = np.flatnonzero((body & 0xC0) != 0x80)
    points = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = kinds()[points]
    size = len(points)
    doc_at = np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])
    edge = np.zeros(size + 1, bool)
    edge[doc_at] = True
    edge[size] = True
    run = edge.copy()
    run[1:size] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(run[:size])
    ends = np.append(starts[1:], size)
    space = kind[starts] == SPACE
    begin = np.zeros(size + 1, bool)
    begin[starts[space]] = True
    begin[ends[space & ~edge[ends]] - 1] = True
    solid = starts[~space]
    after_blank = (solid > 0) & ~edge[solid] & (points[np.maximum(solid - 1, 0)] == 0x20)
    begin[solid[~after_blank]] = True
    # Short forms: a lone apostrophe that no blank joins, before letters of the same text.
    lone = starts[(kind[starts] == OTHER) & (ends - starts == 1) & (points[starts] == 0x27)]
    lone = lone[begin[lone] & ~edge[lone + 1]]
    padded = np.concatenate([points, np.zeros(3, np.uint32)])
    one = padded[lone + 1]
    two = np.where(edge[np.minimum(lone + 2, size)], 0, padded[lone + 2])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    begin[lone[short | long] + 1] = False
    begin[lone[short] + 2] = True
    begin[lone[long] + 3] = True
    begin[size] = False
    at = lead[np.flatnonzero(begin[:size])]
    return at, np.diff(np.searchsorted(at, offsets))


def coded_chunks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple]:
    """(doc ids, offsets, coder, decoded bytes, slots of all pieces, piece bounds per text), verified against the text."""
    c = coder(path)
    for ids, body, offsets in text_chunks(batches, TEXT_BYTES):
        starts, counts = split_pieces(body, offsets)
        ends = np.append(starts[1:], len(body))
        slots = c.slots_of(body, starts, ends)
        back = c.bytes_of(slots)
        if not np.array_equal(c.lengths[slots], ends - starts) or not np.array_equal(back, body):
            raise ValueError("two pieces share a 64-bit hash: encode this partition with another hash base")
        yield ids, offsets, c, back, slots, np.concatenate([[0], np.cumsum(counts)])
        given_back()


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every whole text."""

    def run(batches):
        for ids, _, c, _, slots, bounds in coded_chunks(batches, path):
            values = c.ids_of(slots)
            each = np.concatenate([[0], np.cumsum(c.n_ids[slots])])[bounds]
            lists = pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(each).astype(np.int64)), lists], ["doc_id", "n_tokens", "token_ids"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>")


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text as binary) of every list of ids; a null list is empty, an unknown id is an error."""

    def run(batches):
        c = coder(path)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            size = np.concatenate([[0], np.cumsum([4 * len(x) for x in lists])])
            for a, b in pieces(size):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(c.decode(lists[a:b]), pa.binary())], ["doc_id", "text"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("token_ids")).mapInArrow(run, "doc_id long, text binary")


def encoded_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the decoded bytes, made where they arise."""

    def run(batches):
        for ids, offsets, c, decoded, slots, bounds in coded_chunks(batches, path):
            place, total = slots.tolist(), np.concatenate([[0], np.cumsum(c.n_ids[slots])])[bounds]
            coded, back, written = [], [], c.write_out()
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                coded.append(hashlib.sha256(b"".join(map(written.__getitem__, place[a:b]))[:-1]).hexdigest())
                back.append(hashlib.sha256(decoded[offsets[i] : offsets[i + 1]]).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(total).astype(np.int64)), pa.array(coded), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
