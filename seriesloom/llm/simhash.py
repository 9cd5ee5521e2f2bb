"""Near copies by SimHash: components of documents whose fingerprints differ in few bits, found by pigeonring filtering.

A fingerprint is cut into ``SEGMENTS`` segments that lie on a ring. Of two fingerprints with at most d differing bits, one
segment i exists from which every chain of l consecutive segments holds at most ``l * d / SEGMENTS`` of the differences
(the ring form of the pigeonhole principle). So for every start the chain of the next segments is an index key, from which
those segments are left out that its budgets allow to differ: with 16 segments and 4 bits a chain of 3 must agree whole, of
7 but for one of its last four segments, of 11 but for two. Pairs that share a key are then held against the budgets of
longer chains from that start, and only those that stay within all of them reach the full Hamming check. The length of the
chain follows from the counted number of fingerprints, by the rows it costs and the strangers it lets in (``chain_plan``);
every choice finds all links.

Only distinct fingerprints are indexed, so copies cost nothing. The members of a key are dealt into blocks by its counted
size, and every pair of blocks is one group of bounded size, which gives a spanning forest of its links, not the links:
rows stay linear in the members, and no link between components is lost.

Null and empty texts, and texts without words, have the fingerprint zero, which links like any other. Rows are judged by
text: repeated rows and ids get a row each. A null id never names a component unless all its members lack one. Extra columns
are not read. A long text is read in slices, so a task holds one text and a bounded number of its shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import connected, id_and_text, stored

WORDS, SEED = 4, 42
DISTANCE, SEGMENTS, BITS = 4, 16, 64
WIDTH = BITS // SEGMENTS
#: Bytes of one text that are split into words at a time, and shingle hashes that are summed at a time.
SLICE_BYTES, HASHES_AT_ONCE = 1 << 20, 1 << 17
#: Members of a block; a group holds two blocks at most.
BLOCK = 2048

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: The eight bits of a byte as eight counters of a byte each.
_SPREAD = np.array([sum(((x >> k) & 1) << (8 * k) for k in range(8)) for x in range(256)], np.uint64)


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, in slices that repeat the last ``WORDS - 1`` words of the one before."""
    at, kept = 0, []
    while at < len(text):
        cut = _BLANK.search(text, at + SLICE_BYTES) if len(text) - at > SLICE_BYTES else None
        end = cut.start() if cut else len(text)
        words = kept + text[at:end].translate(_LOWER).split()
        yield words
        kept, at = words[len(words) - (WORDS - 1) :] if len(words) >= WORDS else words, end


def shingle_hashes(text: bytes) -> Iterator[bytes]:
    """Big-endian XXH64 of the shingles of a text, slice by slice; of all its words where they are fewer than a shingle has."""
    digest, most, words = xxhash.xxh64_digest, 0, []
    for words in word_slices(text):
        if len(words) >= WORDS:
            most = WORDS
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            spans = zip((ends - sizes)[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist(), strict=True)
            yield b"".join([digest(joined[a:b], SEED) for a, b in spans])
    if words and not most:
        yield digest(b" ".join(words), SEED)


def bit_counts(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text the number of its hashes (rows of 8 bytes, big-endian) in which each bit is set, lowest bit first."""
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros((len(ends), BITS), np.int64)
    full = np.flatnonzero(ends > starts)
    if not len(full):
        return out
    # A counter of one byte holds 255 ones, so texts are summed in runs of that many hashes.
    runs = -(-(ends[full] - starts[full]) // 255)
    first = np.cumsum(runs) - runs
    heads = np.repeat(starts[full] - first * 255, runs) + np.arange(runs.sum()) * 255
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[hashes[:, 7 - k]], heads)
        out[full, 8 * k : 8 * k + 8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print) of every row; a bit of ``print`` is set if it is set in over half of the shingles' hashes."""

    def run(batches):
        for batch in batches:
            counts, total = np.zeros((batch.num_rows, BITS), np.int64), np.zeros(batch.num_rows, np.int64)
            held: list[bytes] = []
            rows: list[int] = []
            sizes: list[int] = []
            waiting = 0

            def add():
                hashes = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8)
                np.add.at(counts, rows, bit_counts(hashes, np.cumsum(sizes)))  # noqa: B023
                np.add.at(total, rows, sizes)  # noqa: B023

            for i, text in enumerate(batch.column(1)):
                for part in shingle_hashes(text.as_py().encode()):
                    held.append(part)
                    rows.append(i)
                    sizes.append(len(part) // 8)
                    waiting += len(part) // 8
                    if waiting >= HASHES_AT_ONCE:
                        add()
                        held, rows, sizes, waiting = [], [], [], 0
            if held:
                add()
            bits = (2 * counts > total[:, None]).astype(np.uint8)
            prints = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, print long")


@dataclass(frozen=True)
class ChainPlan:
    """Index keys: ``length`` segments from every start, without the ones that may differ (``left_out``, relative to the start)."""

    length: int
    left_out: tuple[tuple[int, ...], ...]

    @property
    def slots(self) -> list[tuple[int, int, int]]:
        """(slot, bits of rotation, mask over the chain's bits) of every key of a fingerprint."""
        out = []
        for start in range(SEGMENTS):
            for away in self.left_out:
                mask = sum(((1 << WIDTH) - 1) << (WIDTH * (self.length - 1 - k)) for k in range(self.length) if k not in away)
                out.append((len(out), WIDTH * start, mask))
        return out


def budget(length: int, distance: int = DISTANCE) -> int:
    """Differences that a chain of so many segments may hold."""
    return length * distance // SEGMENTS


def chain(length: int) -> ChainPlan:
    """The keys of a chain: all largest sets of segments that may differ without any prefix exceeding its budget."""
    fits = lambda away: all(sum(k < n for k in away) <= budget(n) for n in range(1, length + 1))
    return ChainPlan(length, tuple(x for x in combinations(range(length), budget(length)) if fits(x)))


#: The longest chains for each budget.
LENGTHS = tuple(n for n in range(1, SEGMENTS) if budget(n) < budget(n + 1) and budget(n) < 3)


def chain_plan(n: int) -> ChainPlan:
    """The cheapest chain for ``n`` fingerprints: its keys, each with the strangers that share it by chance."""
    return min(map(chain, LENGTHS), key=lambda c: len(c.slots) * (1 + n / 2.0 ** (WIDTH * (c.length - budget(c.length)))))


def chain_keys(prints: DataFrame, plan: ChainPlan) -> DataFrame:
    """(print, key): a row for each start and set of segments left out; the key holds its slot and the chain's bits."""
    bits = WIDTH * plan.length
    slots = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("slot"), F.lit(r).alias("turn"), F.lit(m).cast("long").alias("mask")) for k, r, m in plan.slots])).alias("s")
    turned = f"shiftrightunsigned(shiftleft(print, s.turn) | shiftrightunsigned(print, {BITS} - s.turn), {BITS - bits})"
    return prints.select("print", slots).select("print", F.expr(f"shiftleft(s.slot, {bits}) | ({turned} & s.mask)").alias("key"))


def forest(members: np.ndarray, start: int, length: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links connect among the members of a key whose chain begins at bit ``start``.

    A search takes one member at a time and compares it with those that no tree holds yet: first the chains that begin at
    the key's start, each against its budget, then all bits.
    """
    turned = (members << np.uint64(start)) | (members >> np.uint64((BITS - start) % BITS)) if start else members
    checks = [(np.uint64(BITS - WIDTH * n), budget(n, distance)) for n in (*LENGTHS, *range(LENGTHS[-1] + 1, SEGMENTS + 1)) if n >= length and (n == SEGMENTS or budget(n, distance) < budget(n + 1, distance))]
    free = np.arange(len(turned))
    us, vs = [], []
    while len(free):
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            u = queue.pop()
            apart = turned[free] ^ turned[u]
            at = np.arange(len(free))
            for shift, most in checks:
                at = at[np.bitwise_count(apart[at] >> shift) <= most]
            if len(at):
                near = free[at]
                us.append(np.full(len(near), members[u]))
                vs.append(members[near])
                queue += near.tolist()
                free = np.delete(free, at)
    none = np.zeros(0, np.uint64)
    return np.concatenate([*us, none]), np.concatenate([*vs, none])


def links(prints: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """(u, v): links between the ``n`` distinct fingerprints of ``prints`` (print) that connect all that any link connects."""
    if distance > DISTANCE:
        raise ValueError(f"the chains hold for {DISTANCE} bits or fewer")
    plan = chain_plan(n)
    keys = chain_keys(prints, plan)
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    # The planner does not see how many keys a fingerprint has, so it would take either side for a small one.
    dealt = keys.join(shared.hint("merge"), "key").select("key", "print", parts.alias("parts"), F.pmod(F.xxhash64("print"), parts).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = dealt.select("key", "print", "own", other).select("key", "print", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    groups = met.groupBy("key", "x", "y").agg(F.collect_list("print").alias("members")).where(F.size("members") > 1)
    starts = {slot: turn for slot, turn, _ in plan.slots}
    bits = WIDTH * plan.length

    def run(batches):
        for batch in batches:
            us, vs = [], []
            for key, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                u, v = forest(members.values.to_numpy().view(np.uint64), starts[key >> bits], plan.length, distance)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64), pa.int64()) if x else pa.array([], pa.int64()) for x in (us, vs)], ["u", "v"])

    return groups.select("key", "members").mapInArrow(run, "u long, v long").distinct()


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: component_id is the smallest id that links reach, itself included."""
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    nodes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "print-nodes")
    edges = stored(links(nodes.select("print"), nodes.count(), distance), "print-links")
    roots = connected(edges, "prints").withColumnRenamed("node", "print")
    named = nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "root").select("print", "component_id"), "print").select("doc_id", as_hex(F.col("print")).alias("fingerprint"), "component_id")
