"""Documents whose sets of word shingles overlap: an exact Jaccard join and its connected components.

Equal sets are one class from the start. A class of sets of similar size (a band and the next one) splits the universe of
shingle hashes into ranges, one segment each. Two sets that link differ in at most H shingles, so that of m segments at
least m - H agree. Both sides index their H + 1 heaviest segments by one order that a segment's content fixes (size, then
hash): two sets with m - H common segments meet in these. Where H is 1 the whole set and its one-deletion neighbours are
indexed instead, if that costs less (``allocation``). Sets that share an index entry are candidates; their shingles are
compared exactly.

Index entries are packed by hash range, so a common segment of many sets costs 12 bytes a set. Buckets of up to
``SMALL_BUCKET`` sets give their pairs; larger ones a star around their smallest member. Each set is first compared with
the partner it meets most often. Components then leave only pairs between different components: first of the stored
candidates, then of large buckets, in rounds. There every set tries the nearest set of another component; what links is
merged before the next round, and only if nothing links does a set try more partners at once. So rows stay linear in the
members while anything links, copies cost one comparison each, and no link is lost: the rounds end when no untried pair
between components is left. Large buckets are dealt into blocks, and a task compares two of them at a time. Sets of one
cluster meet in many buckets: these go to the same task, where each set names its nearest partners of all of them once.
Before texts are read again, sizes and sketches (parities of shingles by hash, four bits a shingle or more) rule out all
pairs but those near the limit.

Hashes have 64 bits: sets are equal if two independent 64-bit sums agree, and shingles if their hashes do.
Null or empty texts and texts without words have no shingles and link with nothing; fewer than five words are one
shingle. Rows are judged by text: repeated rows and repeated ids get a row each. A null id never names a component unless
all its members lack one. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import connected, id_and_text, lean, mix, span_hashes, text_chunks, words_of
from seriesloom.llm.common import stored_in_small_batches as stored

WORDS = 5
#: Bytes of text whose shingles a task makes at a time.
TEXT_BYTES = 1 << 19
#: Bytes of the smallest sketch and of the largest one; between them a sketch has four to eight bits a shingle.
BINS, MOST_BINS = 128, 1 << 14
SMALL_BUCKET = 16
#: Index entries that a task keeps before it hands them on, and their layout.
ENTRIES_AT_ONCE = 500_000
ENTRY = np.dtype([("rest", "<u4"), ("key", "<i8")])
#: Shingles whose entries go to one task, and to one part of its work.
SHINGLES_A_TASK, SHINGLES_A_PART = 2_000_000, 200_000
#: Members of a block of a large bucket; a task compares two blocks at a time.
BLOCK = 1024
#: Partners of a set that a round of large buckets tries, and how much more the next one does if none links.
FIRST_PARTNERS, MORE_PARTNERS = 2, 16
#: Comparisons of sketches in the buckets of one cluster that go to one task.
COMPARISONS_A_TASK = 50_000_000
#: Partners of sets of large buckets that a task holds before it hands pairs on, each told once, and their layouts.
PAIRS_AT_ONCE = 1_000_000
PARTNER = np.dtype([("node", "<i8"), ("other", "<i8"), ("apart", "<i4"), ("more", "?")])
PAIR = np.dtype([("u", "<i8"), ("v", "<i8"), ("more", "?")])
#: Set keys that a task remembers, so that copies are indexed once.
SEEN_AT_ONCE = 200_000
#: Ids of candidate sets up to which they are broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000
#: Share of common shingles and number of sets that the costs of the two kinds of index assume.
COMMON_SHARE, COMMON_SETS = 0.1, 1000.0

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(body: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the bounds of each text among them."""
    lowered = np.where((body >= 65) & (body <= 90), body + 32, body).astype(np.uint8)
    begins, stops, first = words_of(lowered, offsets, (lowered == 32) | ((lowered >= 9) & (lowered <= 13)))
    hashes = span_hashes(lowered, begins, stops)
    counts = np.diff(first)
    whole = np.flatnonzero((counts > 0) & (counts < words))
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(bounds[-1], np.uint64)
    if len(hashes) >= words:
        rolled = np.zeros(len(hashes) - words + 1, np.uint64)
        for k in range(words):
            rolled += hashes[k : len(hashes) - words + 1 + k] * (_MULTIPLIERS[k % 5] + np.uint64(2 * (k // 5)))
        full = counts >= words
        at = np.repeat(first[:-1][full] - bounds[:-1][full], n[full])
        place = np.repeat(full, n)
        out[place] = mix(rolled[at + np.flatnonzero(place)])
    for i in whole.tolist():
        own = hashes[first[i] : first[i + 1]]
        out[bounds[i]] = mix(np.array([(own * _MULTIPLIERS[: len(own)]).sum() + np.uint64(len(own))], np.uint64))[0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][n > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def set_keys(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set; 0 for an empty one."""
    n = np.diff(bounds)
    keys = np.zeros((2, len(n)), np.int64)
    full = n > 0
    for row, salt in enumerate((0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)):
        if len(shingles):
            sums = np.add.reduceat(mix(shingles ^ np.uint64(salt)), bounds[:-1][full])
            keys[row, full] = mix(sums + n[full].astype(np.uint64)).view(np.int64)
    return keys[0], keys[1]


def set_sketches(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of the shingles by the low bits of a hash, as bytes of all sets and the bounds of each set; none for an empty one.

    A shingle of only one of two sets turns one bit, so sketches differ in no more bits than the sets do in shingles. The
    halves of a sketch combined by exclusive or are the sketch of half the length.
    """
    n = np.diff(bounds)
    size = np.minimum(np.maximum(1 << np.ceil(np.log2(np.maximum(n, 2) / 2)).astype(np.int64), BINS), MOST_BINS) * (n > 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    bit = (mix(shingles ^ np.uint64(0xA24BAED4963EE407)) & (np.repeat(size, n) * 8 - 1).astype(np.uint64)).astype(np.int64)
    sketch = np.zeros(ends[-1], np.uint8)
    np.bitwise_xor.at(sketch, np.repeat(ends[:-1], n) + (bit >> 3), np.uint8(1) << (bit & 7).astype(np.uint8))
    return sketch, ends


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches (64 bits an entry) as sketches of ``words`` entries."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of bits in which sketches of one length differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _by_length(sketches: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Length of each sketch in 64-bit entries, and for each length the sketches folded to it; rows of shorter ones are zero."""
    words = np.array([len(s) // 8 for s in sketches], np.int64)
    levels = {w: np.zeros((len(words), w), np.uint64) for w in np.unique(words).tolist()}
    for w in levels:
        own = np.flatnonzero(words == w)
        rows = np.frombuffer(b"".join(sketches[i] for i in own.tolist()), np.uint64).reshape(len(own), w)
        for v in levels:
            if v <= w:
                levels[v][own] = _folded(rows, v)
    return words, levels


def _near(n_a: np.ndarray, n_b: np.ndarray, a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Whether sizes and sketches leave a similarity of 0.8 possible."""
    words, levels = _by_length([*a, *b])
    at = len(a)
    both = np.minimum(words[:at], words[at:])
    near = 5 * np.minimum(n_a, n_b) >= 4 * np.maximum(n_a, n_b)
    for w in np.unique(both[near]).tolist():
        rows = np.flatnonzero(near & (both == w))
        near[rows] = 9 * _apart(levels[w][rows], levels[w][rows + at]) <= (n_a + n_b)[rows]
    return near


@dataclass(frozen=True)
class Allocation:
    """How sets of one class are indexed: number of segments, of entries kept, and whether neighbours are indexed."""

    differences: int
    segments: int
    kept: int
    neighbours: bool


@cache
def band_starts(limit: int = 1 << 40) -> tuple[int, ...]:
    """Smallest sizes of the bands: a set links with sets of its own band and of the two beside it only."""
    starts = [1]
    while starts[-1] < limit:
        starts.append(starts[-1] * 5 // 4 + 1)
    return tuple(starts)


@cache
def allocation(band: int) -> Allocation:
    """The cheaper index for pairs whose smaller set lies in ``band``: entries, each with its expected false partners."""
    most = band_starts()[band + 1] - 1
    h = (most + most * 5 // 4) // 9
    kept = h + 1
    segments = kept + -(-kept // 5)
    by_segments = kept * (1 + COMMON_SETS * COMMON_SHARE ** (most / segments))
    by_neighbours = (most + 1) * (1 + COMMON_SETS * COMMON_SHARE ** max(most - 1, 1))
    return Allocation(h, segments, kept, h == 1 and by_neighbours < by_segments)


def index_entries(shingles: np.ndarray, bounds: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set key) of all index entries of the given sets."""
    sizes = np.diff(bounds)
    own = np.searchsorted(band_starts(), sizes, "right") - 1
    out: list[np.ndarray] = []
    whose: list[np.ndarray] = []
    for shift in (0, 1):
        bands = own - shift
        for band in np.unique(bands[(sizes > 0) & (bands >= 0)]).tolist():
            plan = allocation(band)
            if plan.differences == 0:
                continue
            sets = np.flatnonzero((bands == band) & (sizes > 0))
            n = sizes[sets]
            each = np.concatenate([[0], np.cumsum(n)])
            tokens = shingles[np.repeat(bounds[sets] - each[:-1], n) + np.arange(each[-1])]
            mixed = mix(tokens ^ np.uint64(band * 2 + 1))
            if plan.neighbours:
                sums = np.add.reduceat(mixed, each[:-1])
                out += [mix(sums), mix(np.repeat(sums, n) - mixed)]
                whose += [keys[sets], np.repeat(keys[sets], n)]
                continue
            segment = ((tokens >> np.uint64(32)) * np.uint64(plan.segments)) >> np.uint64(32)
            place = np.repeat(np.arange(len(sets), dtype=np.int64) * plan.segments, n) + segment.astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            sums = np.add.reduceat(mixed, head)
            weight = np.zeros(len(sets) * plan.segments, np.int64)
            total = np.zeros(len(sets) * plan.segments, np.uint64)
            total[place[head]] = sums
            weight[place[head]] = np.diff(np.append(head, len(place)))
            number = np.tile(np.arange(plan.segments, dtype=np.uint64), len(sets))
            signature = mix(total + mix(number + np.uint64(band << 20))).reshape(len(sets), plan.segments)
            # One order for all sets: heavier segments first, then by signature.
            heavy = np.minimum(weight, 255).astype(np.uint64).reshape(len(sets), plan.segments)
            order = ((np.uint64(255) - heavy) << np.uint64(56)) | (signature >> np.uint64(8))
            if plan.kept < plan.segments:
                chosen = np.argpartition(order, plan.kept - 1, axis=1)[:, : plan.kept]
                signature = np.take_along_axis(signature, chosen, axis=1)
            out.append(signature.ravel())
            whose.append(np.repeat(keys[sets], plan.kept))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(whose)


def set_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, n_shingles, key, key2, sketch) of every row; text_key is a hash of the text."""

    def run(batches):
        for ids, body, offsets in text_chunks(batches, TEXT_BYTES):
            shingles, bounds = shingle_sets(body, offsets, words)
            key, key2 = set_keys(shingles, bounds)
            parities, ends = set_sketches(shingles, bounds)
            sketch = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(parities.tobytes())])
            yield pa.RecordBatch.from_arrays([ids.field(0), ids.field(1), pa.array(np.diff(bounds)), pa.array(key), pa.array(key2), sketch], ["doc_id", "text_key", "n_shingles", "key", "key2", "sketch"])

    named = id_and_text(docs, id_col, text_col).select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("id"), "text")
    return named.mapInArrow(lean(run), "doc_id long, text_key long, n_shingles long, key long, key2 long, sketch binary")


def packed_index(docs: DataFrame, parts: int, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(part, entries): index entries by hash range, many to a row."""

    def flush(signatures, keys):
        signature, key = np.concatenate(signatures), np.concatenate(keys)
        part = ((signature >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
        order = np.argsort(part.astype(np.int32), kind="stable")
        entries = np.empty(len(order), ENTRY)
        entries["rest"], entries["key"] = (signature[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), key[order]
        part = part[order].astype(np.int32)
        head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(head, len(part)) * ENTRY.itemsize
        packed = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(entries.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(part[head]), packed], ["part", "entries"])

    def run(batches):
        held, signatures, keys, seen = 0, [], [], set()
        for _, body, offsets in text_chunks(batches, TEXT_BYTES):
            shingles, bounds = shingle_sets(body, offsets, words)
            key, _ = set_keys(shingles, bounds)
            if len(seen) > SEEN_AT_ONCE:
                seen = set()
            new = np.zeros(len(key), bool)
            for i, (k, n) in enumerate(zip(key.tolist(), np.diff(bounds).tolist(), strict=True)):
                if n and k not in seen:
                    seen.add(k)
                    new[i] = True
            if not new.any():
                continue
            sizes = np.where(new, np.diff(bounds), 0)
            kept = np.repeat(new, np.diff(bounds))
            signature, whose = index_entries(shingles[kept], np.concatenate([[0], np.cumsum(sizes)]), key)
            signatures.append(signature)
            keys.append(whose)
            held += len(signature)
            if held >= ENTRIES_AT_ONCE:
                yield flush(signatures, keys)
                held, signatures, keys = 0, [], []
        if held:
            yield flush(signatures, keys)

    return docs.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).mapInArrow(lean(run), "part int, entries binary")


def buckets(index: DataFrame) -> DataFrame:
    """(members): sorted set keys that share an index entry, one row for each distinct group of two or more in a part.

    Rows of ``index`` come sorted by part, and a task holds the entries of one part.
    """

    def run(batches):
        part, held = None, []
        for batch in batches:
            for own, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != part and held:
                    yield from _shared(np.concatenate(held))
                    held = []
                part = own
                held.append(np.frombuffer(packed.as_buffer(), ENTRY))
        if held:
            yield from _shared(np.concatenate(held))

    return index.mapInArrow(lean(run), "members array<long>")


def _shared(entries: np.ndarray):
    """The groups of set keys with equal entries, among the entries of one part."""
    # Entries that meet no other go first; the others are few.
    order = np.argsort(entries["rest"])
    place = entries["rest"][order]
    twin = np.zeros(len(place), bool)
    twin[1:] = place[1:] == place[:-1]
    twin[:-1] |= twin[1:]
    place, key = place[twin], entries["key"][order[twin]]
    order = np.lexsort((key, place))
    place, key = place[order], key[order]
    first = np.ones(len(place), bool)
    first[1:] = (place[1:] != place[:-1]) | (key[1:] != key[:-1])
    place, key = place[first], key[first]
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    ends = np.append(head[1:], len(place))
    told: set[bytes] = set()
    group: list[np.ndarray] = []
    for a, b in zip(head[ends - head > 1].tolist(), ends[ends - head > 1].tolist(), strict=True):
        name = key[a:b].tobytes()
        if name not in told:
            told.add(name)
            group.append(key[a:b])
            if len(group[-1]) > 100_000 or len(group) >= 10_000:
                yield _lists(group)
                group = []
        if len(told) > 100_000:
            told = set()
    if group:
        yield _lists(group)


def _lists(group: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(g) for g in group])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(group)))], ["members"])


def pairs_of(groups: DataFrame) -> DataFrame:
    """(u, v, met): all pairs of small groups and the star of large ones, with the number of groups they meet in."""

    def run(batches):
        for batch in batches:
            us, vs = [], []
            for members in batch.column(0):
                own = members.values.to_numpy()
                if len(own) <= SMALL_BUCKET:
                    i, j = np.triu_indices(len(own), 1)
                    us.append(own[i])
                    vs.append(own[j])
                else:
                    us.append(np.full(len(own) - 1, own[0]))
                    vs.append(own[1:])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*us, np.zeros(0, np.int64)])), pa.array(np.concatenate([*vs, np.zeros(0, np.int64)]))], ["u", "v"])

    return groups.mapInArrow(lean(run), "u long, v long").groupBy("u", "v").agg(F.count("*").alias("met"))


def _nearest(node: np.ndarray, top: np.ndarray, n: np.ndarray, sketches: list[bytes], partners: int) -> np.ndarray:
    """For each of the sets its ``partners`` nearest ones of other components, as ``PARTNER``."""
    words, levels = _by_length(sketches)
    least = min(levels)
    # A folded sketch differs by no more than the sketch does, and takes a quarter of the time.
    coarse = _folded(levels[least], max(least // 4, 1))
    out = [np.zeros(0, PARTNER)]
    for i in range(len(node)):
        at = np.flatnonzero((top != top[i]) & (5 * np.minimum(n[i], n) >= 4 * np.maximum(n[i], n)))
        at = at[9 * _apart(coarse[i], coarse[at]) <= n[i] + n[at]]
        apart, both = np.zeros(len(at), np.int64), np.minimum(words[i], words[at])
        for w in np.unique(both).tolist():
            rows = both == w
            apart[rows] = _apart(levels[w][i], levels[w][at[rows]])
        near = 9 * apart <= n[i] + n[at]
        at, apart = at[near], apart[near]
        more = len(at) > partners
        if more:
            chosen = np.lexsort((node[at], apart))[:partners]
            at, apart = at[chosen], apart[chosen]
        own = np.zeros(len(at), PARTNER)
        own["node"], own["other"], own["apart"], own["more"] = node[i], node[at], apart, more
        out.append(own)
    return np.concatenate(out)


def _nearest_of_all(held: list[np.ndarray], partners: int) -> np.ndarray:
    """The ``partners`` nearest of each set among its partners in several buckets; ``more`` if any row says so or one is left out."""
    rows = np.concatenate(held)
    rows = rows[np.lexsort((~rows["more"], rows["other"], rows["apart"], rows["node"]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows["node"][1:] != rows["node"][:-1]) | (rows["other"][1:] != rows["other"][:-1])
    more = np.unique(rows["node"][rows["more"]])
    rows = rows[first]
    head = np.flatnonzero(np.concatenate([[True], rows["node"][1:] != rows["node"][:-1]])) if len(rows) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(rows)))
    rank = np.arange(len(rows)) - np.repeat(head, count)
    rows["more"] = np.isin(rows["node"], more) | np.repeat(count > partners, count)
    return rows[rank < partners]


def _pairs(rows: np.ndarray) -> np.ndarray:
    """``PARTNER`` rows as ``PAIR``."""
    out = np.zeros(len(rows), PAIR)
    out["u"], out["v"], out["more"] = np.minimum(rows["node"], rows["other"]), np.maximum(rows["node"], rows["other"]), rows["more"]
    return out


def _told_once(rows: np.ndarray) -> np.ndarray:
    """Each pair once; ``more`` holds if any of its rows says so."""
    rows = rows[np.lexsort((~rows["more"], rows["v"], rows["u"]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows["u"][1:] != rows["u"][:-1]) | (rows["v"][1:] != rows["v"][:-1])
    return rows[first]


def _pair_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in PAIR.names], list(PAIR.names))


def crossing_pairs(groups: DataFrame, roots: DataFrame, reps: DataFrame, partners: int) -> DataFrame:
    """(u, v, more): for each member of large groups its ``partners`` nearest members of other components.

    Sizes and sketches must leave a link possible; nearest is the least difference of the sketches, then the smallest key.
    ``more`` says that a member has further ones. The members of a group are dealt into blocks by its size, and a row holds
    two blocks at most. Groups with the same smallest root share members: their blocks of one place go to one task, or to
    some by the number of their comparisons, and a task takes the nearest of all its groups.
    """
    large = groups.where(F.size("members") > SMALL_BUCKET).select(F.xxhash64("members").alias("bucket"), "members").dropDuplicates(["bucket"])
    # Powers of two: of two members that meet in groups of one number of blocks, the blocks are the same ones.
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.ceil(F.size("members") / BLOCK)))).cast("int")
    placed = large.select("bucket", blocks.alias("blocks"), F.explode("members").alias("node"))
    placed = placed.join(roots, "node", "left").select("bucket", "blocks", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.least(F.count("*"), F.lit(2 * BLOCK)).alias("size")).where("a <> b")
    spread = mixed.groupBy("a").agg(F.ceil(F.sum(F.col("size") * F.col("size")) / COMPARISONS_A_TASK).alias("slices"))
    mixed = mixed.join(spread, "a").select("bucket", "a", F.pmod(F.col("bucket"), F.col("slices")).alias("slice"))
    full = placed.join(mixed, "bucket").join(reps.select(F.col("key").alias("node"), "n", "sketch"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = full.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    place = ["a", "slice", "blocks", "x", "y"]
    lists = dealt.repartition(*place).groupBy(*place, "bucket").agg(F.collect_list(F.struct("node", "root", "n", "sketch")).alias("m"))
    lists = lists.select(*[F.col(f"m.{c}").alias(c) for c in ("node", "root", "n", "sketch")])

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            for members in zip(*(batch.column(k) for k in range(4)), strict=True):
                node, top, n = (members[k].values.to_numpy() for k in range(3))
                held.append(_nearest(node, top, n, members[3].values.to_pylist(), partners))
                if sum(map(len, held)) >= PAIRS_AT_ONCE:
                    held = [_nearest_of_all(held, partners)]
                    if 2 * len(held[0]) >= PAIRS_AT_ONCE:
                        yield _pair_batch(_told_once(_pairs(held.pop())))
        if held:
            yield _pair_batch(_told_once(_pairs(_nearest_of_all(held, partners))))

    return lists.mapInArrow(lean(run), "u long, v long, more boolean").groupBy("u", "v").agg(F.max("more").alias("more"))


def near_pairs(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (u, v) that sizes and sketches do not rule out."""

    def side(name, end):
        return reps.select(F.col("key").alias(name), F.col("n").alias(f"n{end}"), F.col("sketch").alias(f"s{end}"))

    def run(batches):
        for batch in batches:
            near = _near(batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_pylist(), batch.column(5).to_pylist())
            yield batch.filter(pa.array(near)).select(["u", "v"])

    both = pairs.join(side("v", "b"), "v").join(side("u", "a"), "u").select("u", "v", "na", "nb", "sa", "sb")
    return both.mapInArrow(lean(run), "u long, v long")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, text_col: str, id_col: str, words: int, label: str) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of 0.8 or more, from the whole texts."""
    pairs = stored(near_pairs(pairs, reps), f"{label}-near")
    nodes = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
    # One row stands for all copies of a set.
    chosen = stored(reps.select("key", "doc_id").join(nodes, "key", "left_semi"), f"{label}-nodes")
    few = chosen.count() <= BROADCAST_ROWS
    texts = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 62))))
    texts = texts.join(F.broadcast(chosen.select("doc_id").distinct()) if few else chosen.select("doc_id").distinct(), "doc_id", "left_semi")

    def shingles_of(batches):
        for _, body, offsets in text_chunks(batches, TEXT_BYTES):
            shingles, bounds = shingle_sets(body, offsets, words)
            key, _ = set_keys(shingles, bounds)
            packed = pa.Array.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer((bounds * 8).astype(np.int64).tobytes()), pa.py_buffer(shingles.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(key), packed.cast(pa.binary())], ["key", "shingles"])

    # Rows that share an id may hold other sets: the join on keys leaves them out, and copies count once.
    held = texts.mapInArrow(lean(shingles_of), "key long, shingles binary").dropDuplicates(["key"])
    one = pairs.join(held.select(F.col("key").alias("v"), F.col("shingles").alias("b")), "v")
    both = one.join(held.select(F.col("key").alias("u"), F.col("shingles").alias("a")), "u").select("u", "v", "a", "b")

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
                    continue
                joint = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(joint[1:] == joint[:-1]))
                keep[i] = 100 * common >= 80 * (len(x) + len(y) - common)
            yield batch.filter(pa.array(keep)).select(["u", "v"])

    return both.mapInArrow(lean(compare), "u long, v long")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links: only the components that they join are connected anew."""
    a, b = roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    between = links.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    moved = stored(connected(between, "merged"), "moved")
    known = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = moved.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return stored(known.unionByName(new), "roots")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest linked id, itself included."""
    return keyed_components(docs, id_col, text_col, words).drop("text_key")


def keyed_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``similar_documents`` with the hash of each row's text, text_key."""
    spark = docs.sparkSession
    sets = stored(set_table(docs, id_col, text_col, words), "sets")
    reps = sets.where("n_shingles > 0").groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("doc_id"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    reps = stored(reps, "set-reps")
    # The number of tasks follows from the counted shingles, that of parts from what a task should hold at a time.
    shingles = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // SHINGLES_A_TASK)
    parts = max(256, 4 * tasks, shingles // SHINGLES_A_PART)
    index = packed_index(docs, parts, text_col, words).repartition(tasks, "part").sortWithinPartitions("part")
    groups = stored(buckets(index), "buckets")
    pairs = stored(pairs_of(groups), "pairs")
    best = pairs.groupBy("v").agg(F.min_by("u", F.struct(-F.col("met"), "u")).alias("u")).select("u", "v")
    edges = stored(verified(best, docs, reps, text_col, id_col, words, "first"), "links")
    roots = stored(connected(edges, "first"), "roots")

    def apart(candidates: DataFrame) -> DataFrame:
        a, b = roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        return candidates.join(a, "u", "left").join(b, "v", "left").where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")

    tried = best
    partners, open_, stored_pairs = FIRST_PARTNERS, True, apart(pairs.select("u", "v"))
    while open_:
        near = stored(crossing_pairs(groups, roots, reps, partners), "crossing")
        candidates = near.select("u", "v")
        if stored_pairs is not None:
            # The first round also takes the pairs of small buckets.
            candidates, stored_pairs = candidates.unionByName(stored_pairs).distinct(), None
        rest = stored(candidates.join(tried, ["u", "v"], "left_anti"), "crossing-pairs")
        found = None
        if not rest.isEmpty():
            found = stored(verified(rest, docs, reps, text_col, id_col, words, "crossing"), "crossing-links")
            tried = tried.unionByName(rest)
        if found is not None and not found.isEmpty():
            roots = merged(roots, found)
        else:
            # Nothing linked: those with untried partners left try more of them, until none is left.
            open_ = not near.where("more").isEmpty()
            partners *= MORE_PARTNERS
    named = sets.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    full = named.where("n_shingles > 0")
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = full.join(least, "root").select("doc_id", "text_key", "n_shingles", "component_id")
    return linked.unionByName(sets.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, that stand for their group: the smallest id of each component.

    Rows are judged by id and text: of rows with one id and different texts, or without an id, those stay whose component
    has no smaller id. Rows that repeat an id and its text stay once; so do rows without an id that share a text.
    """
    found = stored(keyed_components(docs), "components")
    dropped = found.where("doc_id <> component_id or (doc_id is null and component_id is not null)").select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("own_id")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("own_key"))
    few = dropped.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(dropped) if few else dropped, same, "left_anti")
    twice = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"))
    if twice.isEmpty():
        return kept
    again = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, same, "left_anti").unionByName(again)
