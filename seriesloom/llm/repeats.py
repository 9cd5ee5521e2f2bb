"""Removal of long strings that occur more than once, by bucket refinement over a sparse set of suffixes.

A suffix's bucket is its first q bytes. Buckets of twice the depth come from pairs of bucket identifiers, the own one and
that of the suffix q bytes later, over and over, and each level reuses the identifiers of the level before. Suffixes that
are alone in their bucket leave. Identifiers are hashes of the bucket's bytes, so buckets on different executors need no
common numbering, and counting their members is the sort that the refinement needs.

Keeping all suffixes would move some 16 bytes for each byte of text and level. So the refinement starts from anchors: in
every window of ``length`` bytes the half-length bucket with the smallest identifier. Equal windows have equal anchors at
equal offsets, hence windows whose anchor is alone are unique. Neighbouring windows of one anchor are first judged as one
string (all of them lie in it): if that occurs twice, all of them do. Only the other windows of shared anchors, at the
ends of shared passages, are refined one by one to the full length.

Equal texts are counted, and indexed once. Anchors of one bucket and surrounding are merged before they are sent, so a
passage of very many documents costs a task one row for each form of its surroundings. Hashes have 64 bits.

Null texts are empty; texts shorter than ``length`` lose nothing. Repeated rows are copies of each other and lose all
their bytes if long enough. Extra columns are kept by ``without_repeats`` and not read otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import _tables, flat, lean, mix, pieces
from seriesloom.llm.common import stored_in_small_batches as stored

LENGTH = 400
FIRST_DEPTH = 32
#: Bytes of text that a task indexes at a time; some fifteen arrays of 8 bytes a position are alive then.
TEXT_BYTES = 1 << 18
#: Windows of one anchor that go to one task: the places of a shared anchor are dealt out by their distance from it.
DEALT_TOGETHER = 8
#: Bytes of text whose anchors go to one task, and to one part of its work.
BYTES_A_TASK, BYTES_A_PART = 32 << 20, 2 << 20
#: Bytes up to which a small side is broadcast; beyond, the planner shuffles both sides.
BROADCAST_BYTES = 16 << 20
ANCHORS_AT_ONCE = 200_000
#: Rows whose texts are cut at a time.
ROWS_AT_ONCE = 1000
SEEN_AT_ONCE = 200_000
ANCHOR = np.dtype([("bucket", "<u8"), ("around", "<u8"), ("key", "<i8"), ("low", "<u4"), ("high", "<u4"), ("anchor", "<u4"), ("many", "u1")])
WINDOW = np.dtype([("bucket", "<u8"), ("key", "<i8"), ("at", "<u4")])
RUN = np.dtype([("key", "<i8"), ("low", "<u4"), ("high", "<u4")])
_LATER = np.uint64(0x9E3779B97F4A7C15)


def bucket_ids(body: np.ndarray, depth: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Identifiers of the buckets of half depth (rounded up), that half, and identifiers of full depth, by position.

    Positions too near the end hold identifiers of shorter strings; callers leave them out.
    """
    half = (depth + 1) // 2
    q = half
    while q % 2 == 0 and q > FIRST_DEPTH:
        q //= 2
    n = len(body)
    up, down = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    ids = np.zeros(n, np.uint64)
    if n >= q:
        ids[: n - q + 1] = mix((sums[q:] - sums[: n - q + 1]) * down[: n - q + 1])
    while q < half:
        ids = refined(ids, q)
        q *= 2
    return ids, half, refined(ids, depth - half)


def refined(ids: np.ndarray, later: int) -> np.ndarray:
    """Bucket identifiers from the own bucket and that of the suffix ``later`` bytes on."""
    out = ids * _LATER
    if later < len(ids):
        out[: len(ids) - later] += ids[later:]
    return mix(out)


def anchors(body: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(bucket, surroundings, text number, first and last window, place) of every anchor, as offsets in its text."""
    half_ids, half, full_ids = bucket_ids(body, length)
    n = len(body)
    span = length - half + 1
    low = (half_ids & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        low[: n - width] = np.minimum(low[: n - width], low[width:])
        width *= 2
    if width < span:
        low[: n - (span - width)] = np.minimum(low[: n - (span - width)], low[span - width :])
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    first = np.cumsum(windows) - windows
    at = np.arange(windows.sum()) - np.repeat(first, windows) + np.repeat(offsets[:-1], windows)
    anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(at) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(at)) - 1 if len(at) else head
    lo, hi = at[head], at[tail]
    around = mix(full_ids[lo] * _LATER + full_ids[hi] + (hi - lo).astype(np.uint64) * np.uint64(3))
    base = offsets[:-1][text[head]]
    return half_ids[anchor[head]], around, text[head], lo - base, hi - base, anchor[head] - base


def _merged(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row for each bucket and surroundings, flagged if it stands for several; the runs of all that are several)."""
    order = np.lexsort((rows["low"], rows["key"], rows["around"], rows["bucket"]))
    rows = rows[order]
    if not len(rows):
        return rows, np.zeros(0, RUN)
    same = (rows["bucket"][1:] == rows["bucket"][:-1]) & (rows["around"][1:] == rows["around"][:-1])
    # A text that another task indexed as well gives equal rows, which are one occurrence.
    again = same & (rows["key"][1:] == rows["key"][:-1]) & (rows["low"][1:] == rows["low"][:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    occurrences = np.bincount(group, weights=np.concatenate([[True], ~again])) + np.bincount(group, weights=rows["many"])
    many = occurrences[group] > 1
    runs = np.zeros(int(many.sum()), RUN)
    for name in RUN.names:
        runs[name] = rows[name][many]
    out = rows[np.concatenate([[True], ~same])].copy()
    out["many"] = occurrences > 1
    return out, np.unique(runs)


def _packed(part: np.ndarray, rows: np.ndarray, kind: str) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    part, rows = part[order].astype(np.int32), rows[order]
    head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = (np.append(head, len(part)) * rows.dtype.itemsize).astype(np.int32)
    body = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(head), pa.string()), pa.array(part[head] if len(part) else part), body], ["kind", "part", "rows"])


def _part_of(bucket: np.ndarray, parts: int) -> np.ndarray:
    return ((bucket >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)


_ROWS = "kind string, part int, rows binary"


def _by_part(batches, dtype: np.dtype):
    """The rows of one part after the other; rows come sorted by part, so a task holds one part."""
    part, held = None, []
    for batch in batches:
        for own, body in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            if own != part and held:
                yield np.concatenate(held)
                held = []
            part = own
            held.append(np.frombuffer(body.as_buffer(), dtype))
    if held:
        yield np.concatenate(held)


def _packed_bytes(rows: DataFrame, packed: str) -> int:
    """Bytes of a packed column and of the keys beside it."""
    return rows.agg(F.coalesce(F.sum(F.octet_length(packed) + 64), F.lit(0))).first()[0]


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("key"), F.xxhash64(text, F.lit(1)).alias("key2"), text.alias("text"))


def repeat_runs(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, key2, runs): for each text with repeated bytes its removed runs, packed as pairs of 32-bit start and end.

    ``key`` and ``key2`` are ``xxhash64(text)`` and ``xxhash64(text, 1)``.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, text_col).where(F.octet_length("text") >= length)
    # The number of tasks follows from the counted bytes, that of parts from what a task should hold at a time.
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BYTES_A_TASK)
    parts = max(256, 4 * tasks, size // BYTES_A_PART)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "part").sortWithinPartitions("part")

    def index(batches):
        held: list[np.ndarray] = []
        seen: set[int] = set()
        for batch in batches:
            body, offsets = flat(batch.column(1))
            keys = batch.column(0).to_numpy()
            for a, b in pieces(offsets, TEXT_BYTES):
                if len(seen) > SEEN_AT_ONCE:
                    seen = set()
                new = [i for i in range(a, b) if keys[i] not in seen and not seen.add(keys[i])]
                if not new:
                    continue
                sizes = offsets[np.array(new) + 1] - offsets[new]
                own = body[offsets[a] : offsets[b]] if len(new) == b - a else np.concatenate([body[offsets[i] : offsets[i + 1]] for i in new])
                bucket, around, text, low, high, place = anchors(own, np.concatenate([[0], np.cumsum(sizes)]), length)
                rows = np.zeros(len(bucket), ANCHOR)
                rows["bucket"], rows["around"], rows["key"], rows["low"], rows["high"], rows["anchor"] = bucket, around, keys[new][text], low, high, place
                held.append(rows)
                if sum(map(len, held)) >= ANCHORS_AT_ONCE:
                    yield from sent(held)
                    held = []
        if held:
            yield from sent(held)

    def sent(held):
        rows, runs = _merged(np.concatenate(held))
        yield _packed(_part_of(rows["bucket"], parts), rows, "anchors")
        if len(runs):
            yield _packed(_part_of(mix(runs["key"].view(np.uint64)), parts), runs, "runs")

    def judged(batches):
        for rows in _by_part(batches, ANCHOR):
            yield from judged_part(rows)

    def judged_part(rows):
        # Anchors alone in their bucket leave first.
        order = np.argsort(rows["bucket"])
        bucket = rows["bucket"][order]
        twin = np.zeros(len(rows), bool)
        twin[1:] = bucket[1:] == bucket[:-1]
        twin[:-1] |= twin[1:]
        twin |= rows["many"][order] > 0
        rows, runs = _merged(rows[order[twin]])
        if len(runs):
            yield _packed(_part_of(mix(runs["key"].view(np.uint64)), parts), runs, "runs")
        if len(rows):
            bucket = rows["bucket"]
            group = np.concatenate([[0], np.cumsum(bucket[1:] != bucket[:-1])])
            forms, single = np.bincount(group), np.bincount(group, weights=rows["many"] == 0)
            open_ = rows[(forms[group] > 1) & (single[group] > 0)]
            if len(open_):
                yield _packed(_part_of(mix(open_["key"].view(np.uint64)), parts), open_, "open")

    first = stored(keyed.select("key", "text").mapInArrow(lean(index), _ROWS), "anchors")
    second = stored(dealt(first.where("kind = 'anchors'")).mapInArrow(lean(judged), _ROWS), "judged")

    def by_key(batches):
        for rows in _by_part(batches, ANCHOR):
            rows = np.unique(rows)
            rows = rows[np.lexsort((rows["low"], rows["key"]))]
            head = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
            ends = (np.append(head, len(rows)) * ANCHOR.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(rows["key"][head]), packed], ["key", "rows"])

    open_texts = stored(dealt(second.where("kind = 'open'")).mapInArrow(lean(by_key), "key long, rows binary"), "open")
    few = _packed_bytes(open_texts, "rows") <= BROADCAST_BYTES
    texts = keyed.select("key", "text").join(F.broadcast(open_texts) if few else open_texts, "key")

    def leaves(batches):
        for batch in batches:
            body, offsets = flat(batch.column(1))
            for a, b in pieces(offsets, TEXT_BYTES):
                _, _, full = bucket_ids(body[offsets[a] : offsets[b]], length)
                out, whose = [], []
                for i in range(a, b):
                    rows = np.frombuffer(batch.column(2)[i].as_buffer(), ANCHOR)
                    n = rows["high"].astype(np.int64) - rows["low"] + 1
                    at = np.repeat(rows["low"] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    windows = np.zeros(len(at), WINDOW)
                    windows["bucket"], windows["key"], windows["at"] = full[at + offsets[i] - offsets[a]], rows["key"][0], at
                    out.append(windows)
                    ahead = (np.repeat(rows["anchor"].astype(np.int64), n) - at) // DEALT_TOGETHER
                    whose.append(_part_of(mix(np.repeat(rows["bucket"], n) + ahead.astype(np.uint64) * _LATER), parts))
                yield _packed(np.concatenate(whose), np.concatenate(out), "windows")

    def refined_windows(batches):
        for rows in _by_part(batches, WINDOW):
            yield from refined_part(rows)

    def refined_part(rows):
        order = np.argsort(rows["bucket"])
        bucket = rows["bucket"][order]
        twin = np.zeros(len(rows), bool)
        twin[1:] = bucket[1:] == bucket[:-1]
        twin[:-1] |= twin[1:]
        rows = np.unique(rows[order[twin]])
        if len(rows):
            same = rows["bucket"][1:] == rows["bucket"][:-1]
            group = np.concatenate([[0], np.cumsum(~same)])
            rows = rows[np.bincount(group)[group] > 1]
        if len(rows):
            rows = rows[np.lexsort((rows["at"], rows["key"]))]
            head = np.flatnonzero(np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["at"][1:] != rows["at"][:-1] + 1)]))
            runs = np.zeros(len(head), RUN)
            runs["key"], runs["low"], runs["high"] = rows["key"][head], rows["at"][head], rows["at"][np.append(head[1:], len(rows)) - 1]
            yield _packed(_part_of(mix(runs["key"].view(np.uint64)), parts), runs, "runs")

    third = stored(dealt(texts.select(F.lit("").alias("kind"), "text", "rows").mapInArrow(lean(leaves), _ROWS)).mapInArrow(lean(refined_windows), _ROWS), "windows")

    def covered(batches):
        for rows in _by_part(batches, RUN):
            yield covered_part(rows)

    def covered_part(rows):
        keys, out = [], []
        rows = rows[np.lexsort((rows["low"], rows["key"]))]
        head = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
        for a, b in zip(head.tolist(), np.append(head[1:], len(rows)).tolist(), strict=True):
            start, end = rows["low"][a:b].astype(np.int64), np.maximum.accumulate(rows["high"][a:b].astype(np.int64) + length)
            cut = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
            keys.append(int(rows["key"][a]))
            out.append(np.stack([start[cut], end[np.append(cut[1:], len(start)) - 1]], axis=1).astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["key", "runs"])

    runs = first.where("kind = 'runs'").unionByName(second.where("kind = 'runs'")).unionByName(third)
    per_text = dealt(runs).mapInArrow(lean(covered), "key long, runs binary")
    # Copies of a text repeat all of its strings; the runs of other texts come from the refinement.
    size = keyed.select("key", "key2", F.octet_length("text").alias("size")).groupBy("key", "key2").agg(F.count("*").alias("copies"), F.max("size").alias("size"))
    whole = F.concat(F.unhex(F.lit("00000000")), _little(F.col("size")))
    joined = size.join(per_text, "key", "left").select("key", "key2", F.when(F.col("copies") > 1, whole).otherwise(F.col("runs")).alias("runs"))
    return stored(joined.where("runs is not null"), "removed")


def _little(n):
    """32-bit little-endian bytes of a number."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)]))


def _with_runs(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    runs = repeat_runs(docs, text_col, length).select(F.col("key").alias("_key"), F.col("key2").alias("_key2"), F.col("runs").alias("_runs"))
    few = _packed_bytes(runs, "_runs") <= BROADCAST_BYTES
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.join(F.broadcast(runs) if few else runs, (F.xxhash64(text) == F.col("_key")) & (F.xxhash64(text, F.lit(1)) == F.col("_key2")), "left").drop("_key", "_key2")


def kept_bytes(text: bytes, runs: bytes | None) -> tuple[bytes, np.ndarray]:
    """The bytes outside the runs, and the runs as rows of start and end."""
    spans = np.frombuffer(runs or b"", np.uint32).reshape(-1, 2).astype(np.int64)
    parts, at = [], 0
    for a, b in spans.tolist():
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]]), spans


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                body = (text.as_py() or "").encode()
                kept, spans = kept_bytes(body, runs.as_py())
                out.append((len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans.ravel().tolist()))
            n, removed, spans, digest, flat_spans = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(flat_spans, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return _with_runs(slim, "text", length).select("doc_id", "text", F.col("_runs").alias("runs")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with repeated strings cut out of ``text``, and ``n_chars`` (if there) counted anew.

    Bytes of a character that a cut splits go as well. A null text stays null.
    """
    names, schema = docs.columns, docs.schema
    at, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for whole in batches:
            # A slice at a time: its texts, the cut ones and the result are alive together.
            for a in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(a, ROWS_AT_ONCE)
                texts = []
                for text, runs in zip(batch.column(at), batch.column(len(names)), strict=True):
                    one = text.as_py()
                    texts.append(one if one is None or not runs.is_valid else kept_bytes(one.encode(), runs.as_py())[0].decode("utf-8", "ignore"))
                columns = [batch.column(i) for i in range(len(names))]
                columns[at] = pa.array(texts, columns[at].type)
                if counted is not None:
                    columns[counted] = pa.array([None if t is None else len(t) for t in texts], columns[counted].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return _with_runs(docs, "text", length).select(*[F.col(f"`{c}`") for c in names], "_runs").mapInArrow(lean(run), T.StructType(schema.fields))
