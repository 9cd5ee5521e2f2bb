"""Chat formatting by columnar byte assembly.

Every turn becomes one segment ``<s>[INST] role<<TEXT>>`` text ``[/INST]</s>`` (assistant turns are the ones to learn from).
A batch of turns is assembled at once: lengths of headers, escaped contents and footers give cumulative offsets, contents
are scattered to their places in one preallocated buffer, and the buffer becomes an Arrow column without further copies.
Control strings cannot occur in contents: a backslash follows every ``<``, ``[`` and backslash of a text or role, and is
taken out again when the output is read back.

A conversation is the concatenation of its segments by turn; ties are ordered by role, then text; a null turn comes first.
Segments are rows of their own, so a conversation of any length takes no more memory than a batch. Null roles and texts
are empty; rows without a conversation id form one conversation. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import flat, pieces

OPEN, AFTER_ROLE, CLOSE = b"<s>[INST] ", b"<<TEXT>>", b"[/INST]</s>"
ESCAPED = np.frombuffer(b"<[\\", np.uint8)
LEARNED = "assistant"
SEGMENTS = "conv_id long, turn long, role string, segment string, loss_start long, loss_end long"
_MARKED = re.compile(rb"([<\[\\])\\", re.S)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(segments, start and end of the escaped text in each segment, in bytes)."""
    role, role_at = flat(roles)
    text, text_at = flat(texts)
    rows = len(role_at) - 1

    def grown(body, offsets):
        """Place of every byte after escaping, counted from the start of its row, and the new lengths."""
        special = np.isin(body, ESCAPED)
        before = np.concatenate([[0], np.cumsum(special)])
        return special, np.arange(len(body)) + before[:-1], np.diff(offsets) + np.diff(before[offsets]), offsets[:-1] + before[offsets[:-1]]

    role_special, role_place, role_size, role_base = grown(role, role_at)
    text_special, text_place, text_size, text_base = grown(text, text_at)
    size = len(OPEN) + role_size + len(AFTER_ROLE) + text_size + len(CLOSE)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint8)
    header = ends[:-1] + len(OPEN)
    start = header + role_size + len(AFTER_ROLE)
    for k, value in enumerate(OPEN):
        out[ends[:-1] + k] = value
    for k, value in enumerate(AFTER_ROLE):
        out[header + role_size + k] = value
    for k, value in enumerate(CLOSE):
        out[start + text_size + k] = value
    for body, special, place, offsets, base, to in ((role, role_special, role_place, role_at, role_base, header), (text, text_special, text_place, text_at, text_base, start)):
        at = place + np.repeat(to - base, np.diff(offsets))
        out[at] = body
        out[at[special] + 1] = ord("\\")
    column = pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(out)])
    return column, start - ends[:-1], start - ends[:-1] + text_size


def unescaped(part: bytes) -> bytes:
    return _MARKED.sub(rb"\1", part)


def read_back(segment: bytes) -> tuple[bytes, bytes]:
    """(role, text) of one segment."""
    head, _, rest = segment[len(OPEN) :].partition(AFTER_ROLE)
    return unescaped(head), unescaped(rest[: -len(CLOSE)])


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One segment per turn with the byte range of its text to learn from (empty for other roles)."""
    slim = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches):
        for batch in batches:
            _, offsets = flat(batch.column(3))
            for a, b in pieces(offsets):
                part = batch.slice(a, b - a)
                segments, start, end = assemble(part.column(2), part.column(3))
                learned = np.array(part.column(2).to_pylist(), object) == LEARNED
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), segments, pa.array(np.where(learned, start, 0)), pa.array(np.where(learned, end, 0))],
                    ["conv_id", "turn", "role", "segment", "loss_start", "loss_end"],
                )

    return slim.mapInArrow(run, SEGMENTS)


def in_order(segments: DataFrame) -> DataFrame:
    """Segments of a conversation side by side and in order, whole conversations in one partition, streamed in batches."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")


def conversation_digests(segments: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from their segments.

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The digests are running ones, so
    that no conversation is held in memory.
    """

    def points(part: bytes) -> int:
        return len(part.decode("utf-8"))

    def row(state):
        conv, n, turns, chars, loss, formatted = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        state, done = None, []
        for batch in batches:
            for conv, segment, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                body = segment.as_py().encode()
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(body)
                learned = unescaped(body[a:b])
                state[1] += 1
                state[2].update(role + b"\n" + text + b"\n")
                state[3] += points(learned)
                state[4].update(learned)
                state[5] += points(body)
            if done:
                yield batch_of(done)
                done = []
        if state is not None:
            yield batch_of([row(state)])

    ordered = in_order(segments).select("conv_id", "segment", "loss_start", "loss_end")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
