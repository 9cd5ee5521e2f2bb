"""Helpers that the operators share: tables, shared storage, flat text buffers, hashes of many strings at once."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import shared_folder

#: Bytes of text that a task works on at a time; arrays of 8 bytes a character stay small beside an executor's memory.
CHUNK_BYTES = 2 << 20
#: Bytes of one Arrow batch between an executor and its Python workers in steps that hold much else.
BATCH_BYTES = 4 << 20


def given_back() -> None:
    """Hand memory that nothing holds any more back to the machine: Python workers live on for the stages to come."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, whose memory is given back when the task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            given_back()

    return wrapped


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a result to the shared folder and read it back: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_in_small_batches(df: DataFrame, label: str) -> DataFrame:
    """``stored``, with Arrow batches of at most ``BATCH_BYTES`` and not of 10,000 rows, which both sides hold twice."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    own = conf.get(name, None)
    conf.set(name, str(BATCH_BYTES))
    try:
        return stored(df, label)
    finally:
        if own is None:
            conf.unset(name)
        else:
            conf.set(name, own)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names; a null text is empty."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, starting at offset 0; nulls are empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), rows)
        yield at, end
        at = end


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_id column, bytes, offsets) of bounded size from batches of ``id_and_text``."""
    for batch in batches:
        body, offsets = flat(batch.column(1))
        for a, b in pieces(offsets, limit):
            yield batch.column(0).slice(a, b - a), body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
    given_back()


_ODD = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        size = -(-n // 65536) * 65536
        _TABLES["up"], _TABLES["down"] = powers(_BASE, size), powers(_INVERSE, size)
    return _TABLES["up"], _TABLES["down"]


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of many spans of one buffer, from prefix sums of a polynomial; equal bytes have equal hashes."""
    up, down = _tables(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def words_of(body: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``blank``, and the first word of each text (with one more entry at the end)."""
    solid = np.concatenate([[False], ~blank, [False]])
    inner = solid[1:-1]
    begin, stop = inner & ~solid[:-2], inner & ~solid[2:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(body))]
    begin[cuts] |= inner[cuts]
    stop[cuts - 1] |= inner[cuts - 1]
    begins = np.flatnonzero(begin)
    return begins, np.flatnonzero(stop) + 1, np.searchsorted(begins, offsets)


def connected(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v) reaches, by alternating large and small stars.

    Every round is two joins on nodes with pre-aggregated minima; hot nodes are split by the skew handling of the join.
    Rounds grow with the logarithm of the longest chain. Each round is stored, so a lost executor costs one round at most.
    """
    small, large = F.least("u", "v"), F.greatest("u", "v")
    now = stored(edges.where("u <> v").select(large.alias("u"), small.alias("v")).distinct(), f"{label}-edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        spread = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = spread.groupBy("u").agg(F.min("v").alias("m"))
        near = spread.join(least, "u")
        now = stored(near.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{label}-stars")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s"), F.count_distinct("u").alias("d")).first()
        if (seen["n"], seen["s"]) == state and seen["n"] == seen["d"]:
            break
        state = (seen["n"], seen["s"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
