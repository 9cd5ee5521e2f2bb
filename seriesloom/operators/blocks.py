"""Number columns of a table as stored blocks, which numpy reads whole: a model passes over its rows many times.

A block is one row of a Spark table: a matrix with a line per column, as bytes. What a pass returns is added up in its tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of blocks that a task holds at once.
BATCH_BYTES = 16 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands its tasks blocks by their bytes, not by their number."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of doubles; a missing value is NaN."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def each(batches: Iterator[pa.RecordBatch], *kinds: type) -> Iterator[list[np.ndarray]]:
    """The matrices of every block, one per kind."""
    for batch in batches:
        for i, n in enumerate(batch.column(0).to_pylist()):
            if n:
                yield [np.frombuffer(batch.column(j + 1)[i].as_buffer(), kind).reshape(-1, n) for j, kind in enumerate(kinds)]


def block(n: int, *matrices: np.ndarray) -> pa.RecordBatch:
    """One block of ``n`` rows."""
    arrays = [pa.array([n], pa.int32()), *[pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()) for m in matrices]]
    return pa.RecordBatch.from_arrays(arrays, ["n", *[f"x{i}" for i in range(len(matrices))]])


def few_parts(df: DataFrame) -> DataFrame:
    """Tasks of one pass: a few a core, so that the sums which reach the driver don't grow with the rows."""
    return df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism)


def sums(df: DataFrame, add: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], size: int) -> np.ndarray:
    """What ``add`` puts into an array of ``size`` numbers, over all blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size)
        add(batches, own)
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["v"])

    total = np.zeros(size)
    with small_batches(df.sparkSession):
        for r in few_parts(df).mapInArrow(task, "v binary").collect():
            total += np.frombuffer(r.v)
    return total


@dataclass
class Blocks:
    """Stored blocks of doubles and the columns of their lines; the last one, ``_row``, holds the bits of a hash."""

    df: DataFrame
    columns: list[str]

    @classmethod
    def of(cls, rows: DataFrame, columns: Sequence[str], identity: Sequence[str | Column]) -> Blocks:
        """Columns of ``rows``; the hash is that of the identity."""
        columns = list(dict.fromkeys(columns))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.empty((len(columns) + 1, batch.num_rows))
                for i in range(len(columns)):
                    x[i] = numbers(batch, f"c{i}")
                x[-1] = batch.column(len(columns)).to_numpy().view(np.float64)
                yield block(batch.num_rows, x)

        known = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]
        made = rows.select(*known, F.xxhash64(*identity).alias("row")).mapInArrow(task, "n int, x0 binary")
        return cls(made.persist(StorageLevel.MEMORY_AND_DISK), [*columns, "_row"])

    def at(self, names: Sequence[str]) -> list[int]:
        return [self.columns.index(n) for n in names]

    def drop(self) -> None:
        self.df.unpersist()
