"""Session settings and the reliable checkpoint location."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of one part of :func:`dealt`.
ROWS_PER_PART = 125_000
#: Narrow rows of one part of :func:`counted_parts`, the bytes of an exchange up to which small parts are merged again, and
#: the bytes of a file that one task reads: sums made before an exchange hold a group for each row at worst.
NARROW_ROWS, MERGED_BYTES, READ_BYTES = 1_000_000, 16 << 20, 32 << 20


def build_session(app: str = "seriesloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; caller settings win.

    Partition counts are left to adaptive execution on a cluster: it starts from
    ``spark.sql.shuffle.partitions`` and merges small partitions, and splits
    skewed join partitions.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    In a local session without that setting it lies beside the tables of the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder named by ``spark.checkpoint.dir``.

    Where that setting is unset in a local session (tests), a folder beside the
    tables of the warehouse is used; on a cluster the missing setting is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """The rows dealt by their keys into parts of about ``ROWS_PER_PART`` rows.

    Adaptive execution sizes partitions by the bytes of an exchange. Where narrow rows grow behind it (features, inserted
    periods, vectors of a model), a partition then holds too much for one task. ``rows`` is the number to come; without it
    the rows of ``df`` are counted, so give a stored table.
    """
    total = df.count() if rows is None else rows
    return df.repartition(max(math.ceil(total / ROWS_PER_PART), df.sparkSession.sparkContext.defaultParallelism), *keys)


@contextmanager
def counted_parts(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside has parts of about ``NARROW_ROWS`` rows behind each exchange, if ``rows`` narrow rows come.

    An aggregate deals its groups to a fixed number of parts, so a task's table of groups grows with the input. Dealing the
    rows before it would give up the partial sums of each task. The session's settings are put back at the end, so store the
    results inside.
    """
    conf, parts = spark.conf, "spark.sql.shuffle.partitions"
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": MERGED_BYTES, "spark.sql.files.maxPartitionBytes": READ_BYTES}
    own = {name: conf.get(name, None) for name in (parts, *sizes)}
    conf.set(parts, str(max(math.ceil(rows / NARROW_ROWS), int(own[parts] or 200))))
    for name, size in sizes.items():
        # Sizes that the caller has set win.
        if own[name] is None:
            conf.set(name, str(size))
    try:
        yield
    finally:
        for name, value in own.items():
            if value is None:
                conf.unset(name)
            else:
                conf.set(name, value)
