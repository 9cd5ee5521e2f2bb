"""Token counts of documents in flat files of token ids, found by scanning for the end-of-document id.

A flat file holds ids of one width and nothing else: every document's ids and then ``separator``. Files are cut into blocks
that any executor reads on its own. A block yields its number of ids, its separators and the distances between them; a
prefix scan over the blocks of a file (running sum of ids, running maximum of separator positions) gives each block its
first document number and the ids that earlier blocks carry into it. A document may span any number of blocks.

Ids after the last separator are a last document without end; an empty file has none. ``write_flat`` gives empty and null
texts no ids but a separator, repeated rows and null ids a document each; extra columns are not read.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import id_and_text, shared_folder, stored

BLOCK_BYTES = 4 << 20
WIDTH = np.dtype("<u2")


def store_at(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a shared folder or file."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pa.fs.FileSystem.from_uri(uri)


def write_flat(docs: DataFrame, folder: str, ranks_path: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one flat file per partition; returns (file, number, doc_id), the order in which documents were written.

    A file gets its name when it is complete, so a task that runs again only replaces it by the same bytes.
    """

    def run(batches):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        name = f"tokens-{TaskContext.get().partitionId():06d}.bin"
        fs, path = store_at(folder)
        fs.create_dir(path, recursive=True)
        part, number = f"{path}/.{name}.{uuid.uuid4().hex}", 0
        with fs.open_output_stream(part) as out:
            for batch in batches:
                for text in batch.column(1):
                    ids = coder.encode_ordinary(text.as_py())
                    ids.append(separator)
                    out.write(np.array(ids, WIDTH).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.string()), pa.array(np.arange(number, number + batch.num_rows)), batch.column(0)], ["file", "number", "doc_id"])
                number += batch.num_rows
        if number:
            fs.move(part, f"{path}/{name}")
        else:
            fs.delete_file(part)

    return stored(id_and_text(docs, id_col, text_col).mapInArrow(run, "file string, number long, doc_id long"), "manifest")


def count_documents(spark: SparkSession, folder: str, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, number, n_tokens, ended) of every document in the flat files of a folder."""
    size = block_bytes // WIDTH.itemsize * WIDTH.itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length").where("length > 0")
    last = F.ceil(F.col("length") / size).cast("long") - 1
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), (last + 1).alias("n_blocks"))

    def scan(batches):
        for batch in batches:
            rows = []
            for path, length, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, name = store_at(path)
                with fs.open_input_file(name) as f:
                    f.seek(block * size)
                    ids = np.frombuffer(f.read(min(size, length - block * size)), WIDTH)
                ends = np.flatnonzero(ids == separator)
                gaps = np.diff(ends, prepend=-1) - 1
                rows.append((path, block, len(ids), len(ends), int(ends[-1]) if len(ends) else None, gaps.tolist()))
            names = ["path", "block", "n_ids", "n_ends", "last_end", "gaps"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = stored(blocks.repartition(tasks, "path", "block").select("path", "length", "block").mapInArrow(scan, "path string, block long, n_ids long, n_ends long, last_end long, gaps array<long>"), "blocks")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    placed = scanned.withColumn("at", at).withColumn("first_number", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    placed = placed.withColumn("carried", F.col("at") - F.coalesce(F.max(F.col("at") + F.col("last_end")).over(before) + 1, F.lit(0)))
    file = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    ended = placed.select(file, "first_number", "carried", F.posexplode("gaps").alias("k", "gap")).select(
        "file", (F.col("first_number") + F.col("k")).alias("number"), F.when(F.col("k") == 0, F.col("gap") + F.col("carried")).otherwise(F.col("gap")).alias("n_tokens"), F.lit(True).alias("ended")
    )
    tail = placed.groupBy("path").agg(F.sum("n_ids").alias("all"), F.sum("n_ends").alias("number"), F.max(F.col("at") + F.col("last_end")).alias("last"))
    rest = F.col("all") - F.coalesce(F.col("last") + 1, F.lit(0))
    return ended.unionByName(tail.where(rest > 0).select(file, "number", rest.alias("n_tokens"), F.lit(False).alias("ended")))


def document_tokens(docs: DataFrame, ranks_path: str, pattern: str, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, file, number): documents written as flat files in the shared folder, then counted by the scan."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/flat-{uuid.uuid4().hex}"
    written = write_flat(docs, folder, ranks_path, pattern, separator)
    return count_documents(spark, folder, separator, block_bytes).join(written, ["file", "number"]).select("doc_id", "n_tokens", "file", "number")
