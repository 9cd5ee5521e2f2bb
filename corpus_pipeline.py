"""From raw documents to token ids in five stages, each on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import bpe, decontaminate, jaccard, quality, repeats
from seriesloom.llm.common import stored, stored_in_small_batches, table


def keep_good_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field accepts."""
    field = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.accepted_documents(docs, field)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return jaccard.one_of_each_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without strings of 400 bytes that occur more than once."""
    return repeats.without_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, also re-parameterised ones."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every document, stored: executors still hold memory of the stages before."""
    return stored_in_small_batches(bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")), "byte_bpe")


STAGES = [
    ("quality_classifier", keep_good_lines),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark),
    ("byte_bpe", to_tokens),
]
#: The first stage is a trained model and the last one a tokenizer: no SQL states the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
