"""The pipeline and the queries of the subpackage on the smallest tables."""

import pytest

import corpus_pipeline
from seriesloom.llm.queries import ORACLES, QUERIES
from tests.check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_every_decision_holds(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert coded.count() == before
    assert sorted(tuple(r) for r in coded.select("doc_id", "n_tokens").collect()) == sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens").collect())


def test_stages_take_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, key long, score double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(connect(FOLDER), QUERIES[name](spark, FOLDER), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
