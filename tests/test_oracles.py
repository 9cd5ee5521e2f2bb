"""Every query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracles import compare, connect
from tests.test_model_results import CHECKS

FOLDER = "/root/testdata/sf0.001"
Q, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(Q)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    problem = compare(con, Q[name](spark, FOLDER), SQL[name])
    # A report of exceptions may be empty on the smallest tables.
    assert problem in (None, "no rows"), problem


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL) - set(CHECKS)))
def test_query_without_sql_gives_rows(spark, name):
    assert Q[name](spark, FOLDER).count() > 0
