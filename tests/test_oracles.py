"""Every registered query against its SQL, at a small scale."""

import pytest
from conftest import SF_DIR
from oracle_check import compare, connect

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_returns_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).collect()


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 9
