"""Every registered query against its SQL at the smallest scale."""

import pytest
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, FOLDER).count() > 0
    else:
        assert differences(spark, duck, FOLDER, name, queries()[name], sql) is None


def test_entry(spark):
    assert entry(spark).count() == 3
