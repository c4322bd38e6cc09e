import os

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@needs_tables
def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["seed_id", "item_id", "similarity", "rank"] and df.count() > 0


@needs_tables
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert differences(queries()[name](spark, FOLDER), con, oracle_sql()[name]) == []
