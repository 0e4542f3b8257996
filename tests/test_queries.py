"""Every registered query against its SQL, over the smallest tables."""

import os

import oracle
import pytest
from maskwright.plans import oracle as sql, queries as registered

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registered.queries(), sql.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    oracle.assert_same(QUERIES[name](spark, FOLDER), SQL[name], con)


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(SQL) == {"canonical_similar", "mask_documents", "stream_registry"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["regulation", "n_fields"]
    assert set(registered.queries()) <= set(__spark_entry__.queries())
