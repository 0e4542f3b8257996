"""Originals are searched for in all documents."""

import oracle
import pytest
from maskwright.plans import oracle as sql, queries as registered

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["leak_originals", "verify_status", "verify_report"])
def test_originals_of_all_documents(spark, name):
    oracle.assert_same(registered.queries()[name](spark, FOLDER), sql.oracle_sql()[name], oracle.connect(FOLDER))


def test_leaks_of_both_halves(spark):
    ends = {r[0] for r in registered.queries()["leak_originals"](spark, FOLDER).selectExpr("doc_id % 10 < 5").distinct().collect()}
    assert ends == {True, False}
