"""Registered queries against their SQL at the smallest scale."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.compare import difference, duck

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables not present")


@pytest.fixture(scope="module")
def database():
    return duck(ROOT)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, database, name):
    got = queries()[name](spark, ROOT).toPandas()
    assert difference(got, database.execute(oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", ["gbt_scores", "ae_encode"])
def test_learned_queries_give_rows(spark, name):
    assert queries()[name](spark, ROOT).count() > 0


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())
