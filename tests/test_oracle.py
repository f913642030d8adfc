"""Every registered query against its SQL equivalent."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import difference, oracle
from tidemark.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    return oracle(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, db, name):
    assert difference(queries()[name](spark, FOLDER), db, oracle_sql()[name]) == ""
