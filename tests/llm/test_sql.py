"""Operators that SQL can express against their SQL."""

import pytest

from compare import difference, oracle
from tidemark.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, db, name):
    assert difference(QUERIES[name](spark, FOLDER), db, ORACLE[name]) == ""
