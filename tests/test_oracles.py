"""Every registered query that SQL can state equals its SQL on the smallest tables."""

import pytest

from panelloom.registry import load
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
