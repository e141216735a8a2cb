"""Every catalogue query equals its DuckDB oracle on the smallest driver tables."""

import pytest

from quire.plans.compare import compare, duck_connect, type_differences
from quire.plans.registry import oracle_sql, queries

from conftest import SMALL_SF

QUERIES = queries()
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SMALL_SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    r = compare(name, QUERIES[name](spark, SMALL_SF), con, ORACLES[name])
    assert r.ok, r.detail


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_types_match_oracle(spark, con, name):
    assert type_differences(QUERIES[name](spark, SMALL_SF), con, ORACLES[name]) == {}
