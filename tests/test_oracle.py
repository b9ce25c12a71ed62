"""Every registered query equals its DuckDB oracle on the smallest tables."""

import pytest

from conftest import SF_SMALL
from skein.plans import registry
from tools.oracle_check import compare, connect

QUERIES = registry.queries()
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, SF_SMALL, name, QUERIES[name], ORACLE.get(name))
    assert ok, msg
