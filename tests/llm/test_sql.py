"""Queries with SQL equal DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as E
from skein.llm import queries as Q
from tools.oracle_check import connect

SF = "/root/testdata/sf0.001"


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(None if v != v else v for v in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, con, name):
    want = con.execute(Q.ORACLE[name])
    names = [c[0] for c in want.description]
    expected = sorted((tuple(r[i] for i in sorted(range(len(names)), key=names.__getitem__)) for r in want.fetchall()), key=repr)
    got = E.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*sorted(names)).collect()), key=repr) == expected


def test_all_queries_are_registered():
    names = set(E.queries())
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(Q.ORACLE) <= names
