"""Every query with SQL gives the SQL's rows; the others run and have a stable schema."""

import pytest

import __spark_entry__ as entry
from claimgraph.plans import corpus_queries, graph_queries, run_queries
from conftest import DATA

QUERIES = graph_queries.QUERIES | corpus_queries.QUERIES | run_queries.QUERIES
ORACLE = graph_queries.ORACLE | corpus_queries.ORACLE | run_queries.ORACLE


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in ORACLE:
        q = duck.sql(ORACLE[name])
        names = q.columns
        assert sorted(names) == cols
        assert sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()) == rows


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
