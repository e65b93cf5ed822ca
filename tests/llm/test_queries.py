"""Queries with SQL give the rows of their SQL on the small tables."""

import os

import pytest

from helixquery.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DIR}/{t}'")
    df = queries.queries()[name](spark, DIR)
    got = sorted(repr([r[x] for x in sorted(df.columns)]) for r in df.collect())
    cur = c.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in cur.description]
    at = [columns.index(x) for x in sorted(columns)]
    assert sorted(df.columns) == sorted(columns)
    assert got == sorted(repr([r[i] for i in at]) for r in cur.fetchall())
