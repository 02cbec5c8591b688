"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quillon.plans import annotated_queries, lexical_queries, paper_queries, queries, voice_queries  # noqa: F401

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(queries.SQL)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(float(v), 9) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    rows = queries.QUERIES[name](spark, SMALL)
    names = sorted(rows.columns)
    assert plain(tuple(r[n] for n in names) for r in rows.collect()) == plain(con.execute(f"select {', '.join(names)} from ({queries.SQL[name]}) q").fetchall())
