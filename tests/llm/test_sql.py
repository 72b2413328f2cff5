"""Queries of corpus operators against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from millrace.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(want.columns)
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    rows = lambda columns, values: sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in values), key=str)
    assert rows(found.columns, found.collect()) == rows(want.columns, want.fetchall())
