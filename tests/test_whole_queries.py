"""Queries over whole tables against their SQL, with a row for each order or customer."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["clean_value", "format_bytes", "line_texts", "line_cells", "page_metrics", "page_verdicts"])
def test_all_rows(spark, name):
    got = entry.queries()[name](spark, DATA)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{DATA}/orders.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(rows) == sorted(want.fetchall())
    key = 0 if rows and len(want.columns) == 2 else None
    every = con.sql("SELECT count(*), count(DISTINCT o_custkey) FROM orders").fetchall()[0]
    assert len(rows) == every[0] if key == 0 else len({r[0] for r in rows}) == every[1]
