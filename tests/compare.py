"""Rows of a Spark query held against DuckDB's on the same files."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def _plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def same_rows(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, cur = query(spark, sf), con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=str)
    assert sorted((tuple(_plain(r[c]) for c in order) for r in got.collect()), key=str) == want
