"""Spark rows against DuckDB rows, the way the driver compares them."""

import glob
import os

import duckdb


def views(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def same(spark, sf, query, sql):
    got = query(spark, sf)
    con = views(sf).execute(sql)
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row]
    want = sorted(con.fetchall(), key=key)
    rows = sorted((tuple(r[n] for n in names) for r in got.collect()), key=key)
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert a == b
