"""Every query with SQL against DuckDB at the smallest scale."""

import glob
import os

import duckdb
import pytest

from bracketry.catalogue import ORACLES, QUERIES

FAST = sorted(n for n in ORACLES if not n.startswith(("elo_", "tree_")) or n in ("elo_step", "elo_ratings", "tree_depth2"))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, sf, con, name):
    found = QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    names = sorted(d[0] for d in want.description)
    assert names == sorted(found.columns)
    order = {d[0]: i for i, d in enumerate(want.description)}
    plain = lambda v: 0.0 if isinstance(v, float) and v == 0 else v
    rows = sorted((tuple(plain(r[n]) for n in names) for r in found.collect()), key=str)
    expected = sorted((tuple(plain(r[order[n]]) for n in names) for r in want.fetchall()), key=str)
    assert rows == expected
