"""Trees that grow by bins of values, against those that grow from rows sent for each tree."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from bracketry.catalogue import QUERIES
from bracketry.operators import histogram, splits, tree

# the second and the third begin alike; the last has no rows
TREES = [histogram.Tree(0, 9.0, 3, 6, 3), histogram.Tree(1, 5.0, 5, 4, 2), histogram.Tree(2, 5.0, 5, 4, 2), histogram.Tree(3, -1.0, 5, 4, 2)]
SEES = {0: [0, 1, 2, 3], 1: [0, 1, 2, 3], 2: [1, 2], 3: [0]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = [[float(rng.integers(30)), float(rng.random()), float(rng.choice([1.0, math.nan, 2.0, rng.random()])), float(k % 2)] for k in range(600)]
    return spark.createDataFrame([(v, int(rng.random() < 0.3 + 0.01 * v[0]), k % 7) for k, v in enumerate(x)], "x array<double>, y int, at int").repartition(3).cache()


def lines(found):
    return sorted(str((r["tree_id"], r["node_id"], r["feature"], r["threshold"], r["is_leaf"], r["prediction"], round(r["proba"], 12), r["n"], r["gain"])) for r in found)


# every value a bin, many bins, few, fewer still where nodes are many; levels alone, and levels and tasks
@pytest.mark.parametrize(("bins", "cells", "task_cells"), [(1 << 12, 1 << 16, 0), (64, 1 << 16, 600), (5, 1 << 16, 0), (40, 60, 0)])
def test_nodes_by_bins(spark, rows, monkeypatch, bins, cells, task_cells):
    for name, value in (("BINS", bins), ("CELLS", cells), ("CHUNK", 64)):
        monkeypatch.setattr(histogram, name, value)
    chunks = histogram.packed(rows, 4)
    got = histogram.grow(chunks, 4, TREES, task_cells, SEES)
    want = []
    for t in TREES[:3]:
        own = rows.where(F.col("at") < t.until).select(F.lit(t.tree_id).alias("tree_id"), "x", "y", F.lit(1).alias("m"))
        want += [r.asDict() for r in tree.grow(own, 4, *t[2:], allowed=F.col("feature").isin(SEES[t.tree_id])).collect()]
    assert len(want) > 30 and lines(got.to_pylist()) == lines(want)
    said = sorted((r.c0, r.y, *(round(p, 12) for p in (r.p0, r.p1))) for r in histogram.side_by_side(chunks, got, TREES[:2], 4.0, [1]).collect())
    test = rows.where("at >= 4").withColumn("row_id", F.monotonically_increasing_id()).localCheckpoint()
    each = tree.predict(test, spark.createDataFrame(want, tree.NODES), 5).groupBy("row_id").pivot("tree_id", [0, 1]).agg(F.max("proba"))
    assert said == sorted((r.x[1], r.y, *(round(r[k], 12) for k in "01")) for r in each.join(test, "row_id").collect())


def test_bounds_hold_what_is_inside_a_bin():
    rng = np.random.default_rng(5)
    for share in (0.1, 0.5):
        y = rng.random(400) < share + 0.3 * (np.arange(400) % 80 < 30)
        counts = np.stack([np.full(20, 20), y.reshape(20, 20).sum(1)], 1)[None]
        left = np.arange(1, 400.0)
        gain = histogram.gains(left, np.cumsum(y)[:-1], 400.0, y.sum())
        for least in (gain.max(), gain.max() / 2):
            open_, asked = histogram.promising(counts, np.array([least]), False)
            assert open_[0][(np.flatnonzero(gain >= least)) // 20].all() and (asked >= open_).all()


def test_variants_send_no_rows_for_each_tree(spark, sf, monkeypatch):
    def sent(*_, **__):
        raise AssertionError("the rows of all variants are sent")

    for name in ("grow", "landed", "cuts"):
        monkeypatch.setattr(tree, name, sent)
    assert QUERIES["ablation"](spark, sf).count() == 18


@pytest.mark.parametrize("days", [[], [3], [1, 1, 2], [5, 1, 1, 2, 9, 9, 9, 30, 31, 32], list(range(50))])
def test_boundary_of_counted_days(spark, days):
    rows = spark.createDataFrame([(d,) for d in days], "d int").select(F.date_from_unix_date("d").alias("dt"), "d")
    want = splits.boundary(rows).select(F.unix_date("boundary").alias("b")).first().b
    assert splits.boundary_of([(r.d, r["count"]) for r in rows.groupBy("d").count().orderBy("d").collect()]) == want


def test_slices_give_the_same_scores(spark, sf, monkeypatch):
    from bracketry.plans import queries_model as qm

    class Sliced(int):
        def __rshift__(self, _):
            return 2

    want = sorted(map(str, qm.ablation_scores(spark, sf).collect()))
    count = DataFrame.count
    monkeypatch.setattr(DataFrame, "count", lambda self: Sliced(count(self)))
    kept, stored = [], qm.stored
    monkeypatch.setattr(qm, "stored", lambda df: kept.append(df) or stored(df))
    got = sorted(map(str, qm.ablation_scores(spark, sf).collect()))
    # the bouts, the ratings and three slices of as-of rows
    assert len(kept) == 5 and len(want) > 10 and got == want
