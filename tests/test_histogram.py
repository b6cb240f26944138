"""Trees over packed rows, against those that grow from rows sent for each tree."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bracketry.catalogue import QUERIES
from bracketry.operators import histogram, tree

TREES = [histogram.Tree(0, 3.0, 3, 6, 3), histogram.Tree(1, 5.0, 3, 6, 3), histogram.Tree(2, 9.0, 5, 4, 2), histogram.Tree(3, -1.0, 5, 4, 2)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = [[float(rng.integers(30)), float(rng.random()), float(rng.choice([1.0, math.nan, 2.0])), float(k % 2)] for k in range(600)]
    return spark.createDataFrame([(v, int(rng.random() < 0.3 + 0.01 * v[0]), k % 7) for k, v in enumerate(x)], "x array<double>, y int, at int").repartition(3).cache()


def lines(found):
    return sorted(str((r["tree_id"], r["node_id"], r["feature"], r["threshold"], r["is_leaf"], r["prediction"], round(r["proba"], 12), r["n"], r["gain"])) for r in found)


# levels alone, levels and tasks, tasks alone, rows sent; groups of one node; numbers of few values only
@pytest.mark.parametrize(("cells", "most", "group", "numbered"), [(0, 10**6, 1 << 20, 1 << 16), (600, 10**6, 40, 10), (10**6, 10**6, 1 << 20, 1 << 16), (600, 0, 1 << 20, 1 << 16)])
def test_nodes_are_those_of_rows_sent(spark, rows, monkeypatch, cells, most, group, numbered):
    for name, value in (("MOST", most), ("GROUP", group), ("NUMBERED", numbered), ("CHUNK", 64)):
        monkeypatch.setattr(histogram, name, value)
    chunks = histogram.packed(rows, 4)
    got = histogram.grow(chunks, 4, TREES, cells)
    want = []
    for t in TREES[:3]:
        own = rows.where(F.col("at") < t.until).select(F.lit(t.tree_id).alias("tree_id"), "x", "y", F.lit(1).alias("m"))
        want += [r.asDict() for r in tree.grow(own, 4, *t[2:]).collect()]
    assert len(want) > 30 and lines(got.to_pylist()) == lines(want)
    asked = [(t, 2.0, 6.0) for t in TREES[:3]]
    said = sorted((r.tree_id, r["at"], r.y, round(r.p, 12)) for r in histogram.answers(chunks, got, asked).collect())
    test = rows.where("at >= 2 AND at < 6").withColumn("row_id", F.monotonically_increasing_id()).localCheckpoint()
    nodes = spark.createDataFrame(want, tree.NODES)
    each = tree.predict(test, nodes, 5).join(test.select("row_id", "at", "y"), "row_id")
    assert said == sorted((r.tree_id, r["at"], r.y, round(r.proba, 12)) for r in each.collect())


def test_folds_send_no_rows_for_each_tree(spark, sf, monkeypatch):
    def sent(*_, **__):
        raise AssertionError("the rows of all folds are sent")

    for name in ("grow", "landed", "cuts"):
        monkeypatch.setattr(tree, name, sent)
    assert QUERIES["run_walk_forward"](spark, sf).count() == 16


def test_no_rows(spark):
    chunks = histogram.packed(spark.createDataFrame([], "x array<double>, y int, at int"), 2)
    assert histogram.grow(chunks, 2, TREES).num_rows == 0
