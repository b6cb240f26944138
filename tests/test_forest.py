"""Forests whose draws and votes stay in their tasks, against draws and votes that are joined."""

import pytest
from pyspark.sql import functions as F

from bracketry.catalogue import QUERIES
from bracketry.operators import forest, resample, splits, tree


@pytest.fixture(scope="module")
def rows(spark):
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(97)).cast("double")
    y = (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(97)) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(97)) > 97).cast("int")
    return spark.range(900).select(F.col("id").alias("row_id"), F.array(*[draw(k) for k in range(3)]).alias("x"), y.alias("y")).cache()


def lines(nodes):
    return sorted(str((r.tree_id, r.node_id, r.feature, r.threshold, r.is_leaf, r.prediction, round(r.proba, 12), r.n, r.gain)) for r in nodes.collect())


@pytest.mark.parametrize(("cells", "slice_bytes"), [(10**6, 64 << 20), (600, 64 << 20), (10**6, 2000)])
def test_nodes_are_those_of_joined_draws(spark, rows, monkeypatch, cells, slice_bytes):
    monkeypatch.setattr(resample, "CHUNK", 256)
    monkeypatch.setattr(resample, "SLICE_BYTES", slice_bytes)
    want = tree.grow(tree.bagged(rows, splits.bootstrap(rows, 900, 4)), 3, 4, 10, 5, rule="sqrt")
    got = forest.fit(rows.select("row_id", "x", F.array("y").alias("ys")), 900, 4, 3, 4, 10, 5, "sqrt", task_cells=cells)
    assert got.dtypes == want.dtypes and lines(got) == lines(want)


def test_votes_are_those_of_joined_trees(spark, rows, monkeypatch):
    monkeypatch.setattr(forest, "VOTERS", 200)
    drawn = splits.bootstrap(rows, 900, 5)
    nodes = forest.fit(rows.select("row_id", "x", F.array("y", 1 - F.col("y")).alias("ys")), 900, 5, 3, 4, 10, 5, "sqrt", labels=2)
    each = tree.predict(rows, nodes, 4)
    free = splits.out_of_bag(rows, drawn, 5).withColumnRenamed("b", "tree_id")
    for masks, of in ((None, each), (forest.unseen(spark, 900, 5), each.join(free, ["tree_id", "row_id"]))):
        got = {(r.row_id, r.part): (r.votes, r.n, r.proba) for r in forest.votes(rows, nodes, 3, 4, [(0, 2), (2, 5)], masks).collect()}
        assert len(got) == 1800
        part = (F.col("tree_id") >= 2).cast("int").alias("part")
        want = {(r.row_id, r.part): (r.votes, r.n, r.p) for r in of.groupBy("row_id", part).agg(F.sum("prediction").alias("votes"), F.count("*").alias("n"), F.sum("proba").alias("p")).collect()}
        assert {k for k, v in got.items() if v[1]} == set(want)
        assert all(got[k][:2] == v[:2] and got[k][2] == pytest.approx(v[2], abs=1e-9) for k, v in want.items())


def sent(*_, **__):
    raise AssertionError("draws or walks of all rows are sent")


@pytest.mark.parametrize("name", ["forest_fit", "forest_predict", "oob_score", "trees_sweep", "shuffled_label_control"])
def test_draws_and_walks_stay_in_their_tasks(spark, sf, monkeypatch, name):
    for module, of in ((splits, "drawn"), (splits, "out_of_bag"), (tree, "landed"), (tree, "bagged")):
        monkeypatch.setattr(module, of, sent)
    assert QUERIES[name](spark, sf).count() > 0
