"""Bagged forests whose draws and votes stay in the tasks that use them.

A task works out the draws of its trees from the packed rows (resample) and, where the
distinct rows are few enough for one task, grows the trees then and there; otherwise it
sends each tree's distinct rows with the times they were drawn, and the trees grow as in
tree.grow. The node tables are the same either way. For votes every task walks the trees,
whose tables are packed and bounded by trees * 2^depth, for a chunk of rows; only sums of
votes leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bracketry.operators import resample, tree
from bracketry.session import checkpointed, ship

#: Rows of a chunk that one task has all trees vote on.
VOTERS = 1 << 15


def flat(rows: DataFrame, columns: int, labels: int = 0) -> tuple[DataFrame, list[str]]:
    """Rows (row_id, x, ys) with a column for each feature and label."""
    xs = [F.get("x", k).cast("double").alias(f"x{k}") for k in range(columns)]
    ys = [F.get("ys", k).cast("double").alias(f"y{k}") for k in range(labels)]
    return rows.select("row_id", *xs, *ys), [*[f"x{k}" for k in range(columns)], *[f"y{k}" for k in range(labels)]]


def fit(rows: DataFrame, n: int, trees: int, columns: int, max_depth: int, min_split: int, min_leaf: int, rule: str | int | None = None, labels: int = 1, seed: int = 7, task_cells: int | None = None) -> DataFrame:
    """The node table of every tree over rows (row_id, x, ys), row_id 0 .. n - 1; tree b takes n draws, those of splits.bootstrap, and learns label b * labels // trees of ys."""
    ship(rows.sparkSession)
    task_cells = tree.TASK_CELLS if task_cells is None else task_cells
    chunks = resample.packed(*flat(rows, columns, labels))
    cells = (chunks.agg(F.sum("distinct")).first()[0] or 0) * columns
    spread, groups, slices = resample.dealt(chunks, trees)
    k = tree.subset_size(rule, columns)

    def bagged(key, part):
        tuples, codes, first = resample.unpacked(part, columns + labels)
        for b in range(key[0].as_py(), trees, groups):
            m = resample.counted(codes, len(tuples), first, b, n, seed)
            at = np.flatnonzero(m)
            yield b, tuples[at, :columns], tuples[at, columns + b * labels // trees], m[at]

    if slices == 1 and cells <= task_cells:

        def grow(key, part):
            nodes = [node for b, x, y, m in bagged(key, part) for node in tree.grown(b, 0, x, y, m.astype(float), max_depth, min_split, min_leaf, lambda t, i: tree.drawn_features(t, i, k, columns))]
            return pa.Table.from_pylist(nodes, tree.node_schema(pa.int32()))

        return checkpointed(spread.groupBy("group", "slice").applyInArrow(grow, tree.NODES).withColumn("gain", F.round("gain", tree.DIGITS)))

    def send(key, part):
        own = list(bagged(key, part))
        kinds = [("tree_id", pa.int32()), ("x", pa.list_(pa.float64())), ("y", pa.int32()), ("m", pa.int64())]
        tables = [
            pa.table([pa.array(np.full(len(m), b), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * columns, pa.int32()), pa.array(x.ravel())), pa.array(y.astype(np.int32)), pa.array(m)], pa.schema(kinds))
            for b, x, y, m in own
        ]
        return pa.concat_tables([pa.schema(kinds).empty_table(), *tables])

    sent = spread.groupBy("group", "slice").applyInArrow(send, "tree_id int, x array<double>, y int, m long")
    return tree.grow(sent, columns, max_depth, min_split, min_leaf, rule, task_cells=task_cells)


def unseen(spark, n: int, trees: int, seed: int = 7) -> DataFrame:
    """(chunk, tree_id, data): a bit for each of the VOTERS rows of a chunk, set if the tree never drew it."""
    width = VOTERS
    groups = max(1, min(trees, max(resample.GROUPS, 4 * spark.sparkContext.defaultParallelism)))

    def mark(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                free = np.ones(n, bool)
                for start in range(0, n, resample.BLOCK):
                    free[resample.draws(b, start, min(n, start + resample.BLOCK), n, seed)] = False
                data = [np.packbits(free[a : a + width]).tobytes() for a in range(0, n, width)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int64()), pa.array([b] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["chunk", "tree_id", "data"])

    return spark.range(0, trees, 1, groups).mapInArrow(mark, "chunk long, tree_id int, data binary")


def walked(nodes: np.ndarray, x: np.ndarray, max_depth: int) -> np.ndarray:
    """The line of nodes (node_id, feature or -1, threshold, ...) that each row of x comes to. NaN goes right, as in Spark."""
    ids, feature, threshold = nodes[:, 0], nodes[:, 1].astype(np.int64), nodes[:, 2]
    left, at, every = np.searchsorted(ids, 2 * ids + 1), np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(max_depth):
        f = feature[at]
        if not (f >= 0).any():
            break
        v = x[every, np.maximum(f, 0)]
        at = np.where(f >= 0, left[at] + ((v > threshold[at]) | np.isnan(v)), at)
    return at


def votes(rows: DataFrame, nodes: DataFrame, columns: int, max_depth: int, parts: list[tuple[int, int]], masks: DataFrame | None = None) -> DataFrame:
    """(row_id, part, votes, n, proba): of the trees first .. last - 1 of each part how many vote 1, how many vote at all, and the sum of their shares of label 1. rows: (row_id, x), row_id from 0; masks: unseen, where only trees that never drew a row vote on it."""
    ship(rows.sparkSession)
    chunks, masked = resample.packed(*flat(rows, columns), VOTERS), masks is not None

    def pack(key, part):
        order = np.argsort(part["node_id"].to_numpy(), kind="stable")
        own = [part[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("node_id", "feature", "threshold", "prediction", "proba")]
        own[1] = np.where(np.isnan(own[1]), -1.0, own[1])
        return pa.table({"tree_id": [int(key[0].as_py())], "data": [np.stack(own, 1)[order].tobytes()]}, pa.schema([("tree_id", pa.int32()), ("data", pa.binary())]))

    def tally(part):
        part = part.combine_chunks()
        kinds = part["kind"].to_pylist()
        of = lambda kind: part.filter(pa.array([k == kind for k in kinds]))
        own = of("rows")
        if not len(own):
            raise RuntimeError("a chunk of rows is missing: row_id isn't 0 .. n - 1")
        x, codes, first = resample.unpacked(own.select(["chunk", "start", "distinct", "codes", "tuples"]), columns)
        free = dict(zip(of("mask")["tree_id"].to_pylist(), of("mask")["codes"].to_pylist(), strict=True)) if masked else None
        found = np.zeros((3, len(parts), len(codes)))
        # in the order of trees, so sums are the same in every run
        for line in of("tree").sort_by("tree_id").to_pylist():
            table = np.frombuffer(line["codes"], np.float64).reshape(-1, 5)
            at = walked(table, x, max_depth)[codes]
            may = 1.0 if free is None else np.unpackbits(np.frombuffer(free[line["tree_id"]], np.uint8))[: len(codes)].astype(float)
            for k, (low, high) in enumerate(parts):
                if low <= line["tree_id"] < high:
                    found[0, k] += may * table[at, 3]
                    found[1, k] += may
                    found[2, k] += may * table[at, 4]
        ids = np.arange(first, first + len(codes))
        return pa.table([pa.array(np.tile(ids, len(parts))), pa.array(np.repeat(np.arange(len(parts), dtype=np.int32), len(codes))), pa.array(found[0].ravel().astype(np.int64)), pa.array(found[1].ravel().astype(np.int64)), pa.array(found[2].ravel())], names=["row_id", "part", "votes", "n", "proba"])

    nothing = [F.lit(None).cast("long").alias(c) for c in ("start", "distinct")]
    last = chunks.agg(F.max("chunk")).first()[0]
    trees = nodes.groupBy("tree_id").applyInArrow(pack, "tree_id int, data binary")
    trees = trees.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))).alias("chunk"), F.lit("tree").alias("kind"), "tree_id", *nothing, F.col("data").alias("codes"), F.lit(None).cast("binary").alias("tuples"))
    every = chunks.select("chunk", F.lit("rows").alias("kind"), F.lit(None).cast("int").alias("tree_id"), "start", "distinct", "codes", "tuples")
    if last is not None:
        every = every.unionByName(trees)
    if masks is not None:
        every = every.unionByName(masks.select("chunk", F.lit("mask").alias("kind"), "tree_id", *nothing, F.col("data").alias("codes"), F.lit(None).cast("binary").alias("tuples")))
    return every.repartition((last or 0) + 1, "chunk").groupBy("chunk").applyInArrow(tally, "row_id long, part int, votes long, n long, proba double")
