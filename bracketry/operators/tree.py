"""Exact entropy trees and bagged forests, grown level by level for all trees at once.

A level is one plan: the live rows' features are unpivoted and counted by (tree,
node, feature, value); running sums over the sorted values give every cut's gain.
Running sums are taken in two steps, within value ranges and over range totals, so
no task sorts a whole feature. Only node tables, bounded by trees * 2^depth, are
joined back. A node of few enough rows, by its counted size, goes to one task, which
grows all that is below it; larger nodes' rows never come together.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from bracketry.functions.scalars import binary_entropy, draw
from bracketry.session import checkpointed, ship

#: Ranges that a feature's values are cut into for the running sums; digits of a gain that is written down, and those that splits are ranked by: gains nearer than TIE are ties.
RANGES, DIGITS, RANKED, TIE = 32, 9, 12, 1e-12

#: Values, rows times features, of the largest node that one task grows to its end: 8 MB, some ten times that while it is sorted.
TASK_CELLS = 1_000_000

NODES = "tree_id int, node_id long, feature int, threshold double, is_leaf boolean, prediction int, proba double, n long, gain double"


def entropy(labels: DataFrame, column: str) -> DataFrame:
    """(h): entropy of a label of any type, in bits; 0 for no rows."""
    share = F.col("n") / F.sum("n").over(W.Window.partitionBy())
    return labels.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("p", share).agg(F.coalesce(-F.sum(F.col("p") * F.log2("p")), F.lit(0.0)).alias("h"))


def information_gain(rows: DataFrame, split: str, label: str) -> DataFrame:
    """(gain): the entropy of a label less the size-weighted entropies of the parts that split makes."""
    n = F.count(F.lit(1)).alias("n")
    parts = rows.groupBy(split, label).agg(n).withColumn("k", F.sum("n").over(W.Window.partitionBy(split)))
    within = parts.agg((-F.sum(F.col("n") * F.log2(F.col("n") / F.col("k"))) / F.sum("n")).alias("w"))
    return entropy(rows, label).crossJoin(within).select((F.col("h") - F.col("w")).alias("gain"))


def cuts(rows: DataFrame, min_leaf: int = 1, features: Column | None = None) -> DataFrame:
    """All admissible cuts (tree_id, node_id, feature, threshold, gain, n, pos), gains as they are, of rows (tree_id, node_id, x, y, m). features: a boolean over feature, tree_id and node_id. Rows with a list `only` are unpivoted for its features alone."""
    if "only" in rows.columns:
        unpivoted = F.inline(F.transform("only", lambda f: F.struct(f.alias("feature"), F.get("x", f).alias("v"))))
    else:
        unpivoted = F.posexplode("x").alias("feature", "v")
    long = rows.select("tree_id", "node_id", unpivoted, "y", "m")
    if features is not None:
        long = long.where(features)
    counted = long.groupBy("tree_id", "node_id", "feature", "v").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("y")).alias("pos"))
    ranges = counted.groupBy("feature").agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 1000).alias("edges"))
    counted = counted.join(F.broadcast(ranges), "feature").withColumn("part", F.aggregate("edges", F.lit(0), lambda a, e: a + (F.col("v") > e).cast("int"))).drop("edges")
    key = ["tree_id", "node_id", "feature"]
    parts = counted.groupBy(*key, "part").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.min("v").alias("low"))
    over = W.Window.partitionBy(*key).orderBy("part")
    before, whole = over.rowsBetween(W.Window.unboundedPreceding, -1), W.Window.partitionBy(*key)
    parts = parts.select(
        *key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("p0"),
        F.sum("n").over(whole).alias("total"), F.sum("pos").over(whole).alias("total_pos"), F.lead("low").over(over).alias("next_low"),
    )
    inner = W.Window.partitionBy(*key, "part").orderBy("v")
    upto = inner.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    placed = counted.withColumns({"ln": F.sum("n").over(upto), "lp": F.sum("pos").over(upto), "next_v": F.lead("v").over(inner)}).join(parts, [*key, "part"])
    left, left_pos, following = F.col("n0") + F.col("ln"), F.col("p0") + F.col("lp"), F.coalesce("next_v", "next_low")
    right, right_pos = F.col("total") - left, F.col("total_pos") - left_pos
    middle = (F.col("v") + following) / 2
    gain = binary_entropy(F.col("total_pos") / F.col("total")) - (left * binary_entropy(left_pos / left) + right * binary_entropy(right_pos / right)) / F.col("total")
    return placed.where(following.isNotNull() & (left >= min_leaf) & (right >= min_leaf)).select(
        *key, F.when(middle >= following, F.col("v")).otherwise(middle).alias("threshold"), gain.alias("gain"), F.col("total").alias("n"), F.col("total_pos").alias("pos")
    )


def best_split(rows: DataFrame, min_leaf: int = 1, features: Column | None = None) -> DataFrame:
    """The cut of most gain of each node, if any gains; of gains nearer than TIE the first feature, then the lowest threshold."""
    best = F.min(F.struct((-F.round("gain", RANKED)).alias("loss"), "feature", "threshold")).alias("b")
    found = cuts(rows, min_leaf, features).groupBy("tree_id", "node_id").agg(best)
    return found.where("b.loss < 0").select("tree_id", "node_id", "b.feature", "b.threshold", F.round(-F.col("b.loss"), DIGITS).alias("gain"))


def root_ties(rows: DataFrame, min_leaf: int = 1, within: float = TIE) -> DataFrame:
    """(feature, threshold, best, tied): each feature's best cut at the root, the lowest of equals, and whether its gain is within a width of the best of all."""
    best = F.min(F.struct((-F.round("gain", RANKED)).alias("loss"), "threshold", "gain")).alias("b")
    found = cuts(rows, min_leaf).groupBy("feature").agg(best).select("feature", "b.threshold", F.col("b.gain").alias("best"))
    # a row for each feature
    top = found.agg(F.max("best").alias("top"))
    return found.crossJoin(F.broadcast(top)).select("feature", "threshold", "best", (F.col("best") >= F.col("top") - within).alias("tied"))


def subset(k: int, columns: int, seed: str = "3") -> Column:
    """The k features of lowest draws at a tree and node, the first of equals."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda f: F.struct(draw(seed, F.col("tree_id"), F.col("node_id"), f).alias("draw"), f.alias("feature")))
    return F.slice(F.sort_array(drawn), 1, k)["feature"]


def subset_size(rule: str | int | None, columns: int) -> int:
    if rule is None:
        return columns
    if rule == "sqrt":
        return max(1, round(math.sqrt(columns)))
    if rule == "log2":
        return max(1, round(math.log2(columns)))
    return min(columns, int(rule))


def array_entropy(p: np.ndarray) -> np.ndarray:
    """binary_entropy of an array."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((p <= 0) | (p >= 1), 0.0, -p * np.log2(p) - (1 - p) * np.log2(1 - p))


def array_split(x: np.ndarray, y: np.ndarray, m: np.ndarray, features: list[int], min_leaf: int) -> tuple[int, float, float] | None:
    """best_split of one node's arrays: (feature, threshold, gain), if any cut gains. NaN comes last, as in Spark."""
    if not features:
        return None
    own = x[:, features]
    order = np.argsort(own, axis=0, kind="stable")
    v, n, pos = np.take_along_axis(own, order, 0), np.cumsum(m[order], 0), np.cumsum((m * y)[order], 0)
    total, total_pos, left, left_pos, low, high = n[-1, 0], pos[-1, 0], n[:-1], pos[:-1], v[:-1], v[1:]
    ok = ((low < high) | (np.isnan(high) & ~np.isnan(low))) & (left >= min_leaf) & (total - left >= min_leaf)
    if not ok.any():
        return None
    apart = left * array_entropy(left_pos / left) + (total - left) * array_entropy((total_pos - left_pos) / (total - left))
    gain = np.where(ok, np.round(array_entropy(total_pos / total) - apart / total, RANKED), 0.0)
    # the first of equals in the order of features, then of values
    k, i = divmod(int(np.argmax(gain.T)), len(gain))
    if gain[i, k] <= 0:
        return None
    middle = (low[i, k] + high[i, k]) / 2
    return features[k], float(middle if middle < high[i, k] else low[i, k]), float(gain[i, k])


def drawn_features(tree: int, node: int, k: int, columns: int, seed: str = "3") -> list[int]:
    """subset of one node."""
    if k >= columns:
        return list(range(columns))
    at = [(int(hashlib.md5(f"{seed}:{tree}:{node}:{f}".encode()).hexdigest()[:8], 16), f) for f in range(columns)]
    return sorted(f for _, f in sorted(at)[:k])


def node_schema(tree_id: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("tree_id", tree_id), ("node_id", pa.int64()), ("feature", pa.int32()), ("threshold", pa.float64()), ("is_leaf", pa.bool_()),
        ("prediction", pa.int32()), ("proba", pa.float64()), ("n", pa.int64()), ("gain", pa.float64()),
    ])


def grown(tree: int, root: int, x: np.ndarray, y: np.ndarray, m: np.ndarray, max_depth: int, min_split: int, min_leaf: int, features) -> list[dict]:
    """The nodes from root down, of arrays. features: (tree, node) -> the features it may use."""
    nodes, todo = [], [(root, np.arange(len(y)))]
    while todo:
        node, at = todo.pop()
        n, pos, cut = m[at].sum(), (m[at] * y[at]).sum(), None
        if (node + 1).bit_length() - 1 < max_depth and n >= min_split and 0 < pos < n:
            cut = array_split(x[at], y[at], m[at], features(tree, node), min_leaf)
        nodes.append({
            "tree_id": tree, "node_id": node, "feature": cut and cut[0], "threshold": cut and cut[1], "is_leaf": cut is None,
            "prediction": int(2 * pos > n), "proba": pos / n, "n": int(n), "gain": cut and cut[2],
        })
        if cut:
            v = x[at, cut[0]]
            right = (v > cut[1]) | np.isnan(v)
            todo += [(2 * node + 1, at[~right]), (2 * node + 2, at[right])]
    return nodes


def finished(rows: DataFrame, columns: int, max_depth: int, min_split: int, min_leaf: int, k: int, seed: str = "3") -> DataFrame:
    """The node tables below and with the nodes (tree_id, node_id) of rows, each grown in one task: for nodes whose size is known to be small. Rows with a list `only` use its features alone."""

    def below(key, part):
        part = part.combine_chunks()
        x = np.asarray(pa.array(part["x"].combine_chunks().flatten()), dtype=float).reshape(len(part), columns)
        y, m = (part[c].to_numpy().astype(float) for c in ("y", "m"))
        only = sorted(part["only"][0].as_py() or []) if "only" in part.column_names else None
        features = lambda tree, node: only if only is not None else drawn_features(tree, node, k, columns, seed)
        return pa.Table.from_pylist(grown(key[0].as_py(), key[1].as_py(), x, y, m, max_depth, min_split, min_leaf, features), schema)

    wide = rows.schema["tree_id"].dataType.simpleString()
    schema = node_schema({"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16()}[wide])
    ship(rows.sparkSession)
    grown_ = rows.groupBy("tree_id", "node_id").applyInArrow(below, NODES.replace("tree_id int", f"tree_id {wide}"))
    return grown_.withColumn("gain", F.round("gain", DIGITS))


def grow(rows: DataFrame, columns: int, max_depth: int, min_split: int = 2, min_leaf: int = 1, rule: str | int | None = None, keep=None, allowed: Column | None = None, task_cells: int = TASK_CELLS) -> DataFrame:
    """The node table of every tree of rows (tree_id, x, y, m). allowed: a boolean over tree_id and feature, where trees see some features only. Lineage is cut between levels (keep: DataFrame -> DataFrame), so plans stay small and lost executors cost no regrowth. Nodes of at most task_cells values are grown to their end by one task each; the table is the same for any task_cells."""
    if rule is not None and allowed is not None:
        raise ValueError("a rule draws among all features: give rule or allowed")
    keep = keep or checkpointed
    k, key = subset_size(rule, columns), ["tree_id", "node_id"]
    live = rows.select("tree_id", F.lit(0).cast("long").alias("node_id"), F.col("x").cast("array<double>").alias("x"), "y", "m")
    out = None
    for depth in range(max_depth + 1):
        live = keep(live)
        totals = keep(live.groupBy(*key).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("y")).alias("pos"), F.count(F.lit(1)).alias("size")))
        opened = F.lit(depth < max_depth) & (F.col("n") >= min_split) & (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
        small = opened & (F.col("size") * columns <= task_cells)
        there = totals.agg(F.bool_or(small).alias("small"), F.bool_or(opened & ~small).alias("large")).first()
        if there.small:
            few = live.join(totals.where(small).select(*key), key)
            if allowed is not None:
                seen = totals.select("tree_id").distinct().withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).where(allowed)
                few = few.join(seen.groupBy("tree_id").agg(F.collect_list("feature").alias("only")), "tree_id", "left")
            part = finished(few, columns, max_depth, min_split, min_leaf, k)
            out = part if out is None else out.unionByName(part)
        open_ = totals.where(opened & ~small).select(*key)
        if there.large:
            # features are drawn once a node, not once a row
            asked = open_.withColumn("only", subset(k, columns)) if k < columns else open_
            found = keep(best_split(live.join(asked, key), min_leaf, allowed))
        else:
            found = open_.limit(0).selectExpr(*key, "0 AS feature", "0D AS threshold", "0D AS gain")
        level = totals.where(~small).join(found, key, "left").select(
            *key, F.col("feature").cast("int").alias("feature"), "threshold", F.col("feature").isNull().alias("is_leaf"),
            F.when(2 * F.col("pos") > F.col("n"), 1).otherwise(0).alias("prediction"), (F.col("pos") / F.col("n")).alias("proba"), F.col("n").cast("long").alias("n"), "gain",
        )
        out = level if out is None else out.unionByName(level)
        if not there.large or found.isEmpty():
            break
        right = (F.element_at("x", F.col("feature") + 1) > F.col("threshold")).cast("long")
        live = live.join(found, key).select("tree_id", (2 * F.col("node_id") + 1 + right).alias("node_id"), "x", "y", "m")
    return keep(out)


def landed(rows: DataFrame, nodes: DataFrame, max_depth: int) -> DataFrame:
    """(tree_id, row_id, node_id): the leaf that each row (row_id, x) comes to in each tree; a step of the walk is a join with the node table."""
    trees = nodes.select("tree_id").distinct()
    at = rows.select("row_id", "x").crossJoin(F.broadcast(trees)).withColumn("node_id", F.lit(0).cast("long"))
    table_ = nodes.select("tree_id", "node_id", "feature", "threshold", "is_leaf")
    for _ in range(max_depth):
        right = (F.element_at("x", F.col("feature") + 1) > F.col("threshold")).cast("long")
        at = at.join(table_, ["tree_id", "node_id"]).select("row_id", "x", "tree_id", F.when(F.col("is_leaf"), F.col("node_id")).otherwise(2 * F.col("node_id") + 1 + right).alias("node_id"))
    return at.select("tree_id", "row_id", "node_id")


def predict(rows: DataFrame, nodes: DataFrame, max_depth: int) -> DataFrame:
    """(tree_id, row_id, prediction, proba) for rows (row_id, x)."""
    return landed(rows, nodes, max_depth).join(nodes.select("tree_id", "node_id", "prediction", "proba"), ["tree_id", "node_id"]).select("tree_id", "row_id", "prediction", "proba")


def at_depths(reached: DataFrame, nodes: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """(depth, tree_id, row_id, prediction, proba) of the trees cut at each depth: a shallower tree is a deeper one's top, so a leaf's answer there is its ancestor's."""
    level = F.length(F.bin(F.col("node_id") + 1)) - 1
    up = reached.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))).withColumn("up", F.greatest(level - F.col("depth"), F.lit(0)))
    up = up.withColumn("node_id", F.expr("shiftright(node_id + 1, up) - 1"))
    return up.join(nodes.select("tree_id", "node_id", "prediction", "proba"), ["tree_id", "node_id"]).select("depth", "tree_id", "row_id", "prediction", "proba")


def shape(nodes: DataFrame) -> DataFrame:
    """(tree_id, depth, leaves, internal); a lone leaf has depth 0."""
    depth = F.max(F.floor(F.log2(F.col("node_id") + 1))).cast("int").alias("depth")
    return nodes.groupBy("tree_id").agg(depth, F.count_if("is_leaf").alias("leaves"), F.count_if(~F.col("is_leaf")).alias("internal"))


def importances(nodes: DataFrame) -> DataFrame:
    """(feature, importance): the gain times size of a feature's nodes, as shares."""
    raw = nodes.where("NOT is_leaf").groupBy("feature").agg(F.sum(F.col("gain") * F.col("n")).alias("g"))
    return raw.select("feature", (F.col("g") / F.sum("g").over(W.Window.partitionBy())).alias("importance"))


def bagged(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """rows (row_id, x, y) as each tree sees them: with the number of times it drew them."""
    return drawn.join(rows, "row_id").select(F.col("b").alias("tree_id"), "x", "y", "m")


def print_tree(nodes: DataFrame, names: list[str], tree_id: int = 0, levels: int = 3) -> str:
    """The top levels of one tree as text."""
    rows = {r.node_id: r for r in nodes.where((F.col("tree_id") == tree_id) & (F.col("node_id") < 2**levels - 1)).collect()}

    def lines(i: int, indent: str) -> list[str]:
        if (r := rows.get(i)) is None:
            return []
        if r.is_leaf:
            return [f"{indent}{r.prediction} (p={r.proba:.3f}, n={r.n})"]
        return [f"{indent}{names[r.feature]} <= {r.threshold:.4g} (gain={r.gain:.4f}, n={r.n})", *lines(2 * i + 1, indent + "  "), *lines(2 * i + 2, indent + "  ")]

    return "\n".join(lines(0, ""))


class DecisionTree:
    """One tree over rows (row_id, x, y): fit, then predict, predict_proba, score, and its shape."""

    def __init__(self, max_depth: int = 12, min_samples_split: int = 2, min_samples_leaf: int = 1):
        self.max_depth, self.min_split, self.min_leaf = max_depth, min_samples_split, min_samples_leaf
        self.nodes: DataFrame | None = None

    def fit(self, rows: DataFrame) -> DecisionTree:
        """Labels other than 0 and 1 raise."""
        label = F.when(F.col("y").isin(0, 1), F.col("y")).otherwise(F.raise_error(F.concat(F.lit("label is not 0 or 1: "), F.coalesce(F.col("y").cast("string"), F.lit("none")))))
        columns = rows.select(F.size("x").alias("k")).first()
        one = rows.select(F.lit(0).alias("tree_id"), "x", label.cast("int").alias("y"), F.lit(1).alias("m"))
        self.nodes = grow(one, columns.k if columns else 0, self.max_depth, self.min_split, self.min_leaf)
        return self

    def _fitted(self) -> DataFrame:
        if self.nodes is None:
            raise ValueError("the tree has not been fitted")
        return self.nodes

    def _leaves(self, rows: DataFrame) -> DataFrame:
        return predict(rows, self._fitted(), self.max_depth)

    def predict(self, rows: DataFrame) -> DataFrame:
        """(row_id, prediction)."""
        return self._leaves(rows).select("row_id", "prediction")

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        """(row_id, proba): the share of label 1 in the row's leaf."""
        return self._leaves(rows).select("row_id", "proba")

    def score(self, rows: DataFrame) -> float | None:
        """Accuracy; none without rows."""
        return self.predict(rows).join(rows.select("row_id", "y"), "row_id").agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]

    @property
    def depth(self) -> int:
        return shape(self._fitted()).first().depth

    @property
    def n_leaves(self) -> int:
        return shape(self._fitted()).first().leaves

    @property
    def n_internal(self) -> int:
        return shape(self._fitted()).first().internal


def chosen_depth(scores: DataFrame) -> DataFrame:
    """scores (depth, accuracy) with chosen: the depth of most accuracy, the shallowest of equals."""
    # a row for each depth that is tried
    best = scores.agg(F.min(F.struct((-F.col("accuracy")).alias("loss"), "depth")).alias("b")).select(F.col("b.depth").alias("of"))
    return scores.crossJoin(F.broadcast(best)).select("depth", "accuracy", (F.col("depth") == F.col("of")).alias("chosen"))
