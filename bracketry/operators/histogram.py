"""Trees over overlapping sets of the same rows, which are packed once.

Rows are packed in chunks: each feature's distinct values there, sorted, and each row's
place among them. A level of all trees is one pass: every task walks its rows to the open
nodes and counts them by value, and the counts of a tree, a feature and a group of nodes
meet in one task, which finds the best cuts. The driver holds the trees' nodes, bounded by
trees * 2^depth. A node of few enough rows, by its counted size, goes to one task, which
grows all below it; the rows of all such nodes are sent once, at the end. Node tables are
those of tree.grow, which takes over where a feature has too many values to meet.

By bins, no task gets all values of a feature. Counts meet by ranges of values first: a
cut's gain is convex in what lies left of it, so its bound within a bin is at the corners
of what the bin's rows allow. Only bins whose bound reaches the best cut between bins are
then counted by value. The cuts are the same; trees whose nodes are still alike are
counted once.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bracketry.operators import tree
from bracketry.operators.resample import narrow
from bracketry.session import checkpointed, ship

#: Rows of a chunk of up to WIDE columns, rows of the nodes whose counts meet in a task, values of a feature that are sent by number, and values, summed over chunks, that a task may get of one feature.
CHUNK, GROUP, NUMBERED, MOST, WIDE = 1 << 18, 1 << 20, 1 << 16, 8_000_000, 24

#: Bins of a feature, bins times open nodes that a task counts in for a tree and a feature, and what a bound may fall short of the best cut by: rounding, and gains that count as ties.
BINS, CELLS, SHORT = 1 << 12, 1 << 16, 1e-9


class Tree(NamedTuple):
    """A tree over the rows whose `at` is below until."""

    tree_id: int
    until: float
    max_depth: int
    min_split: int
    min_leaf: int


class Top(NamedTuple):
    """A tree's nodes by rising id: feature or -1, threshold, line of the left child, and the number of what rows there are wanted for, or -1."""

    tree: Tree
    ids: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    slot: np.ndarray


def packed(rows: DataFrame, columns: int) -> DataFrame:
    """(n, y, codes, values) of rows (x, y, at): the codes and values of every feature and, last, of at."""
    ship(rows.sparkSession)

    def chunk(held):
        x, y, at = (np.concatenate(part) for part in zip(*held, strict=True))
        codes, values = [], []
        for column in (*x.T, at):
            own, place = np.unique(column, return_inverse=True)
            codes.append(narrow(place.ravel(), len(own)).tobytes())
            values.append(own.tobytes())
        own = {"n": [len(y)], "y": [y.tobytes()], "codes": [codes], "values": [values]}
        kinds = [("n", pa.int64()), ("y", pa.binary()), ("codes", pa.list_(pa.binary())), ("values", pa.list_(pa.binary()))]
        return pa.RecordBatch.from_pydict(own, pa.schema(kinds))

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, columns)
            held.append((x, batch.column("y").to_numpy(zero_copy_only=False).astype(np.uint8), batch.column("at").to_numpy(zero_copy_only=False).astype(float)))
            n += batch.num_rows
            if n * max(columns, WIDE) >= CHUNK * WIDE:
                yield chunk(held)
                held, n = [], 0
        if n:
            yield chunk(held)

    flat = rows.select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("int").alias("y"), F.col("at").cast("double").alias("at"))
    return checkpointed(flat.mapInArrow(pack, "n long, y binary, codes array<binary>, values array<binary>"))


def opened(batches):
    """(y, codes, values, at) of each chunk: codes a column for each feature, at a number for each row."""
    for batch in batches:
        for y, codes, values in zip(*(batch.column(c).to_pylist() for c in ("y", "codes", "values")), strict=True):
            values = [np.frombuffer(v) for v in values]
            codes = [np.frombuffer(c, narrow(np.zeros(0), len(v)).dtype) for c, v in zip(codes, values, strict=True)]
            yield np.frombuffer(y, np.uint8), np.stack([c.astype(np.int32) for c in codes[:-1]], 1) if len(codes) > 1 else np.zeros((len(codes[0]), 0), np.int32), values[:-1], values[-1][codes[-1]]


def totals(chunks: DataFrame) -> list[tuple[float, int, int]]:
    """(at, rows, rows of label 1) by rising at."""

    def sums(batches):
        for y, _, _, at in opened(batches):
            own, place = np.unique(at, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(place)), pa.array(np.bincount(place, y).astype(np.int64))], names=["at", "n", "pos"])

    found = chunks.mapInArrow(sums, "at double, n long, pos long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return sorted((r.at, r.n, r.pos) for r in found.collect())


def topped(own: Tree, nodes: dict[int, dict], slots: dict[int, int]) -> Top:
    ids = np.array(sorted(nodes), np.int64)
    feature = np.array([-1 if nodes[i]["feature"] is None else nodes[i]["feature"] for i in ids.tolist()], np.int64)
    threshold = np.array([np.nan if nodes[i]["threshold"] is None else nodes[i]["threshold"] for i in ids.tolist()], float)
    return Top(own, ids, feature, threshold, np.searchsorted(ids, 2 * ids + 1), np.array([slots.get(i, -1) for i in ids.tolist()], np.int64))


def places(top: Top, codes: np.ndarray, values: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The line of a top's nodes that each of some rows comes to. NaN goes right, as in Spark."""
    bound, at, flat, base = np.zeros(len(top.ids), np.int64), np.zeros(len(rows), np.int64), codes.ravel(), rows * codes.shape[1]
    for f in np.unique(top.feature[top.feature >= 0]):
        own = top.feature == f
        bound[own] = np.searchsorted(values[f], top.threshold[own], "right")
    for _ in range(top.tree.max_depth):
        f = top.feature[at]
        if not (f >= 0).any():
            break
        at = np.where(f >= 0, top.left[at] + (flat[base + np.maximum(f, 0)] >= bound[at]), at)
    return at


def wanted(tops: list[Top], codes: np.ndarray, values: list[np.ndarray], at: np.ndarray):
    """(top, rows, slots) of each tree that has rows at wanted nodes."""
    for top in tops:
        rows = np.flatnonzero(at < top.tree.until)
        slot = top.slot[places(top, codes, values, rows)]
        if (there := slot >= 0).any():
            yield top, rows[there], slot[there]


def summed(key: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that occur, how often, and how often with label 1."""
    if width <= 4 * len(key) + 1024:
        n, pos = np.bincount(key, minlength=width), np.bincount(key[y == 1], minlength=width)
        own = np.flatnonzero(n)
        return own, n[own], pos[own]
    both = np.sort(key * 2 + y)
    own = both >> 1
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], np.diff(np.append(first, len(own))), np.add.reduceat(both & 1, first)


def best_cuts(slot: np.ndarray, v: np.ndarray, n: np.ndarray, pos: np.ndarray, min_leaf: int) -> tuple[np.ndarray, ...]:
    """(slot, gain, threshold, n and pos on the left) of the best cut of each slot that gains, the lowest of equals; entries by rising slot and value, which may repeat."""
    same = (slot[1:] == slot[:-1]) & ((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    slot, v, n, pos = slot[first], v[first], np.add.reduceat(n, first).astype(float), np.add.reduceat(pos, first).astype(float)
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(slot))))
    total, total_pos = np.add.reduceat(n, first)[of], np.add.reduceat(pos, first)[of]
    left, left_pos = np.cumsum(n), np.cumsum(pos)
    left, left_pos = left - (left - n)[first][of], left_pos - (left_pos - pos)[first][of]
    ok = np.append(of[1:] == of[:-1], False) & (left >= min_leaf) & (total - left >= min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = left * tree.array_entropy(left_pos / left) + (total - left) * tree.array_entropy((total_pos - left_pos) / (total - left))
        gain = np.where(ok, np.round(tree.array_entropy(total_pos / total) - apart / total, tree.RANKED), 0.0)
    hit = np.flatnonzero((gain > 0) & (gain == np.maximum.reduceat(gain, first)[of]))
    at = hit[np.unique(of[hit], return_index=True)[1]]
    low, high = v[at], v[np.minimum(at + 1, len(v) - 1)]
    middle = (low + high) / 2
    return slot[at], gain[at], np.where(middle < high, middle, low), left[at].astype(np.int64), left_pos[at].astype(np.int64)


def level(chunks: DataFrame, columns: int, tops: list[Top], groups: dict[int, np.ndarray]) -> list[tuple]:
    """(tree_id, slot, feature, gain, threshold, n, pos) of the best cut of every wanted node that has one. groups: each tree's group of each slot, rising."""
    least = {t.tree.tree_id: t.tree.min_leaf for t in tops}

    def count(batches):
        names = ["tree_id", "feature", "part", "slot", "v", "n", "pos"]
        for y, codes, values, at in opened(batches):
            for top, rows, slot in wanted(tops, codes, values, at):
                group, own_y, out = groups[top.tree.tree_id], y[rows], []
                for f in range(columns):
                    card = len(values[f])
                    key, n, pos = summed(slot * card + codes[rows, f], own_y, len(group) * card)
                    at_slot = key // card
                    part = group[at_slot]
                    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() + [len(part)]
                    entries = at_slot.astype(np.int32), values[f][key % card], n.astype(np.int32), pos.astype(np.int32)
                    out += [(top.tree.tree_id, f, int(part[a]), *(e[a:b].tobytes() for e in entries)) for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 3 else pa.binary()) for k, c in enumerate(zip(*out, strict=True))], names=names)

    def best(key, part):
        slot, v, n, pos = (np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in part[c]]) for c, kind in (("slot", np.int32), ("v", np.float64), ("n", np.int32), ("pos", np.int32)))
        order = np.lexsort((v, slot))
        found = best_cuts(slot[order], v[order], n[order].astype(np.int64), pos[order].astype(np.int64), least[key[0].as_py()])
        ends = [pa.array(np.full(len(found[0]), k.as_py(), np.int32)) for k in key[:2]]
        return pa.table([*ends, pa.array(found[0].astype(np.int32)), *map(pa.array, found[1:])], names=["tree_id", "feature", "slot", "gain", "threshold", "n", "pos"])

    counts = chunks.mapInArrow(count, "tree_id int, feature int, part int, slot binary, v binary, n binary, pos binary")
    cuts = checkpointed(counts.groupBy("tree_id", "feature", "part").applyInArrow(best, "tree_id int, feature int, slot int, gain double, threshold double, n long, pos long"))
    # of the gains the largest, then the first feature: a row for each open node
    top = F.min(F.struct((-F.col("gain")).alias("loss"), "feature", "threshold", "n", "pos")).alias("b")
    return [(r.tree_id, r.slot, r.b.feature, -r.b.loss, r.b.threshold, r.b.n, r.b.pos) for r in cuts.groupBy("tree_id", "slot").agg(top).collect()]


def edged(chunks: DataFrame, columns: int) -> tuple[list[np.ndarray], list[bool]]:
    """The last value of each of a feature's bins, at most BINS of some equal numbers of rows, and whether every bin is one value."""

    def sample(batches):
        for y, codes, values, _ in opened(batches):
            out = []
            for f in range(columns):
                own = values[f]
                if len(own) > BINS:
                    upto = np.cumsum(np.bincount(codes[:, f], minlength=len(own)))
                    own = own[np.unique(np.searchsorted(upto, np.linspace(1, len(y), BINS)))]
                out.append((f, len(own) == len(values[f]), own.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["feature", "whole", "data"])

    def merge(key, part):
        every = np.sort(np.concatenate([np.frombuffer(b.as_buffer()) for b in part["data"]]))
        own = np.unique(every)
        whole = len(own) <= BINS and all(part["whole"].to_pylist())
        if len(own) > BINS:
            own = np.unique(every[np.linspace(0, len(every) - 1, BINS).astype(np.int64)])
        return pa.table({"feature": [key[0].as_py()], "whole": [whole], "data": [own.tobytes()]}, pa.schema([("feature", pa.int32()), ("whole", pa.bool_()), ("data", pa.binary())]))

    kinds = "feature int, whole boolean, data binary"
    found = {r.feature: r for r in chunks.mapInArrow(sample, kinds).groupBy("feature").applyInArrow(merge, kinds).collect()}
    return [np.frombuffer(found[f].data) if f in found else np.zeros(0) for f in range(columns)], [f in found and found[f].whole for f in range(columns)]


def gains(left: np.ndarray, left_pos: np.ndarray, total: np.ndarray, total_pos: np.ndarray) -> np.ndarray:
    """The gain of cuts with so many rows, and rows of label 1, on the left; 0 where a side is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = left * tree.array_entropy(left_pos / left) + (total - left) * tree.array_entropy((total_pos - left_pos) / (total - left))
        return np.where((left > 0) & (left < total), tree.array_entropy(total_pos / total) - apart / total, 0.0)


def between(counts: np.ndarray, min_leaf: int) -> np.ndarray:
    """The best gain of each slot from cuts between bins. counts: slots by bins by rows and rows of label 1."""
    upto, total = np.cumsum(counts, 1), counts.sum(1, keepdims=True)
    left = upto[..., 0]
    ok = (counts[..., 0] > 0) & (left >= min_leaf) & (total[..., 0] - left >= min_leaf)
    return np.where(ok, gains(left, upto[..., 1], total[..., 0], total[..., 1]), 0.0).max(1)


def promising(counts: np.ndarray, least: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bins, for each slot, in or after which a cut may gain as much as least, and with them those that follow."""
    upto, total = np.cumsum(counts, 1), counts.sum(1, keepdims=True)
    n, pos = counts[..., 0], counts[..., 1]
    before, before_pos = upto[..., 0] - n, upto[..., 1] - pos
    # all rows, those of label 1, those of label 0: the corners besides the bin's start, which is the end of another
    corners = [(n, pos)] if whole else [(n, pos), (pos, pos), (n - pos, 0)]
    bound = np.max([gains(before + a, before_pos + b, total[..., 0], total[..., 1]) for a, b in corners], axis=0)
    open_ = (n > 0) & (bound >= least[:, None] - SHORT) & (bound > 0.1 * 10.0**-tree.RANKED)
    after = np.zeros_like(open_)
    for slot in range(len(open_)):
        there = np.flatnonzero(n[slot])
        after[slot, there[1:]] = open_[slot, there[:-1]]
    return open_, open_ | after


def level_by_bins(chunks: DataFrame, tops: list[Top], sees: dict[int, list[int]], edges: list[np.ndarray], whole: list[bool]) -> list[tuple]:
    """What level finds, of trees that see some features each."""
    alike: dict[tuple, list[Top]] = defaultdict(list)
    for t in (t for t in tops if sees[t.tree.tree_id]):
        alike[t.tree.until, t.tree.min_leaf, t.tree.max_depth, *(a.tobytes() for a in t[1:])].append(t)
    groups = [(own[0], sorted({f for t in own for f in sees[t.tree.tree_id]}), [t.tree.tree_id for t in own]) for own in alike.values()]
    slots = [int(top.slot.max()) + 1 for top, _, _ in groups]
    # fewer bins for more nodes, so that a task's counts stay as large
    step = [max(1, -(-k * BINS // CELLS)) for k in slots]
    ends = [{f: edges[f][:: step[g]] for f in own} for g, (_, own, _) in enumerate(groups)]
    alone = [{f: whole[f] and step[g] == 1 for f in own} for g, (_, own, _) in enumerate(groups)]
    heads = [top for top, _, _ in groups]

    def walked(batches):
        for y, codes, values, at in opened(batches):
            columns = np.ascontiguousarray(codes.T)
            number = {id(t): g for g, t in enumerate(heads)}
            for top, rows, slot in wanted(heads, codes, values, at):
                yield number[id(top)], columns, values, y[rows], rows, slot

    def count(batches):
        for g, columns, values, y, rows, slot in walked(batches):
            out = []
            for f, end in ends[g].items():
                width = len(end) + 1
                key = slot * width + np.searchsorted(end, values[f])[columns[f][rows]]
                n = np.bincount(2 * key + y, minlength=2 * slots[g] * width)
                out.append((g, f, n.astype(np.uint16 if n.max() < 1 << 16 else np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["own", "feature", "data"])

    def shaped(g, f, data):
        return np.frombuffer(data, np.int64).reshape(slots[g], len(ends[g][f]) + 1, 2)

    def meet(key, part):
        g, f = (k.as_py() for k in key)
        size, total = slots[g] * (len(ends[g][f]) + 1) * 2, 0
        for b in part["data"]:
            total = total + np.frombuffer(b.as_buffer(), np.int64 if len(b.as_buffer()) == 8 * size else np.uint16).astype(np.int64)
        # label 0 and label 1 become rows and label 1
        total[::2] += total[1::2]
        best = between(shaped(g, f, total.tobytes()), groups[g][0].tree.min_leaf)
        return pa.table({"own": [g], "feature": [f], "best": [best.tobytes()], "data": [total.tobytes()]}, pa.schema([("own", pa.int32()), ("feature", pa.int32()), ("best", pa.binary()), ("data", pa.binary())]))

    if not groups:
        return []
    met = checkpointed(chunks.mapInArrow(count, "own int, feature int, data binary").groupBy("own", "feature").applyInArrow(meet, "own int, feature int, best binary, data binary"))
    best = {(r.own, r.feature): np.frombuffer(r.best) for r in met.select("own", "feature", "best").collect()}
    least = {}
    for g, (_, own, ids) in enumerate(groups):
        of_tree = {t: np.max([best[g, f] for f in sees[t]], axis=0) for t in ids}
        least |= {(g, f): np.min([of_tree[t] for t in ids if f in sees[t]], axis=0) for f in own}

    def mark(batches):
        for batch in batches:
            for g, f, data in zip(*(batch.column(c).to_pylist() for c in ("own", "feature", "data")), strict=True):
                open_, asked = promising(shaped(g, f, data), least[g, f], alone[g][f])
                if open_.any():
                    yield pa.RecordBatch.from_pydict({"own": [g], "feature": [f], "open": [np.packbits(open_).tobytes()], "asked": [np.packbits(asked).tobytes()]}, pa.schema([("own", pa.int32()), ("feature", pa.int32()), ("open", pa.binary()), ("asked", pa.binary())]))

    # a bit for each bin
    marks = {(r.own, r.feature): (r.open, r.asked) for r in met.mapInArrow(mark, "own int, feature int, open binary, asked binary").collect()}

    def bits(g, f, k):
        width = len(ends[g][f]) + 1
        return np.unpackbits(np.frombuffer(marks[g, f][k], np.uint8), count=slots[g] * width).astype(bool).reshape(slots[g], width)

    def send(batches):
        asked = {key: bits(*key, 1) for key in marks}
        for g, columns, values, y, rows, slot in walked(batches):
            out = []
            for f in ends[g]:
                if (g, f) in marks:
                    code = columns[f][rows]
                    there = np.flatnonzero(asked[g, f][slot, np.searchsorted(ends[g][f], values[f])[code]])
                    if len(there):
                        card = len(values[f])
                        key, n, pos = summed(slot[there] * card + code[there], y[there], slots[g] * card)
                        entries = (key // card).astype(np.int32), values[f][key % card], n.astype(np.int64), pos.astype(np.int64)
                        out.append((g, f, *(e.tobytes() for e in entries)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.binary()) for k, c in enumerate(zip(*out, strict=True))], names=["own", "feature", "slot", "v", "n", "pos"])

    def cut(key, part, counted):
        g, f = (k.as_py() for k in key)
        counts, open_, min_leaf = shaped(g, f, counted["data"][0].as_py()), bits(g, f, 0), groups[g][0].tree.min_leaf
        slot, v, n, pos = (np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in part[c]]) for c, kind in (("slot", np.int32), ("v", np.float64), ("n", np.int64), ("pos", np.int64)))
        order = np.lexsort((v, slot))
        slot, v, n, pos = slot[order], v[order], n[order], pos[order]
        same = (slot[1:] == slot[:-1]) & ((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        slot, v, n, pos = slot[first], v[first], np.add.reduceat(n, first), np.add.reduceat(pos, first)
        at = np.searchsorted(ends[g][f], v)
        # what lies left of the bin, and what of the bin lies left of the cut
        start = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (at[1:] != at[:-1])]))
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(slot))))
        before, totals_ = (np.cumsum(counts, 1) - counts)[slot, at], counts.sum(1)[slot]
        inside = np.stack([np.cumsum(n), np.cumsum(pos)], 1)
        left = (before + inside - (inside - np.stack([n, pos], 1))[start][of]).astype(float)
        total = totals_.astype(float)
        follows = np.append((slot[1:] == slot[:-1]) & ((at[1:] == at[:-1]) | open_[slot[:-1], at[:-1]]), False)
        ok = follows & (left[:, 0] >= min_leaf) & (total[:, 0] - left[:, 0] >= min_leaf)
        gain = np.where(ok, np.round(gains(left[:, 0], left[:, 1], total[:, 0], total[:, 1]), tree.RANKED), 0.0)
        low, high = v, np.append(v[1:], np.nan)
        middle = (low + high) / 2
        hit = np.flatnonzero(gain > 0)
        # the most gain, then the lowest
        hit = hit[np.lexsort((hit, -gain[hit], slot[hit]))]
        hit = hit[np.unique(slot[hit], return_index=True)[1]]
        ends_ = [pa.array(np.full(len(hit), k, np.int32)) for k in (g, f)]
        return pa.table([*ends_, pa.array(slot[hit].astype(np.int32)), pa.array(gain[hit]), pa.array(np.where(middle < high, middle, low)[hit]), *(pa.array(left[hit, k].astype(np.int64)) for k in (0, 1))], names=["own", "feature", "slot", "gain", "threshold", "n", "pos"])

    sent = chunks.mapInArrow(send, "own int, feature int, slot binary, v binary, n binary, pos binary").groupBy("own", "feature")
    kept = met.select("own", "feature", "data").join(F.broadcast(chunks.sparkSession.createDataFrame(sorted(marks), "own int, feature int")), ["own", "feature"]) if marks else met.limit(0).select("own", "feature", "data")
    found = defaultdict(list)
    for r in sent.cogroup(kept.groupBy("own", "feature")).applyInArrow(cut, "own int, feature int, slot int, gain double, threshold double, n long, pos long").collect() if marks else []:
        for t in groups[r.own][2]:
            if r.feature in sees[t]:
                found[t, r.slot].append((-r.gain, r.feature, r.threshold, r.n, r.pos))
    return [(t, slot, f, -loss, threshold, n, pos) for (t, slot), each in found.items() for loss, f, threshold, n, pos in [min(each)]]


def numbers(chunks: DataFrame, columns: int) -> dict[int, np.ndarray]:
    """The sorted values of each feature that has at most NUMBERED."""

    def merge(key, part):
        own = np.unique(np.concatenate([np.frombuffer(b.as_buffer()) for b in part["data"]]))
        return pa.table({"feature": [key[0].as_py()], "data": [own.tobytes() if len(own) <= NUMBERED else None]}, pa.schema([("feature", pa.int32()), ("data", pa.binary())]))

    each = chunks.select(F.posexplode("values").alias("feature", "data")).where(F.col("feature") < columns)
    return {r.feature: np.frombuffer(r.data) for r in each.groupBy("feature").applyInArrow(merge, "feature int, data binary").where("data IS NOT NULL").collect()}


def below(chunks: DataFrame, columns: int, tops: list[Top], known: dict[int, np.ndarray], sees: dict[int, list[int]]) -> DataFrame:
    """The node tables below and with the wanted nodes, each grown in one task; a slot is a node's line here. known: numbers, by which values are sent."""
    kinds = np.dtype([*[(f"x{f}", narrow(np.zeros(0), len(known[f])).dtype if f in known else np.float64) for f in range(columns)], ("y", np.uint8)])
    own, nodes = {t.tree.tree_id: t.tree for t in tops}, {t.tree.tree_id: t.ids for t in tops}

    def send(batches):
        for y, codes, values, at in opened(batches):
            numbered = [np.searchsorted(known[f], values[f]) if f in known else values[f] for f in range(columns)]
            for top, rows, slot in wanted(tops, codes, values, at):
                order = np.argsort(slot, kind="stable")
                rows, slot = rows[order], slot[order]
                sent = np.empty(len(rows), kinds)
                for f in range(columns):
                    sent[f"x{f}"] = numbered[f].astype(kinds[f"x{f}"])[codes[rows, f]]
                sent["y"] = y[rows]
                edges = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])).tolist() + [len(slot)]
                ids = nodes[top.tree.tree_id][slot[edges[:-1]]]
                data = [sent[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([top.tree.tree_id] * len(ids), pa.int32()), pa.array(ids), pa.array(data, pa.binary())], names=["tree_id", "node_id", "data"])

    def finish(key, part):
        rows, t = np.concatenate([np.frombuffer(b.as_buffer(), kinds) for b in part["data"]]), own[key[0].as_py()]
        x = np.stack([known[f][rows[f"x{f}"]] if f in known else rows[f"x{f}"] for f in range(columns)], 1)
        found = tree.grown(t.tree_id, key[1].as_py(), x, rows["y"].astype(float), np.ones(len(rows)), t.max_depth, t.min_split, t.min_leaf, lambda *_: sees[t.tree_id])
        return pa.Table.from_pylist(found, tree.node_schema(pa.int32()))

    sent = chunks.mapInArrow(send, "tree_id int, node_id long, data binary")
    return checkpointed(sent.groupBy("tree_id", "node_id").applyInArrow(finish, tree.NODES))


def by_levels(chunks: DataFrame, columns: int, trees: list[Tree], task_cells: int) -> pa.Table:
    """The nodes as tree.grow has them, rows of every tree sent."""

    def rows_of(own):
        def send(batches):
            for y, codes, values, at in opened(batches):
                x = np.stack([values[f][codes[:, f]] for f in range(columns)], 1)
                for t in own:
                    rows = np.flatnonzero(at < t.until)
                    xs = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * columns, pa.int32()), pa.array(x[rows].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t.tree_id), pa.int32()), xs, pa.array(y[rows].astype(np.int32)), pa.array(np.ones(len(rows), np.int64))], names=["tree_id", "x", "y", "m"])

        return chunks.mapInArrow(send, "tree_id int, x array<double>, y int, m long")

    alike = defaultdict(list)
    for t in trees:
        alike[t[2:]].append(t)
    return pa.concat_tables([tree.grow(rows_of(own), columns, *how, task_cells=task_cells).toArrow().cast(tree.node_schema(pa.int32())) for how, own in alike.items()])


def grow(chunks: DataFrame, columns: int, trees: list[Tree], task_cells: int | None = None, sees: dict[int, list[int]] | None = None) -> pa.Table:
    """The node table of every tree over packed chunks. sees: the features that each tree may use, rising; with it, counts meet by bins, and chunks may have columns beyond."""
    ship(chunks.sparkSession)
    task_cells = tree.TASK_CELLS if task_cells is None else task_cells
    # a task holds one feature's values of all chunks at most
    sizes = chunks.select(F.posexplode("values").alias("feature", "data")).groupBy("feature").agg((F.sum(F.octet_length("data")) / 8).alias("n"))
    if sees is None and (sizes.agg(F.max("n")).first()[0] or 0) > MOST:
        return by_levels(chunks, columns, trees, task_cells)
    bins = None
    days, tops, open_, few = totals(chunks), {}, {}, {t.tree_id: {} for t in trees}

    def place(t: Tree, node: int, n: int, pos: int) -> None:
        tops[t.tree_id][node] = {"tree_id": t.tree_id, "node_id": node, "feature": None, "threshold": None, "is_leaf": True, "prediction": int(2 * pos > n), "proba": pos / n, "n": n, "gain": None}
        if (node + 1).bit_length() - 1 < t.max_depth and n >= t.min_split and 0 < pos < n:
            if n * columns <= task_cells:
                few[t.tree_id][node] = n
            else:
                open_[t.tree_id].append((node, n, pos))

    for t in trees:
        tops[t.tree_id], open_[t.tree_id] = {}, []
        if n := sum(n for at, n, _ in days if at < t.until):
            place(t, 0, n, sum(pos for at, _, pos in days if at < t.until))
    while any(open_.values()):
        asked, open_ = open_, {t.tree_id: [] for t in trees}
        own = [t for t in trees if asked[t.tree_id]]
        groups = {t.tree_id: np.cumsum([n for _, n, _ in asked[t.tree_id]]) // GROUP for t in own}
        level_tops = [topped(t, tops[t.tree_id], {node: k for k, (node, _, _) in enumerate(asked[t.tree_id])}) for t in own]
        by_id = {t.tree_id: t for t in own}
        if sees is not None:
            bins = bins or edged(chunks, columns)
            cuts = level_by_bins(chunks, level_tops, sees, *bins)
        else:
            cuts = level(chunks, columns, level_tops, groups)
        for tree_id, slot, feature, gain, threshold, left, left_pos in cuts:
            node, n, pos = asked[tree_id][slot]
            tops[tree_id][node] |= {"feature": feature, "threshold": threshold, "is_leaf": False, "gain": round(gain, tree.DIGITS)}
            place(by_id[tree_id], 2 * node + 1, left, left_pos)
            place(by_id[tree_id], 2 * node + 2, n - left, pos - left_pos)
        for nodes in open_.values():
            nodes.sort()
    found = pa.Table.from_pylist([r for t in trees for i, r in tops[t.tree_id].items() if i not in few[t.tree_id]], tree.node_schema(pa.int32()))
    if not any(few.values()):
        return found
    # a node's slot is its line, so that its id is known again
    last = [topped(t, tops[t.tree_id], {i: k for k, i in enumerate(sorted(tops[t.tree_id])) if i in few[t.tree_id]}) for t in trees if few[t.tree_id]]
    rest = below(chunks, columns, last, numbers(chunks, columns), sees or {t.tree_id: list(range(columns)) for t in trees}).withColumn("gain", F.round("gain", tree.DIGITS)).toArrow()
    return pa.concat_tables([found, rest.cast(found.schema)])


def answers(chunks: DataFrame, nodes: pa.Table, asked: list[tuple[Tree, float, float]]) -> DataFrame:
    """(tree_id, at, y, p): the share of label 1 in the leaf that each row, of those with low <= at < high, comes to in each asked (tree, low, high)."""
    tables = []
    for t, low, high in asked:
        own = {r["node_id"]: r for r in nodes.filter(pc.equal(nodes["tree_id"], t.tree_id)).to_pylist()}
        if own:
            top = topped(t, own, {})
            tables.append((top, np.array([own[i]["proba"] for i in top.ids.tolist()]), low, high))

    def say(batches):
        for y, codes, values, at in opened(batches):
            for top, proba, low, high in tables:
                rows = np.flatnonzero((at >= low) & (at < high))
                p = proba[places(top, codes, values, rows)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), top.tree.tree_id), pa.int32()), pa.array(at[rows]), pa.array(y[rows].astype(np.int32)), pa.array(p)], names=["tree_id", "at", "y", "p"])

    return chunks.mapInArrow(say, "tree_id int, at double, y int, p double")


def side_by_side(chunks: DataFrame, nodes: pa.Table, trees: list[Tree], low: float, also: list[int]) -> DataFrame:
    """(c0, c1, ..., y, p0, p1, ...) of the rows with at >= low: the columns of also, and the share of label 1 in the leaf that the row comes to in each tree. No rows where there are no nodes."""
    tables = []
    for t in trees:
        own = {r["node_id"]: r for r in nodes.filter(pc.equal(nodes["tree_id"], t.tree_id)).to_pylist()}
        if own:
            top = topped(t, own, {})
            tables.append((top, np.array([own[i]["proba"] for i in top.ids.tolist()])))
    names = [*[f"c{k}" for k in range(len(also))], "y", *[f"p{k}" for k in range(len(trees))]]

    def say(batches):
        for y, codes, values, at in opened(batches):
            rows = np.flatnonzero(at >= low) if len(tables) == len(trees) else []
            if len(rows):
                carried = [pa.array(values[f][codes[rows, f]]) for f in also]
                yield pa.RecordBatch.from_arrays([*carried, pa.array(y[rows].astype(np.int32)), *[pa.array(p[places(top, codes, values, rows)]) for top, p in tables]], names=names)

    return chunks.mapInArrow(say, ", ".join(f"{n} {'int' if n == 'y' else 'double'}" for n in names))
