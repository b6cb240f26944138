"""The learning queries against plain Python on the smallest tables."""

import difflib
import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bracketry.catalogue import QUERIES
from bracketry.operators import history, matchup, metrics, rating, resolve, splits, tree
from bracketry.plans import queries_model as qm
from bracketry.plans import queries_time as qt
from bracketry.plans.adapters import bouts, entities


def draw(seed, *keys):
    return int(hashlib.md5(":".join([str(seed), *map(str, keys)]).encode()).hexdigest()[:8], 16)


def scrambled(x):
    for _ in range(2):
        x = (x ^ x >> 16) * 73244475 & 0xFFFFFFFF
    return x ^ x >> 16


def place_draw(seed, b, place):
    return scrambled(scrambled(b * 2654435761 + seed & 0xFFFFFFFF) ^ place & 0xFFFFFFFF)


def plain_entropy(p):
    return np.where((p <= 0) | (p >= 1), 0.0, -p * np.log2(np.clip(p, 1e-300, 1)) - (1 - p) * np.log2(np.clip(1 - p, 1e-300, 1)))


def plain_split(x, y, m, features, min_leaf):
    """The best (feature, threshold), if any cut gains."""
    best, n, pos = None, m.sum(), (m * y).sum()
    for f in features:
        values, place = np.unique(x[:, f], return_inverse=True)
        left, left_pos = np.cumsum(np.bincount(place, m))[:-1], np.cumsum(np.bincount(place, m * y))[:-1]
        ok = (left >= min_leaf) & (n - left >= min_leaf)
        if not ok.any():
            continue
        left, left_pos = left[ok], left_pos[ok]
        gain = plain_entropy(pos / n) - (left * plain_entropy(left_pos / left) + (n - left) * plain_entropy((pos - left_pos) / (n - left))) / n
        gain = np.round(gain, 12)
        k = int(np.argmax(gain))
        middle = (values[:-1] + values[1:])[ok][k] / 2
        middle = values[:-1][ok][k] if middle >= values[1:][ok][k] else middle
        if gain[k] > 0 and (best is None or gain[k] > best[0]):
            best = (gain[k], f, float(middle))
    return best and best[1:]


def plain_tree(x, y, m, depth, min_split, min_leaf, features):
    """{node: (feature, threshold, n, positives)}; features: node -> the features it may use."""
    out, todo = {}, [(0, np.arange(len(y)), 0)]
    while todo:
        node, rows, level = todo.pop()
        n, pos = int(m[rows].sum()), int((m * y)[rows].sum())
        cut = None
        if level < depth and n >= min_split and 0 < pos < n:
            cut = plain_split(x[rows], y[rows], m[rows], features(node), min_leaf)
        out[node] = (*(cut or (None, None)), n, pos)
        if cut:
            right = x[rows, cut[0]] > cut[1]
            todo += [(2 * node + 1, rows[~right], level + 1), (2 * node + 2, rows[right], level + 1)]
    return out


def plain_leaf(nodes, x, depth=99):
    node, level = 0, 0
    while nodes[node][0] is not None and level < depth:
        node, level = 2 * node + 1 + int(x[nodes[node][0]] > nodes[node][1]), level + 1
    return nodes[node][2:]


def plain_subset(k, columns):
    return lambda t: lambda node: sorted(sorted(range(columns), key=lambda f: (draw(3, t, node, f), f))[:k])


def plain_forest(x, y, trees, drawn, depth, k):
    out = []
    for t in range(trees):
        m = np.bincount(drawn(t), minlength=len(y)).astype(float)
        live = m > 0
        out.append(plain_tree(x[live], y[live], m[live], depth, 10, 5, plain_subset(k, x.shape[1])(t)))
    return out


def hard(leaves):
    return int(2 * sum(2 * pos > n for n, pos in leaves) > len(leaves))


@pytest.fixture(scope="module")
def learn(sf):
    docs = {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "source", "n_chars"]).to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["doc_id"] in docs}
    keys = sorted(labels)
    x = np.array([[docs[k]["n_chars"], len(docs[k]["source"]) + k % 7] for k in keys], float)
    return keys, x, np.array([labels[k] for k in keys])


@pytest.fixture(scope="module")
def forest(learn):
    _, x, y = learn
    return plain_forest(x, y, qm.TREES, lambda t: [place_draw(7, t, i) % len(y) for i in range(len(y))], qm.DEPTH, 1)


def test_forest_fit(spark, sf, forest):
    got = {}
    for r in QUERIES["forest_fit"](spark, sf).collect():
        got.setdefault(r.tree_id, {})[r.node_id] = r
    assert sorted(got) == list(range(qm.TREES))
    for t, nodes in enumerate(forest):
        assert {i: (r.feature, r.threshold, r.n) for i, r in got[t].items()} == {i: v[:3] for i, v in nodes.items()}
        assert all(r.proba == pytest.approx(nodes[i][3] / nodes[i][2]) and r.prediction == int(2 * nodes[i][3] > nodes[i][2]) for i, r in got[t].items())


def test_forest_predict_and_sweep(spark, sf, learn, forest):
    _, x, y = learn
    leaves = [[plain_leaf(nodes, row) for nodes in forest] for row in x]
    rows = {r.row_id: r for r in QUERIES["forest_predict"](spark, sf).collect()}
    assert sorted(rows) == list(range(len(y)))
    for i, own in enumerate(leaves):
        assert rows[i].vote == hard(own) and rows[i].p == pytest.approx(sum(pos / n for n, pos in own) / len(own))
    sweep = {r.k: r.accuracy for r in QUERIES["trees_sweep"](spark, sf).collect()}
    assert sweep == {k: pytest.approx(np.mean([hard(own[:k]) == y[i] for i, own in enumerate(leaves)])) for k in qm.TREE_COUNTS}


def test_oob_score(spark, sf, learn, forest):
    _, x, y = learn
    drawn = [{place_draw(7, t, i) % len(y) for i in range(len(y))} for t in range(qm.TREES)]
    votes = [[plain_leaf(nodes, row) for nodes, seen in zip(forest, drawn, strict=True) if i not in seen] for i, row in enumerate(x)]
    right = [hard(v) == y[i] for i, v in enumerate(votes) if v]
    r = QUERIES["oob_score"](spark, sf).first()
    assert (r.n, r.oob) == (len(right), pytest.approx(np.mean(right)))


def test_depth_sweep(spark, sf, learn):
    import zlib

    keys, x, y = learn
    valid = np.array([zlib.crc32(str(k).encode()) % 5 == 0 for k in keys])
    nodes = plain_tree(x[~valid], y[~valid], np.ones((~valid).sum()), 20, 50, 25, lambda node: range(2))
    want = {d: np.mean([int(2 * pos > n) == t for t, (n, pos) in ((t, plain_leaf(nodes, row, d)) for row, t in zip(x[valid], y[valid], strict=True))]) for d in qm.DEPTHS}
    rows = {r.depth: r for r in QUERIES["depth_sweep"](spark, sf).collect()}
    assert {d: r.accuracy for d, r in rows.items()} == {d: pytest.approx(v) for d, v in want.items()}
    assert [d for d, r in rows.items() if r.chosen] == [min(d for d, v in want.items() if v == max(want.values()))]


def test_shuffled_label_control(spark, sf, learn):
    _, x, y = learn
    n = len(y)
    cut = int(n * 0.82)
    got = {r.seed: r for r in QUERIES["shuffled_label_control"](spark, sf).collect()}
    clear = []
    for s, seed in enumerate(qm.SEEDS):
        order = sorted(range(n), key=lambda i: (draw("a", seed, i), i))
        dealt = np.empty(n, int)
        dealt[order] = y
        trees = []
        for t in range(s * qm.CONTROL_TREES, (s + 1) * qm.CONTROL_TREES):
            m = np.bincount([place_draw(7, t, i) % cut for i in range(cut)], minlength=cut).astype(float)
            live = m > 0
            trees.append(plain_tree(x[:cut][live], dealt[:cut][live], m[live], qm.DEPTH, 10, 5, plain_subset(1, 2)(t)))
        p = np.array([np.mean([pos / k for k, pos in (plain_leaf(nodes, row) for nodes in trees)]) for row in x[cut:]])
        right = (p > 0.5) == dealt[cut:]
        boot = [right[[place_draw(9, b, i) % (n - cut) for i in range(n - cut)]].mean() for b in range(qm.CONTROL_DRAWS)]
        low, high = np.percentile(boot, [2.5, 97.5])
        base = max(dealt[cut:].mean(), 1 - dealt[cut:].mean())
        r = got[seed]
        assert (r.accuracy, r.base_rate, r.low, r.high) == tuple(map(pytest.approx, (right.mean(), base, low, high)))
        clear.append(base >= low - 1e-9)
        assert r.clear == clear[-1]
    assert {r.passed for r in got.values()} == {sum(clear) >= 4}


def plain_loss(y, p):
    q = np.clip(p, 1e-15, 1 - 1e-15)
    return -np.where(y == 1, np.log(q), np.log(1 - q))


SCORES = {"accuracy": lambda y, p: ((p > 0.5) == (y == 1)).astype(float), "log_loss": plain_loss, "brier": lambda y, p: (p - y) ** 2}


def plain_rows(df):
    rows = sorted(df.collect(), key=lambda r: r.bout_id)
    return [r.dt for r in rows], np.array([list(r.x) for r in rows]), np.array([r.y for r in rows])


def test_run_walk_forward(spark, sf):
    features = qt.feature_table(spark, sf)
    x = matchup.matrix(features, tuple(matchup.feature_names(context=True, weight=True))).join(features.select("bout_id", "dt"), "bout_id")
    days, x, y = plain_rows(x)
    dates = sorted(set(days))
    start = math.ceil(0.5 * len(dates))
    at = sorted({int(start + (len(dates) - 1 - start) * k / 8) for k in range(9)})
    got = {(r.model, r.tree_id): r for r in QUERIES["run_walk_forward"](spark, sf).collect()}
    assert len(got) == 2 * (len(at) - 1)
    for fold, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        train = np.array([d < dates[a] for d in days])
        test = np.array([d >= dates[a] and (fold == len(at) - 2 or d < dates[b]) for d in days])
        for model, depth, min_split, min_leaf in qm.FOLD_TREES:
            nodes = plain_tree(x[train], y[train], np.ones(train.sum()), depth, min_split, min_leaf, lambda node: range(x.shape[1]))
            p = np.array([pos / n for n, pos in (plain_leaf(nodes, row) for row in x[test])])
            r = got[model, fold]
            assert r.n == test.sum()
            for name, f in SCORES.items():
                assert r[name] == pytest.approx(f(y[test], p).mean(), rel=1e-9), (model, fold, name)


def test_ablation(spark, sf):
    log = history.event_log(bouts(spark, sf))
    rows = matchup.training_rows(qt.feature_table(spark, sf), history.features(log, rating.elo(log).select("bout_id", "ent", "elo_pre")))
    names = matchup.feature_names(rolling=True, context=True, weight=True)
    days, x, y = plain_rows(matchup.matrix(rows, tuple(names)).join(rows.select("bout_id", "dt"), "bout_id"))
    place = min(max(round(len(days) * 0.82), 1), len(days) - 1)
    test = np.array([d >= sorted(days)[place] for d in days])
    _, depth, min_split, min_leaf = qm.FOLD_TREES[0]
    p = {}
    for name, own in qm.VARIANTS:
        nodes = plain_tree(x[~test], y[~test], np.ones((~test).sum()), depth, min_split, min_leaf, lambda node, own=own: sorted(names.index(n) for n in own))
        p[name] = np.array([pos / n for n, pos in (plain_leaf(nodes, row) for row in x[test])])
    n = int(test.sum())
    draws = [np.array([place_draw(7, b, i) % n for i in range(n)]) for b in range(qm.REPLICATES)]
    got = {(r.model, r.metric): r for r in QUERIES["ablation"](spark, sf).collect()}
    assert len(got) == 18 and [len(own) for _, own in qm.VARIANTS] == [8, 21, 22, 25, 26, 18]
    for (model, metric), r in got.items():
        f = SCORES[metric]
        value = f(y[test], p[model])
        assert r.score == pytest.approx(value.mean(), rel=1e-9)
        if model == qm.VARIANTS[0][0]:
            assert r.delta is None and r.verdict is None
            continue
        delta = value - f(y[test], p[qm.VARIANTS[0][0]])
        low, high = np.percentile([delta[d].mean() for d in draws], [2.5, 97.5])
        assert (r.delta, r.low, r.high) == tuple(pytest.approx(v, abs=1e-9) for v in (delta.mean(), low, high))
        want = "inside noise" if low <= 0 <= high else "REAL improvement" if (delta.mean() < 0) == (metric != "accuracy") else "REAL regression"
        assert r.verdict == want


def test_external_agreement_counts_in_bits(spark, sf, learn):
    r = QUERIES["external_agreement"](spark, sf).first()
    assert 0 <= r.agreement <= 1 and r.quotient == pytest.approx(1.0)
    assert r.root_entropy == pytest.approx(float(plain_entropy(np.array(learn[2].mean()))))


def plain_suggestions(query, names, limit=6):
    words = query.strip().lower().split()
    if not words:
        return []
    contained = [n for n in names if all(w in n.lower() for w in words)]
    return list(dict.fromkeys([*contained, *difflib.get_close_matches(query, names, n=limit, cutoff=0.6)]))[:limit]


def test_suggestions(spark, sf):
    names = {}
    for r in pq.read_table(f"{sf}/part.parquet", columns=["p_partkey", "p_name"]).to_pylist():
        names[r["p_name"]] = min(r["p_partkey"], names.get(r["p_name"], 1 << 60))
    ordered = sorted(names, key=names.get)
    got = {}
    for r in sorted(QUERIES["suggest_spellings"](spark, sf).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query, []).append(r.name)
    assert got == {q: plain_suggestions(q, ordered) for q in ("smal rng", "red widgit")}
    rng = np.random.default_rng(1)
    queries = ["".join(rng.choice(list(n), len(n))) if i % 3 else n[: 1 + i % len(n)] for i, n in enumerate(ordered * 2)] + ["", " ", "red"]
    found = {}
    for r in sorted(resolve.suggest(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(n, k) for k, n in enumerate(ordered)], "name string, ord int")).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query, []).append(r.name)
    assert found == {q: w for q in set(queries) if (w := plain_suggestions(q, ordered))}


def test_matchup_rows_of_past_bouts_equal_the_training_rows(spark, sf):
    features, bios, log = qt.feature_table(spark, sf), entities(spark, sf), history.event_log(bouts(spark, sf))
    exact = rating.elo(log).select("bout_id", "ent", "elo_pre")
    train = matchup.training_rows(features, history.features(log, exact))
    asked = features.select(F.col("bout_id").alias("key"), "a", "b", "cls", "dt", F.col("scheduled_rounds").alias("rounds"))
    served = matchup.matchup_rows(asked, bios, log, exact.withColumnRenamed("bout_id", "key"))
    names = ["stance_matchup", "support_a", "support_b", *[n for n in matchup.feature_names(True, True, True) if n not in ("stance_same", "stance_unknown", "scheduled_rounds_missing")]]
    want = {r.bout_id: tuple(r[n] for n in names) for r in train.collect()}
    got = {r.key: tuple(r[n] for n in names) for r in served.collect()}
    assert len(want) > 1000 and got == want


def test_swapped_sides_negate_and_unknown_sides_are_debutants(spark, sf):
    bios, log = entities(spark, sf), history.event_log(bouts(spark, sf))
    asked = spark.createDataFrame([(1, 5, 9, "UFC Lightweight Title Bout"), (2, 9, 5, "UFC Lightweight Title Bout"), (3, 5, -7, "Openweight Bout"), (4, 5, 5, None)], "key int, a long, b long, cls string").withColumn("dt", F.lit("1997-03-03").cast("date"))
    rows = {r.key: r for r in matchup.matchup_rows(asked, bios, log).collect()}
    for n in matchup.DIFFS + tuple(x.removesuffix("_diff") for x in matchup.ROLLING):
        assert rows[1][f"{n}_diff"] == pytest.approx(-rows[2][f"{n}_diff"]) and rows[1][f"{n}_diff_missing"] == rows[2][f"{n}_diff_missing"]
        assert rows[4][f"{n}_diff"] == 0
    assert rows[1].scheduled_rounds == 5 and rows[3].scheduled_rounds == 3 and rows[3].is_nonstandard_weight and not rows[3].scheduled_rounds_missing
    assert rows[3].support_b == "none" and rows[3].weight_diff_missing and rows[3].landed_pm_diff_missing and rows[3].days_since_last_diff_missing
    assert matchup.matchup_rows(asked, bios).columns[-1] == "scheduled_rounds_missing"
    empty = matchup.matchup_rows(asked, bios, log.limit(0)).collect()
    assert len(empty) == 4 and all(r.win_rate_diff == 0 and r.support_a == "none" for r in empty)


def test_a_missing_feature_raises(spark):
    df = spark.createDataFrame([(1, "Same", 1)], "bout_id long, stance_matchup string, label int")
    with pytest.raises(ValueError, match="no such feature: reach_diff"):
        matchup.matrix(df, ("stance_same", "reach_diff"))
    assert list(matchup.matrix(df, ("stance_same", "stance_unknown")).first().x) == [1.0, 0.0]


def test_the_tree_as_an_object(spark, learn):
    keys, x, y = learn
    df = spark.createDataFrame([(k, row.tolist(), int(t)) for k, row, t in zip(keys, x, y, strict=True)], "row_id long, x array<double>, y int")
    one = tree.DecisionTree(max_depth=3, min_samples_split=10, min_samples_leaf=4)
    with pytest.raises(ValueError, match="fitted"):
        one.predict(df)
    nodes = plain_tree(x, y, np.ones(len(y)), 3, 10, 4, lambda node: range(2))
    one.fit(df)
    leaves = [plain_leaf(nodes, row) for row in x]
    assert {r.row_id: r.proba for r in one.predict_proba(df).collect()} == {k: pytest.approx(pos / n) for k, (n, pos) in zip(keys, leaves, strict=True)}
    assert one.score(df) == pytest.approx(np.mean([int(2 * pos > n) == t for (n, pos), t in zip(leaves, y, strict=True)]))
    inner = sum(v[0] is not None for v in nodes.values())
    assert (one.n_internal, one.n_leaves, one.depth) == (inner, len(nodes) - inner, max(int(math.log2(i + 1)) for i in nodes))
    with pytest.raises(Exception, match="label is not 0 or 1"):
        tree.DecisionTree().fit(df.withColumn("y", F.lit(2)))


def test_root_ties_are_of_unrounded_gains(spark):
    rows = [([float(i % 2), float(i % 2), float(i % 3 == 0)], i % 2) for i in range(12)]
    rows += [([float(i % 2), float(i % 2), 0.0], 1 - i % 2) for i in range(3)]
    df = spark.createDataFrame([(0, 0, x, y, 1) for x, y in rows], "tree_id int, node_id long, x array<double>, y int, m int")
    got = {r.feature: (r.threshold, r.tied) for r in tree.root_ties(df).collect()}
    assert got == {0: (0.5, True), 1: (0.5, True), 2: (0.5, False)}
    # gains that differ by less than nine digits show, but not a tie
    near = spark.createDataFrame([(0, 0, 0.1 + 4e-10, 1.0), (0, 1, 0.1, 2.0)], "n int, feature int, gain double, threshold double")
    assert near.agg(F.min(F.struct((-F.round("gain", tree.RANKED)).alias("l"), "feature")).alias("b")).first().b.feature == 0
    assert near.withColumn("gain", F.col("gain") - F.when(F.col("feature") == 0, 8e-10).otherwise(0.0)).agg(F.min(F.struct((-F.round("gain", tree.RANKED)).alias("l"), "feature")).alias("b")).first().b.feature == 1


def test_statistics_join_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "bout_id long, v string")
    right = spark.createDataFrame([(1, 5.0)], "bout_id long, q double")
    assert sorted(map(tuple, history.with_stats(left, right).collect())) == [(1, "a", 5.0), (2, "b", None)]
    for a, b, side in ((left.union(left), right, "bouts"), (left, right.union(right), "statistics")):
        with pytest.raises(Exception, match=f"duplicate key in the {side}"):
            history.with_stats(a, b).collect()


def test_missing_statistics_degrade(spark, sf):
    bare = bouts(spark, sf).drop("td1", "sub2")
    assert history.available_stats(bare) == (["q", "ctrl"], ["td", "sub"])
    rows = history.features(history.event_log(bare)).where("n_fights > 3").limit(50).collect()
    assert all(r.td_landed_p15m is None and r.sub_att_p15m is None for r in rows) and any(r.ctrl_frac is not None for r in rows)


def test_asked_days_see_what_the_log_sees(spark, sf):
    log = history.event_log(bouts(spark, sf))
    names = ["n_fights", "win_rate", "last3_win_rate", "landed_pm", "days_since_last", "total_fight_secs"]
    some = log.select("bout_id", "ent", "dt", "cls")
    want = sorted(tuple(r[n] for n in ("bout_id", "ent", *names)) for r in history.features(log).collect())
    got = sorted(tuple(r[n] for n in ("bout_id", "ent", *names)) for r in history.features_at(log, some).collect())
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
    # a day that is asked for changes nothing for the days after it
    more = some.unionByName(some.withColumn("dt", F.date_sub("dt", 1)).withColumn("bout_id", -F.col("bout_id")))
    kept = history.features_at(log, more).where("bout_id >= 0")
    assert {tuple(map(str, (r[n] for n in ("bout_id", "ent", *names)))) for r in kept.where("bout_id > 0").collect()} == {tuple(map(str, r)) for r in want if r[0] > 0}


def test_ratings_before_asked_days(spark, sf):
    log = history.event_log(bouts(spark, sf))
    ratings = rating.elo(log)
    asked = spark.createDataFrame([(e, d) for e in range(1, 30) for d in ("1995-01-01", "1996-07-01", "1999-01-01")], "ent long, d string").select("ent", F.col("d").cast("date").alias("dt"))
    got = {(r.ent, str(r.dt)): r.elo_pre for r in rating.as_of_days(ratings, asked).collect()}
    assert len(got) == 87
    for day in ("1995-01-01", "1996-07-01", "1999-01-01"):
        want = {r.ent: r.elo for r in rating.as_of(ratings, day).collect()}
        assert all(got[e, day] == want.get(e) for e in range(1, 30))


def test_paired_differences_of_one_model_with_itself(spark):
    rows = spark.createDataFrame([(i, i % 2, 0.3 + 0.4 * (i % 3 == 0), 0.3 + 0.4 * (i % 3 == 0)) for i in range(40)], "row_id long, y int, `one model` double, other double")
    got = metrics.paired_differences(rows, splits.drawn(rows, 40, 20), ["one model", "other"]).collect()
    assert all(r.delta == 0 and r.low == 0 and r.high == 0 and r.verdict == "inside noise" for r in got if r.model == "other")


def test_rows_are_numbered_anew_for_each_group(spark):
    rows = [(g, k, t) for g in (1, 2) for k, t in ((5, 0), (5, 1), (0, 0), (99, 0), (12, 3))]
    got = {(r.g, r.k, r.t): r.row_id for r in splits.numbered(spark.createDataFrame(rows, "g int, k long, t int"), "k", 10, ("g",), ("t",)).collect()}
    for g in (1, 2):
        assert [got[g, k, t] for k, t in sorted((k, t) for h, k, t in rows if h == g)] == [0, 1, 2, 3, 4]


def test_draws_are_spread_evenly(spark):
    rows = spark.range(2000).withColumnRenamed("id", "row_id")
    got = splits.drawn(rows, 2000, 50).collect()
    assert sorted(r.row_id for r in got if r.b == 3) == sorted(place_draw(7, 3, i) % 2000 for i in range(2000))
    counts = np.bincount([r.row_id for r in got], minlength=2000)
    # 100,000 draws over 2,000 rows: 50 each, with the spread of a Poisson number
    assert counts.sum() == 100_000 and abs(counts.var() / 50 - 1) < 0.15
    by_replicate = [len({r.row_id for r in got if r.b == b}) / 2000 for b in range(50)]
    assert abs(np.mean(by_replicate) - (1 - math.exp(-1))) < 0.005


@pytest.mark.parametrize("kind", ["all", "rule", "allowed"])
def test_levels_and_single_tasks_grow_the_same_trees(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(t, [float(rng.integers(30)), float(rng.random()), float(rng.choice([1.0, math.nan, 2.0]))], int(rng.random() < 0.4), int(rng.integers(1, 4))) for t in range(2) for _ in range(90)]
    df = spark.createDataFrame(rows, "tree_id int, x array<double>, y int, m int")
    own = {"all": {}, "rule": {"rule": "sqrt"}, "allowed": {"allowed": (F.col("feature") + F.col("tree_id")) % 3 != 0}}[kind]
    # levels alone, the root by levels and the rest by tasks, tasks alone
    found = [sorted(map(str, tree.grow(df, 3, 3, 6, 3, task_cells=cells, **own).collect())) for cells in ((0, 200, 10**6) if kind == "all" else (200, 10**6))]
    assert len(found[0]) > 8 and all(f == found[0] for f in found)


def test_a_tree_without_rows_or_features(spark):
    empty = spark.createDataFrame([], "tree_id int, x array<double>, y int, m int")
    assert tree.grow(empty, 3, 4).collect() == []
    bare = spark.createDataFrame([(0, [], 0, 1), (0, [], 1, 2)], "tree_id int, x array<double>, y int, m int")
    assert [(r.is_leaf, r.prediction, r.n) for r in tree.grow(bare, 0, 4).collect()] == [(True, 1, 3)]
