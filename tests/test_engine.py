"""Properties and small fixtures of the contest engine."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from bracketry.functions import scalars as S
from bracketry.operators import history, matchup, metrics, quality, rating, resolve, splits, tree
from bracketry.plans.adapters import bouts
from bracketry.sources import files

LOG = "ent long, opp long, bout_id long, dt date, cls string, won int, is_finish boolean, secs double, own_q double, opp_q double"


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_scalars(spark):
    df = spark.createDataFrame([("5' 11\"", "66.0\"", "38%", "4:32", "José Áñ-3", "5 Rnd (5-5)"), (None, "--", "38", "x", None, "No Time")], "h string, r string, p string, c string, n string, l string")
    out = df.select(S.height_inches(F.col("h")), S.leading_number(F.col("r")), S.percent(F.col("p")), S.clock_seconds(F.lit(2), F.col("c")), S.fold(F.col("n")), S.scheduled_rounds(F.col("l"))).collect()
    assert tuple(out[0]) == (71.0, 66.0, 0.38, 572, "jose an", 5.0)
    assert tuple(out[1]) == (None, None, None, 0, "", None)
    one = spark.range(1).select(S.shrink(F.lit(0), F.lit(0), F.lit(0.42)), S.shrink(F.lit(2), F.lit(2), F.lit(0.5)), S.division_of(F.lit(150.0)), S.class_lbs(F.lit("UFC Light Heavyweight Title Bout"))).first()
    assert one[0] == pytest.approx(0.42) and one[1] < 0.8 and one[2] == "Featherweight" and one[3] == 205


def small_log(spark, extra=()):
    d = date(2020, 1, 1)
    rows = [(1, 2, 10, d, "a", 1, True, 300.0, 30.0, 10.0), (1, 3, 11, d + timedelta(30), "a", 0, False, 300.0, None, None), (1, 4, 12, d + timedelta(60), "a", 1, False, 300.0, 30.0, 5.0), (1, 5, 13, d + timedelta(60), "a", 1, True, 300.0, 10.0, 5.0), (1, 6, 14, d + timedelta(90), "b", 1, True, 300.0, 1.0, 1.0)]
    return spark.createDataFrame(rows + list(extra), LOG)


def test_as_of_features_use_earlier_days_only(spark):
    got = {r.bout_id: r for r in history.features(small_log(spark)).collect()}
    assert [got[b].n_fights for b in (10, 11, 12, 13, 14)] == [0, 1, 2, 2, 4]
    assert got[10].landed_pm is None and got[10].days_since_last is None and got[10].win_rate == pytest.approx(0.75)
    assert got[12].landed_pm == pytest.approx(6.0) and got[12].total_fight_secs == 600 and got[12].days_since_last == 30
    assert got[14].last3_win_rate == pytest.approx(2 / 3) and got[14].support == "ok"


def test_a_future_bout_changes_no_past_feature(spark):
    names = ["bout_id", "n_fights", "last3_win_rate", "landed_pm", "days_since_last", "total_fight_secs"]
    future = [(1, 7, 15, date(2020, 4, 30), "b", 1, True, 30.0, 999.0, 0.0)]
    before = rows_of(history.features(small_log(spark)), *names)
    after = rows_of(history.features(small_log(spark, future)), *names)
    assert sorted(before) == sorted(r for r in after if r[0] != 15)
    assert [r[1] for r in after if r[0] == 15] == [5]


def test_elo_is_zero_sum_and_chained(spark, sf):
    log = history.event_log(bouts(spark, sf))
    assert log.count() == 2 * log.select("bout_id").distinct().count()
    rows = rating.elo(log).collect()
    ratings, by_bout = {}, {}
    for r in rows:
        by_bout.setdefault(r.seq, []).append(r)
    for seq in sorted(by_bout):
        a, b = by_bout[seq]
        assert (a.elo_post - a.elo_pre) == pytest.approx(-(b.elo_post - b.elo_pre))
        for r in (a, b):
            assert r.elo_pre == ratings.get(r.ent, 1500.0)
            ratings[r.ent] = r.elo_post
    assert {r.ent: r.elo for r in rating.latest(rating.elo(log)).collect()} == ratings


def naive_split(rows, min_leaf):
    def h(ys):
        p = sum(ys) / len(ys) if ys else 0
        return 0.0 if p in (0, 1) or not ys else -p * math.log2(p) - (1 - p) * math.log2(1 - p)

    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for v, nv in zip(values, values[1:], strict=False):
            t = (v + nv) / 2
            t = v if t >= nv else t
            left, right = [y for x, y in rows if x[f] <= t], [y for x, y in rows if x[f] > t]
            if min(len(left), len(right)) < min_leaf:
                continue
            gain = round(h([y for _, y in rows]) - (len(left) * h(left) + len(right) * h(right)) / len(rows), 9)
            if gain > 0 and (best is None or (-gain, f, t) < best):
                best = (-gain, f, t)
    return best


def test_best_split_equals_naive_search(spark):
    rng = random.Random(9)
    problems = [([([float(rng.randint(0, 4)) for _ in range(3)], rng.randint(0, 1)) for _ in range(rng.randint(2, 59))]) for _ in range(40)]
    problems.append([([1e16, 0.0, 0.0], 0), ([1e16 + 2, 0.0, 0.0], 1)])
    flat = [(i, 0, x, y, 1) for i, p in enumerate(problems) for x, y in p]
    got = {r.tree_id: (-r.gain, r.feature, r.threshold) for r in tree.best_split(spark.createDataFrame(flat, "tree_id int, node_id long, x array<double>, y int, m int"), 2).collect()}
    for i, p in enumerate(problems):
        assert got.get(i) == naive_split(p, 2), i


def test_tree_and_forest(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    rows = [(i, x, int(x[0] + 0.5 * x[1] > 0)) for i, x in rows]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, y int")
    drawn = splits.bootstrap(df, 300, 3)
    assert drawn.agg(F.sum("m")).first()[0] == 900
    nodes = tree.grow(tree.bagged(df, drawn), columns=4, max_depth=3, min_leaf=5, rule="sqrt")
    each = tree.predict(df, nodes, 3)
    assert each.count() == 900
    right = each.join(df, "row_id").agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.7
    assert "<=" in tree.print_tree(nodes, list("abcd"))
    assert tree.importances(nodes).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_pure_leaves_have_finite_loss(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.0), (1, 1.0), (0, 0.0)], "y int, p double")
    r = metrics.scores(df).first()
    assert r.log_loss == pytest.approx(-math.log(1e-15) / 2, rel=1e-3) and r.brier == 0.5


def test_splits_keep_dates_whole(spark):
    rows = [(i, date(2020, 1, 1) + timedelta(30 * (i // 10))) for i in range(400)]
    df = spark.createDataFrame(rows + [(999, None)], "row_id long, dt date")
    cut = splits.chronological(df)
    assert {r.is_test for r in cut.where("dt IS NULL").collect()} == {False}
    assert cut.groupBy("dt").agg(F.count_distinct("is_test").alias("n")).where("n > 1").count() == 0
    folds = splits.walk_forward(df, folds=5)
    both = folds.groupBy("fold", "dt").agg(F.count_distinct("role").alias("n"))
    assert both.where("n > 1").count() == 0 and folds.select("fold").distinct().count() == 5
    assert folds.where("role = 'test'").agg(F.max("dt")).first()[0] == max(d for _, d in rows)


def test_resolution(spark):
    bios = spark.createDataFrame([(1, "a", 150.0), (2, "a", 170.0), (3, "b", None), (4, "c", None), (5, "c", None)], "id long, name string, weight double")
    names = spark.createDataFrame([(1, "a", 168.0), (2, "b", 1.0), (3, "c", 1.0), (4, "d", 1.0), (5, "a", 160.0)], "key long, name string, limit double")
    got = {r.key: (r.id, r.note) for r in resolve.resolve(names, bios).collect()}
    assert got == {1: (2, "nearest weight"), 2: (3, "unique"), 3: (None, "ambiguous"), 4: (None, "unknown name"), 5: (1, "nearest weight")}


def test_unknown_stance_raises_and_append_is_checked(spark, sf, tmp_path):
    b = bouts(spark, sf)
    old, new = b.where("dt < DATE '1998-01-01'"), b.where("dt >= DATE '1998-01-01'")
    assert quality.append(new, old, str(tmp_path / "x")) == [] and not (tmp_path / "x").exists()
    assert quality.append(new, old, str(tmp_path / "x"), dry_run=False) == []
    assert spark.read.parquet(str(tmp_path / "x")).count() == b.count()
    assert any("already present" in x for x in quality.append(old, old, str(tmp_path / "y"), dry_run=False)) and not (tmp_path / "y").exists()
    bad = spark.createDataFrame([(1, "Sideways", 1)], "bout_id long, stance_matchup string, label int")
    with pytest.raises(Exception, match="unknown stance"):
        matchup.matrix(bad, ()).collect()


def test_html_tables_and_csv(spark, tmp_path):
    page = '<table class="wikitable"><tr><th>#</th><th>Event</th><th>Date</th></tr><tr><td>1</td><td><a>UFC 9: A &amp; B</a></td><td>Mar 5, 2024</td></tr><tr><td>2</td><td>Old</td><td>Mar 5, 2020</td></tr></table>'
    cells = files.table_cells(spark.createDataFrame([(1, page)], "k int, html string"), "k", "html")
    assert rows_of(files.new_events(cells, "2023-01-01"), "name", "dt") == [("UFC 9: A & B", date(2024, 3, 5))]
    (tmp_path / "f.csv").write_text("# note\nFighter_Name,Height,Reach,Weight,DOB,Str_Acc\nA,5' 11\",NA,155 lbs.,\"Jan 2, 1990\",38%\n")
    r = files.read_entities(spark, str(tmp_path / "f.csv")).first()
    assert (r.Height_in, r.Reach_in, r.Weight_lbs, r.DOB, r.Str_Acc) == (71.0, None, 155.0, date(1990, 1, 2), 0.38)


def test_cells_with_references_stay(spark, tmp_path):
    from bracketry.catalogue import QUERIES

    html = "<ul><li>A &amp; B</li><li>plain</li><li>&lt;<b>x</b>&gt; &amp;lt;</li></ul>"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    cells = QUERIES["html_cells"](spark, str(tmp_path)).orderBy("cell_no").collect()
    assert [(r.cell_no, r.cell) for r in cells] == [(0, "A & B"), (1, "plain"), (2, "<x> &lt;")]


def test_rows_are_numbered_in_order_across_ranges(spark):
    keys = [-5, 0, 3, 9, 10, 11, 40, 41, 1000]
    rows = splits.numbered(spark.createDataFrame([(k,) for k in reversed(keys)], "k long"), "k", 10).collect()
    assert sorted((r.row_id, r.k) for r in rows) == list(enumerate(keys))


def test_trees_cut_at_a_depth_match_trees_grown_to_it(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame([(i, x, int(sum(x) > rng.gauss(0, 1))) for i, x in rows], "row_id long, x array<double>, y int")
    one = df.withColumn("tree_id", F.lit(0)).withColumn("m", F.lit(1))
    deep = tree.grow(one, columns=3, max_depth=5, min_split=4, min_leaf=2)
    cut = tree.at_depths(tree.landed(df, deep, 5), deep, (2, 5, 9)).collect()
    for depth in (2, 5):
        want = {r.row_id: r.proba for r in tree.predict(df, tree.grow(one, columns=3, max_depth=depth, min_split=4, min_leaf=2), depth).collect()}
        assert {r.row_id: r.proba for r in cut if r.depth == depth} == want
    assert sorted(r.row_id for r in cut if r.depth == 9) == list(range(200))


def test_sweeps_and_folds_are_whole(spark, sf):
    from bracketry.catalogue import QUERIES

    assert {r.depth for r in QUERIES["depth_sweep"](spark, sf).collect()} == {1, 2, 3, 4, 5, 6, 8, 10, 15, 20}
    folds = QUERIES["run_walk_forward"](spark, sf).collect()
    assert {(r.model, r.tree_id) for r in folds} == {(m, k) for m in ("fixed depth", "matched") for k in range(8)}


def test_control_on_shuffled_labels_has_five_seeds(spark, sf):
    from bracketry.catalogue import QUERIES

    rows = QUERIES["shuffled_label_control"](spark, sf).collect()
    assert sorted(r.seed for r in rows) == [1, 2, 3, 4, 5]
    for r in rows:
        assert r.low <= r.accuracy <= r.high and r.clear == (r.base_rate >= r.low - 1e-9)
        assert r.passed == (sum(x.clear for x in rows) >= 4)


def test_events_of_two_pages_stay_apart(spark):
    page = lambda name, day: f'<table class="wikitable"><tr><td>1</td><td>{name}</td><td>{day}</td></tr></table>'
    pages = spark.createDataFrame([(1, page("UFC A", "Mar 5, 2024")), (2, page("UFC B", "Apr 5, 2024")), (None, page("UFC C", "May 5, 2024"))], "k int, html string")
    assert rows_of(files.new_events(files.table_cells(pages, "k", "html"), "2023-01-01"), "dt", "name") == [(date(2024, 3, 5), "UFC A"), (date(2024, 4, 5), "UFC B"), (date(2024, 5, 5), "UFC C")]


def test_the_doctors_stoppage_is_a_finish(spark):
    b = spark.createDataFrame([(1, date(2020, 1, 1), "x", 1, 2, 1, m, 300.0) for m in ("KO/TKO", "Submission", "TKO - Doctor's Stoppage", "Decision - Unanimous", None)], "bout_id long, dt date, cls string, e1 long, e2 long, winner long, method string, secs double")
    assert [r.is_finish for r in history.event_log(b).where("ent = 1").collect()] == [True, True, True, False, False]


def test_names_are_folded_once_and_looked_up(spark):
    names = spark.createDataFrame([("José",), ("jose",), (None,), ("Zoë",)] * 3, "name string")
    bios = spark.createDataFrame([(1, "JOSE", 70.0), (2, "Ann", 60.0), (3, "Ann", 80.0)], "id long, name string, weight double")
    assert {r.name for r in resolve.unknown(names, bios).collect()} == {None, "Zoë"}
    assert sorted(rows_of(resolve.candidates(spark.createDataFrame([("Ann",), ("Bo",)], "name string"), bios), "name", "id")) == [("Ann", 2), ("Ann", 3)]
    assert rows_of(resolve.lookup(spark.createDataFrame([(2,)], "id long"), bios), "name") == [("Ann",)]
    with pytest.raises(Exception, match="unknown id: 9"):
        resolve.lookup(spark.createDataFrame([(9,)], "id long"), bios).collect()


def test_files_joined_by_name_and_checked_columns(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Fight_URL,Fighter_1,Fighter_2,Event_Date\nx,A,B,\"Mar 5, 2024\"\n")
    (tmp_path / "e.csv").write_text("Fighter_URL,Fighter_Name,Height,Reach,Weight,DOB\nu,A,5' 11\",70,155 lbs.,\nv,A,5' 10\",71,145 lbs.,\n")
    joined = files.load_joined(spark, str(tmp_path / "b.csv"), str(tmp_path / "e.csv"))
    assert sorted(rows_of(joined, "F1_bio_Fighter_URL", "F2_bio_Fighter_URL")) == [("u", None), ("v", None)]
    assert files.check_columns(joined.select("Fight_URL"), ["Fight_URL"]).columns == ["Fight_URL"]
    with pytest.raises(ValueError, match="missing columns"):
        files.check_columns(joined.select("Fight_URL"), ["Fight_URL", "other"])


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from types import SimpleNamespace

    from bracketry import session

    bare = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k: None), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))), master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.work_dir(SimpleNamespace(sparkContext=bare, conf=SimpleNamespace(get=lambda k, d: None)))
    before = spark.conf.get(session.CLEAN_UP, None)
    session.checkpointed(spark.range(3))
    assert spark.conf.get(session.CLEAN_UP, None) == before
