"""The catalogue's splits, metrics, resampling and learning queries."""

from __future__ import annotations

import functools
import math
from contextlib import ExitStack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from bracketry.functions import scalars as S
from bracketry.operators import forest as forests
from bracketry.operators import histogram, history, matchup, metrics, quality, rating, resample, splits, tree
from bracketry.plans.adapters import bouts, cte, entities
from bracketry.plans.queries import FEATURES, feature_table, query, rnd
from bracketry.session import checkpointed, stored, table

BOUT = cte("bout")


def boundary_sql(source: str, name: str, share: float) -> str:
    n = f"(SELECT count(*) FROM {source})"
    return f"{name} AS (SELECT dt AS boundary FROM (SELECT dt, row_number() OVER (ORDER BY dt) AS rn FROM {source}) WHERE rn = least(greatest(round_even({n} * (1 - {share}), 0), 1), {n} - 1) + 1)"


@query("chrono_split", BOUT + ", " + boundary_sql("bout", "b1", 0.18) + " SELECT bout_id, dt >= (SELECT boundary FROM b1) AS is_test FROM bout")
def chrono_split(spark, sf_dir):
    return splits.chronological(bouts(spark, sf_dir)).select("bout_id", "is_test")


@query("nested_split", BOUT + ", " + boundary_sql("bout", "b1", 0.18) + ", tr AS (SELECT * FROM bout WHERE dt < (SELECT boundary FROM b1)), " + boundary_sql("tr", "b2", 0.2) + " SELECT bout_id, dt >= (SELECT boundary FROM b2) AS is_valid FROM tr")
def nested_split(spark, sf_dir):
    train = splits.chronological(bouts(spark, sf_dir)).where("NOT is_test").drop("is_test", "boundary")
    return splits.chronological(train, 0.2).select("bout_id", F.col("is_test").alias("is_valid"))


@query("walk_forward", BOUT + """, d AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS u FROM (SELECT DISTINCT dt FROM bout)),
u AS (SELECT any_value(u) AS u, ceil(0.5 * any_value(u)) AS s FROM d), c AS (SELECT DISTINCT trunc(s + (u - 1 - s) * k / 8.0)::BIGINT AS i FROM u, range(0, 9) t(k)),
f AS (SELECT row_number() OVER (ORDER BY i) - 1 AS fold, i, lead(i) OVER (ORDER BY i) AS j, count(*) OVER () AS n FROM c),
w AS (SELECT fold, a.dt AS start, CASE WHEN fold < n - 2 THEN b.dt END AS stop FROM f JOIN d a ON a.i = f.i LEFT JOIN d b ON b.i = f.j WHERE f.j IS NOT NULL)
SELECT fold::INTEGER AS fold, CASE WHEN dt < start THEN 'train' ELSE 'test' END AS role, count(*)::BIGINT AS n, min(dt) AS first, max(dt) AS last FROM w JOIN bout ON dt < start OR stop IS NULL OR dt < stop GROUP BY 1, 2""")
def walk_forward(spark, sf_dir):
    return splits.walk_forward(bouts(spark, sf_dir)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last"))


def scored_sql() -> str:
    return ", s0 AS (SELECT bout_id, (winner = e1)::INTEGER AS y, 1 / (1 + exp(-(coalesce(q1, 25) - coalesce(q2, 25)) / 20)) AS p, 1 / (1 + exp(-(coalesce(q1, 25) - coalesce(q2, 25)) / 60)) AS p2 FROM bout WHERE winner IS NOT NULL), s AS (SELECT *, row_number() OVER (ORDER BY bout_id) - 1 AS row_id FROM s0), n AS (SELECT count(*) AS n FROM s)"


def scored(spark, sf_dir):
    """Labelled probabilities of two models for every decisive bout."""
    a, b = F.coalesce("q1", F.lit(25.0)), F.coalesce("q2", F.lit(25.0))
    p = lambda scale: 1 / (1 + F.exp(-(a - b) / scale))
    rows = matchup.decisive(bouts(spark, sf_dir)).select("bout_id", (F.col("winner") == F.col("e1")).cast("int").alias("y"), p(20).alias("p"), p(60).alias("p2"))
    return splits.numbered(rows, "bout_id")


def loss_sql(p: str = "p") -> str:
    q = f"least(greatest({p}, 1e-15), 1 - 1e-15)"
    return f"-ln(CASE WHEN y = 1 THEN {q} ELSE 1 - {q} END)"


SCORES_SQL = f"round(avg(((p > 0.5) = (y = 1))::INTEGER), 6) AS accuracy, round(avg({loss_sql()}), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier"


@query("metrics", BOUT + scored_sql() + f" SELECT {SCORES_SQL} FROM s")
def metrics_query(spark, sf_dir):
    return metrics.scores(scored(spark, sf_dir)).select(*[rnd(F.col(n)).alias(n) for n, _, _ in metrics.METRICS])


@query("reference_scores", BOUT + scored_sql() + f", r AS (SELECT y, (SELECT avg(y) FROM s) AS p FROM s) SELECT {SCORES_SQL} FROM r")
def reference_scores(spark, sf_dir):
    return metrics.reference_scores(scored(spark, sf_dir)).select(*[rnd(F.col(n)).alias(n) for n, _, _ in metrics.METRICS])


#: Replicates of the intervals, and of the queries that list every draw.
REPLICATES, LISTED = 2000, 20


def boot_sql(replicates: int) -> str:
    """The draws in the same arithmetic, each step an alias of the one before."""
    steps = ["(b * 2654435761 + 7) & 4294967295", *["(xor({0}, {0} >> 16) * 73244475) & 4294967295"] * 2, "xor({0}, {0} >> 16)", "xor({0}, place & 4294967295)", *["(xor({0}, {0} >> 16) * 73244475) & 4294967295"] * 2, "xor({0}, {0} >> 16)"]
    aliased = ", ".join(f"{step.format(f'k{i - 1}')} AS k{i}" for i, step in enumerate(steps))
    return f", b AS (SELECT b, k{len(steps) - 1} % (SELECT n FROM n) AS row_id FROM (SELECT b, {aliased} FROM (SELECT b, row_id AS place FROM s, range(0, {replicates}) t(b))))"


BOOT = boot_sql(REPLICATES)


@query("bootstrap_draws", BOUT + scored_sql() + boot_sql(LISTED) + " SELECT b::INTEGER AS b, row_id, count(*)::BIGINT AS m FROM b GROUP BY 1, 2")
def bootstrap_draws(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return splits.bootstrap(rows, rows.count(), LISTED)


@query("out_of_bag", BOUT + scored_sql() + boot_sql(LISTED) + f" SELECT k.b::INTEGER AS b, count(*)::BIGINT AS n FROM (SELECT b, row_id FROM s, range(0, {LISTED}) t(b)) k LEFT JOIN (SELECT DISTINCT b, row_id FROM b) d ON d.b = k.b AND d.row_id = k.row_id WHERE d.b IS NULL GROUP BY 1")
def out_of_bag(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return splits.out_of_bag(rows, splits.bootstrap(rows, rows.count(), LISTED), LISTED).groupBy("b").agg(F.count(F.lit(1)).alias("n"))


@query("bootstrap_ci", BOUT + scored_sql() + BOOT + f", v AS (SELECT b, avg({loss_sql()}) AS v FROM b JOIN s USING (row_id) GROUP BY 1) SELECT round((SELECT avg({loss_sql()}) FROM s), 6) AS point, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v")
def bootstrap_ci(spark, sf_dir):
    rows = checkpointed(scored(spark, sf_dir))
    out = metrics.mean_intervals(rows, rows.count(), metrics.loss_of(F.col("y"), F.col("p")), REPLICATES)
    return out.select(*[rnd(F.col(c)).alias(c) for c in out.columns])


PAIRED = BOUT + scored_sql() + BOOT + f", v AS (SELECT b, avg({loss_sql()}) - avg({loss_sql('p2')}) AS v FROM b JOIN s USING (row_id) GROUP BY 1), i AS (SELECT (SELECT avg({loss_sql()}) - avg({loss_sql('p2')}) FROM s) AS point, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM v)"


def paired(spark, sf_dir):
    rows = checkpointed(scored(spark, sf_dir))
    return metrics.mean_intervals(rows, rows.count(), metrics.loss_of(F.col("y"), F.col("p")) - metrics.loss_of(F.col("y"), F.col("p2")), REPLICATES)


@query("paired_ci", PAIRED + " SELECT round(point, 6) AS point, round(low, 6) AS low, round(high, 6) AS high FROM i")
def paired_ci(spark, sf_dir):
    out = paired(spark, sf_dir)
    return out.select(*[rnd(F.col(c)).alias(c) for c in out.columns])


@query("verdict", PAIRED + " SELECT CASE WHEN low <= 0 AND high >= 0 THEN 'inside noise' WHEN point < 0 THEN 'REAL improvement' ELSE 'REAL regression' END AS verdict, round((high - low) / 2, 6) AS half, (low <= high + 1 AND low + 1 <= high) AS overlaps FROM i")
def verdict(spark, sf_dir):
    low, high = F.col("low"), F.col("high")
    return paired(spark, sf_dir).select(S.verdict(F.col("point"), low, high, F.lit(True)).alias("verdict"), rnd(S.half_width(low, high)).alias("half"), S.overlap(low, high, low + 1, high + 1).alias("overlaps"))


@query("reliability", BOUT + scored_sql() + ", e AS (SELECT k / 10.0::DOUBLE AS lo FROM range(0, 10) t(k)) SELECT ((SELECT count(*) FROM e WHERE p >= lo) - 1)::INTEGER AS bin, count(*)::BIGINT AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM s GROUP BY 1")
def reliability(spark, sf_dir):
    return metrics.reliability(scored(spark, sf_dir)).select("bin", "n", rnd(F.col("mean_p")).alias("mean_p"), rnd(F.col("mean_y")).alias("mean_y"))


@query("confusion", BOUT + scored_sql() + " SELECT count(*) FILTER (WHERE p > 0.5 AND y = 1)::BIGINT AS tp, count(*) FILTER (WHERE p > 0.5 AND y = 0)::BIGINT AS fp, count(*) FILTER (WHERE NOT p > 0.5 AND y = 0)::BIGINT AS tn, count(*) FILTER (WHERE NOT p > 0.5 AND y = 1)::BIGINT AS fn FROM s")
def confusion(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir))


@query("majority_baseline", BOUT + ", " + boundary_sql("bout", "b1", 0.18) + ", l AS (SELECT *, (winner = e1)::INTEGER AS y FROM bout WHERE winner IS NOT NULL), m AS (SELECT CASE WHEN 2 * sum(y) > count(*) THEN 1 ELSE 0 END AS c FROM l WHERE dt < (SELECT boundary FROM b1)) SELECT c::INTEGER AS c, round((SELECT avg((y = c)::INTEGER) FROM l WHERE dt >= (SELECT boundary FROM b1)), 6) AS accuracy FROM m")
def majority_baseline(spark, sf_dir):
    rows = splits.chronological(bouts(spark, sf_dir)).where("winner IS NOT NULL").withColumn("y", (F.col("winner") == F.col("e1")).cast("int"))
    test = F.col("is_test")
    sums = rows.agg(F.sum(F.when(~test, F.col("y"))).alias("pos"), F.count_if(~test).alias("n"), F.avg(F.when(test, F.col("y"))).alias("rate"))
    c = F.when(2 * F.col("pos") > F.col("n"), 1).otherwise(0)
    return sums.select(c.alias("c"), rnd(F.when(c == 1, F.col("rate")).otherwise(1 - F.col("rate"))).alias("accuracy"))


@query("fold_summary", "SELECT event_type, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd FROM (SELECT event_type, ts::DATE AS d, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def fold_summary(spark, sf_dir):
    folds = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    return folds.groupBy("event_type").agg(rnd(F.avg("v")).alias("mean"), rnd(F.coalesce(F.stddev_samp("v"), F.lit(0.0))).alias("sd"))


@query("column_variance", "SELECT round(var_pop(p_size), 6) AS size_var, round(var_pop(p_retailprice), 4) AS price_var FROM part")
def column_variance(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(rnd(F.var_pop("p_size")).alias("size_var"), rnd(F.var_pop("p_retailprice"), 4).alias("price_var"))


EXTRA = BOUT + ", r AS (SELECT bout_id AS row_id, coalesce(q1 - q2, 0) AS d, coalesce(secs, 0) AS s, dt FROM bout), l AS (SELECT quantile_cont(abs(d), 0.99) AS d99, quantile_cont(abs(s), 0.99) AS s99 FROM r WHERE dt < DATE '1998-01-01')"


def extra_rows(spark, sf_dir):
    return bouts(spark, sf_dir).select(F.col("bout_id").alias("row_id"), F.coalesce(F.col("q1") - F.col("q2"), F.lit(0.0)).alias("d"), F.coalesce("secs", F.lit(0.0)).alias("s"), "dt")


@query("extrapolation", EXTRA + " SELECT row_id, 'd' AS feature, d AS value, d99 AS p99 FROM r, l WHERE dt >= DATE '1998-01-01' AND abs(d) > d99 AND d <> 0 UNION ALL SELECT row_id, 's', s, s99 FROM r, l WHERE dt >= DATE '1998-01-01' AND abs(s) > s99 AND s <> 0")
def extrapolation(spark, sf_dir):
    rows = extra_rows(spark, sf_dir)
    return quality.extrapolation(rows.where("dt < DATE '1998-01-01'"), rows.where("dt >= DATE '1998-01-01'"), ["d", "s"]).select("row_id", "feature", "value", "p99")


@query("tail_count", BOUT + " SELECT count(*) FILTER (WHERE abs(q1 - q2) >= 30)::BIGINT AS n, round(100 * count(*) FILTER (WHERE abs(q1 - q2) >= 30) / count(*)::DOUBLE, 6) AS pct FROM bout")
def tail_count(spark, sf_dir):
    hit = F.count_if(F.abs(F.col("q1") - F.col("q2")) >= 30)
    return bouts(spark, sf_dir).agg(hit.alias("n"), rnd(100 * hit / F.count(F.lit(1))).alias("pct"))


# ---- learning ---------------------------------------------------------------

@query("entropy", "WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT round(-sum(n / (SELECT sum(n) FROM c) * log2(n / (SELECT sum(n) FROM c))), 6) AS h FROM c")
def entropy(spark, sf_dir):
    return tree.entropy(table(spark, sf_dir, "orders"), "o_orderpriority").select(rnd(F.col("h")).alias("h"))


@query("info_gain", "WITH c AS (SELECT l_returnflag AS s, l_linestatus AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY s) AS k, sum(n) OVER (PARTITION BY y) AS ky, sum(n) OVER () AS t FROM c), p AS (SELECT DISTINCT y, ky, t FROM k) SELECT round((SELECT -sum(ky / t * log2(ky / t)) FROM p) + (SELECT sum(n * log2(n / k)) / any_value(t) FROM k), 6) + 0.0 AS gain")
def info_gain(spark, sf_dir):
    return tree.information_gain(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select(rnd(F.col("gain")).alias("gain"))


def learn_sql() -> str:
    return """WITH r0 AS (SELECT doc_id AS row_id, ANY_VALUE(quality) AS y, ANY_VALUE(n_chars)::DOUBLE AS x0, ANY_VALUE(length(source) + doc_id % 7)::DOUBLE AS x1 FROM labels JOIN documents USING (doc_id) GROUP BY 1)"""


def learn_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    both = table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("doc_id").agg(F.any_value("quality").alias("y"), F.any_value("n_chars").cast("double").alias("x0"), F.any_value(F.length("source") + F.col("doc_id") % 7).cast("double").alias("x1"))
    return both.select(F.col("doc_id").alias("row_id"), F.array("x0", "x1").alias("x"), F.col("y").cast("int").alias("y"))


def rooted(rows):
    return rows.select(F.lit(0).alias("tree_id"), F.lit(0).cast("long").alias("node_id"), "x", "y", F.lit(1).alias("m"))


def ent(p: str) -> str:
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0.0::DOUBLE ELSE -{p} * log2({p}) - (1 - {p}) * log2(1 - {p}) END)"


def cuts_sql(source: str, out: str, min_leaf: int) -> str:
    """All cuts of each node of source (node, x0, x1, y)."""
    return f"""{out}_u AS (SELECT node, 0 AS f, x0 AS v, y FROM {source} UNION ALL SELECT node, 1, x1, y FROM {source}),
{out}_g AS (SELECT node, f, v, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM {out}_u GROUP BY 1, 2, 3),
{out}_w AS (SELECT node, f, v, lead(v) OVER o AS nv, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS ln, sum(p) OVER (o ROWS UNBOUNDED PRECEDING) AS lp, sum(n) OVER (PARTITION BY node, f) AS n, sum(p) OVER (PARTITION BY node, f) AS p FROM {out}_g WINDOW o AS (PARTITION BY node, f ORDER BY v)),
{out} AS (SELECT node, f, CASE WHEN (v + nv) / 2 >= nv THEN v ELSE (v + nv) / 2 END AS thr, n, p,
  round({ent('(p / n)')} - (ln * {ent('(lp / ln)')} + (n - ln) * {ent('((p - lp) / (n - ln))')}) / n, 12) AS gain FROM {out}_w WHERE nv IS NOT NULL AND ln >= {min_leaf} AND n - ln >= {min_leaf})"""


BEST = "{b} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, thr) AS rn FROM {c} WHERE gain > 0) WHERE rn = 1)"
ROOT = learn_sql() + ", r AS (SELECT 0 AS node, * FROM r0), " + cuts_sql("r", "c", 5)


@query("best_split", ROOT + ", " + BEST.format(b="b", c="c") + " SELECT f::INTEGER AS feature, thr AS threshold, round(gain, 6) AS gain FROM b")
def best_split(spark, sf_dir):
    return tree.best_split(rooted(learn_rows(spark, sf_dir)), min_leaf=5).select(F.col("feature").cast("int").alias("feature"), "threshold", rnd(F.col("gain")).alias("gain"))


TIES = learn_sql() + ", r AS (SELECT 0 AS node, * FROM r0), " + cuts_sql("r", "c", 25).replace("round(", "(").replace(", 12) AS gain", ") AS gain")


@query("root_ties", TIES + ", f AS (SELECT f, thr, gain FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY round(gain, 12) DESC, thr) AS rn FROM c) WHERE rn = 1) SELECT f::INTEGER AS feature, thr AS threshold, round(gain, 6) AS best, gain >= (SELECT max(gain) FROM f) - 1e-12 AS tied FROM f")
def root_ties(spark, sf_dir):
    return tree.root_ties(rooted(learn_rows(spark, sf_dir)), min_leaf=25).select(F.col("feature").cast("int").alias("feature"), "threshold", rnd(F.col("best")).alias("best"), "tied")


DEPTH2 = ROOT + ", " + BEST.format(b="b", c="c") + """,
r1 AS (SELECT 1 + (CASE f WHEN 0 THEN x0 ELSE x1 END > thr)::BIGINT AS node, row_id, x0, x1, r.y FROM r, b), """ + cuts_sql("(SELECT r1.* FROM r1 JOIN (SELECT node FROM r1 GROUP BY 1 HAVING count(*) >= 20 AND min(y) < max(y)) USING (node))", "c1", 5) + ", " + BEST.format(b="b1", c="c1") + """,
r2 AS (SELECT 2 * r1.node + 1 + (CASE f WHEN 0 THEN x0 ELSE x1 END > thr)::BIGINT AS node, row_id, y FROM r1 JOIN b1 ON b1.node = r1.node),
a AS (SELECT 0 AS node, row_id, y FROM r UNION ALL SELECT node, row_id, y FROM r1 UNION ALL SELECT * FROM r2),
s AS (SELECT node, f, thr, gain FROM b UNION ALL SELECT node, f, thr, gain FROM b1),
t AS (SELECT a.node, any_value(f) AS f, any_value(thr) AS thr, any_value(gain) AS gain, count(*) AS n, sum(y) AS p FROM a LEFT JOIN s ON s.node = a.node GROUP BY 1)"""


def depth2(spark, sf_dir):
    rows = learn_rows(spark, sf_dir)
    return rows, tree.grow(rooted(rows).drop("node_id"), columns=2, max_depth=2, min_split=20, min_leaf=5)


@query("tree_depth2", DEPTH2 + " SELECT node::BIGINT AS node_id, f::INTEGER AS feature, thr AS threshold, f IS NULL AS is_leaf, (2 * p > n)::INTEGER AS prediction, round(p / n, 6) AS proba, n::BIGINT AS n, round(gain, 6) AS gain FROM t")
def tree_depth2(spark, sf_dir):
    _, nodes = depth2(spark, sf_dir)
    return nodes.select("node_id", "feature", "threshold", "is_leaf", "prediction", rnd(F.col("proba")).alias("proba"), "n", rnd(F.col("gain")).alias("gain"))


@query("tree_predict", DEPTH2 + " SELECT row_id, (2 * t.p > t.n)::INTEGER AS prediction, round(t.p / t.n, 6) AS proba FROM (SELECT row_id, arg_max(node, node) AS node FROM a GROUP BY 1) l JOIN t ON t.node = l.node")
def tree_predict(spark, sf_dir):
    rows, nodes = depth2(spark, sf_dir)
    return tree.predict(rows, nodes, 2).select("row_id", "prediction", rnd(F.col("proba")).alias("proba"))


@query("tree_shape", DEPTH2 + " SELECT max(floor(log2(node + 1)))::INTEGER AS depth, count(*) FILTER (WHERE f IS NULL)::BIGINT AS leaves, count(f)::BIGINT AS internal FROM t")
def tree_shape(spark, sf_dir):
    return tree.shape(depth2(spark, sf_dir)[1]).drop("tree_id")


@query("importance", DEPTH2 + " SELECT f::INTEGER AS feature, round(sum(gain * n) / (SELECT sum(gain * n) FROM t WHERE f IS NOT NULL), 6) AS importance FROM t WHERE f IS NOT NULL GROUP BY 1")
def importance(spark, sf_dir):
    return tree.importances(depth2(spark, sf_dir)[1]).select("feature", rnd(F.col("importance")).alias("importance"))


VOTES = ", v AS (SELECT k AS tree_id, row_id, (p + (k - 2) / 20.0 > 0.5)::INTEGER AS vote, least(greatest(p + (k - 2) / 20.0::DOUBLE, 0), 1) AS proba FROM s, range(0, 4) t(k) WHERE (row_id + k) % 3 <> 0 AND row_id % 50 <> 0)"


def votes(rows):
    p = F.col("p") + (F.col("tree_id") - 2) / 20.0
    each = rows.where("row_id % 50 != 0").withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("(row_id + tree_id) % 3 != 0")
    return each.select("tree_id", "row_id", (p > 0.5).cast("int").alias("vote"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("proba"))


@query("majority_vote", BOUT + scored_sql() + VOTES + " SELECT s.row_id, CASE WHEN count(vote) = 0 THEN -1 WHEN 2 * sum(vote) > count(vote) THEN 1 ELSE 0 END::INTEGER AS vote FROM s LEFT JOIN v ON v.row_id = s.row_id GROUP BY 1")
def majority_vote(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return metrics.majority_vote(votes(rows), rows)


@query("soft_vote", BOUT + scored_sql() + VOTES + " SELECT row_id, round(avg(proba), 6) AS p FROM v GROUP BY 1")
def soft_vote(spark, sf_dir):
    return metrics.soft_vote(votes(scored(spark, sf_dir))).select("row_id", rnd(F.col("p")).alias("p"))


#: The forest, the depths and numbers of trees that are swept, the trees, replicates and seeds of the control on shuffled labels.
TREES, DEPTH = 200, 12
DEPTHS, TREE_COUNTS = (1, 2, 3, 4, 5, 6, 8, 10, 15, 20), (1, 5, 10, 25, 50, 100, 200)
CONTROL_TREES, CONTROL_DRAWS, SEEDS = 60, 1000, (1, 2, 3, 4, 5)
#: Model, depth, smallest split and leaf of the trees that every fold refits.
FOLD_TREES = (("fixed depth", 4, 50, 25), ("matched", 12, 10, 5))


def forest(spark, sf_dir):
    """The numbered rows, how many there are, and the node table of the forest over them."""
    rows = checkpointed(splits.numbered(learn_rows(spark, sf_dir).withColumnRenamed("row_id", "key"), "key"))
    n = rows.count()
    return rows, n, forests.fit(rows.select("row_id", "x", F.array("y").alias("ys")), n, TREES, columns=2, max_depth=DEPTH, min_split=10, min_leaf=5, rule="sqrt")


def most():
    return F.when(2 * F.col("votes") > F.col("n"), 1).otherwise(0)


@query("forest_fit", None)
def forest_fit(spark, sf_dir):
    return forest(spark, sf_dir)[2]


@query("forest_predict", None)
def forest_predict(spark, sf_dir):
    rows, _, nodes = forest(spark, sf_dir)
    return forests.votes(rows, nodes, 2, DEPTH, [(0, TREES)]).select("row_id", most().alias("vote"), (F.col("proba") / F.col("n")).alias("p"))


@query("oob_score", None)
def oob_score(spark, sf_dir):
    """Accuracy from the votes of trees that never drew the row; abstained rows are left out."""
    rows, n, nodes = forest(spark, sf_dir)
    voted = forests.votes(rows, nodes, 2, DEPTH, [(0, TREES)], forests.unseen(spark, n, TREES)).where("n > 0")
    return voted.join(rows.select("row_id", "y"), "row_id").agg(F.avg((most() == F.col("y")).cast("double")).alias("oob"), F.count(F.lit(1)).alias("n"))


@query("depth_sweep", None)
def depth_sweep(spark, sf_dir):
    """Validation accuracy of trees cut at each depth, and the depth that is chosen; one growth gives them all."""
    rows = learn_rows(spark, sf_dir).withColumn("valid", F.pmod(F.crc32(F.col("row_id").cast("string").cast("binary")), F.lit(5)) == 0)
    nodes = tree.grow(rooted(rows.where("NOT valid")).drop("node_id"), columns=2, max_depth=DEPTHS[-1], min_split=50, min_leaf=25)
    each = tree.at_depths(tree.landed(rows.where("valid"), nodes, DEPTHS[-1]), nodes, DEPTHS)
    scores = each.join(rows.select("row_id", "y"), "row_id").groupBy("depth").agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"))
    return tree.chosen_depth(scores)


@query("trees_sweep", None)
def trees_sweep(spark, sf_dir):
    """Accuracy of the first k trees: a forest's prefix is the smaller forest."""
    rows, _, nodes = forest(spark, sf_dir)
    hard = forests.votes(rows, nodes, 2, DEPTH, [(0, k) for k in TREE_COUNTS])
    k = F.get(F.array(*[F.lit(k) for k in TREE_COUNTS]), F.col("part"))
    return hard.join(rows.select("row_id", "y"), "row_id").groupBy(k.alias("k")).agg(F.avg((most() == F.col("y")).cast("double")).alias("accuracy"))


@query("run_walk_forward", None)
def run_walk_forward(spark, sf_dir):
    """Every fold refits each model: folds take the place of trees, so all folds of all models grow together, level by level, over rows that are packed once."""
    names = tuple(matchup.feature_names(context=True, weight=True))
    dated = matchup.matrix(feature_table(spark, sf_dir), names, ("dt",)).where("dt IS NOT NULL")
    chunks = histogram.packed(dated.select("x", "y", F.unix_date("dt").alias("at")), len(names))
    folds = splits.fold_bounds([at for at, _, _ in histogram.totals(chunks)])
    asked = [(histogram.Tree(model * len(folds) + fold, start, *how), start, math.inf if stop is None else stop) for model, (_, *how) in enumerate(FOLD_TREES) for fold, start, stop in folds]
    nodes = histogram.grow(chunks, len(names), [t for t, _, _ in asked])
    model = F.get(F.array(*[F.lit(name) for name, *_ in FOLD_TREES]), F.floor(F.col("tree_id") / max(len(folds), 1)).cast("int"))
    each = histogram.answers(chunks, nodes, asked).select(F.pmod("tree_id", F.lit(max(len(folds), 1))).cast("int").alias("tree_id"), model.alias("model"), "y", "p", F.date_from_unix_date(F.col("at").cast("int")).alias("dt"))
    scores = each.groupBy("tree_id", "model").agg(*[f(F.col("y"), F.col("p")).alias(n) for n, f, _ in metrics.METRICS], F.min("dt").alias("first"), F.max("dt").alias("last"), F.count(F.lit(1)).alias("n"))
    return scores.select("tree_id", *[n for n, _, _ in metrics.METRICS], "first", "last", "n", "model")


@query("shuffled_label_control", None)
def shuffled_label_control(spark, sf_dir):
    """For each seed the labels are dealt anew by hash rank and a forest learns the first 82 % of rows: test accuracy with its interval, the base rate, whether the base rate is at or above the interval's low end, and whether that holds for all seeds but one."""
    rows = checkpointed(splits.numbered(learn_rows(spark, sf_dir).withColumnRenamed("row_id", "key"), "key"))
    n = rows.count()
    cut = int(n * 0.82)
    seeds = F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed")
    # the labels in row order meet the rows in the order of their draws, seed by seed, numbered by ranges of draws
    drawn_rows = rows.select(seeds, F.col("row_id").alias("own")).withColumn("draw", S.draw("a", F.col("seed"), F.col("own")))
    ranked = splits.numbered(drawn_rows, "draw", width=max(1, (1 << 32) * 4096 // max(n, 1)), by=("seed",), ties=("own",))
    dealt = ranked.select("seed", F.col("own").alias("row_id"), F.col("row_id").alias("k")).join(rows.select(F.col("row_id").alias("k"), "y"), "k")
    shuffled = checkpointed(dealt.join(rows.select("row_id", "x"), "row_id").select("seed", "row_id", "x", "y"))
    # a tree's number tells its seed: no two seeds share a tree
    labels = shuffled.where(F.col("row_id") < cut).groupBy("row_id").agg(F.any_value("x").alias("x"), F.array(*[F.max(F.when(F.col("seed") == s, F.col("y"))) for s in SEEDS]).alias("ys"))
    nodes = forests.fit(labels, cut, CONTROL_TREES * len(SEEDS), 2, DEPTH, 10, 5, "sqrt", labels=len(SEEDS))
    test = rows.where(F.col("row_id") >= cut).select((F.col("row_id") - cut).alias("row_id"), "x")
    each = forests.votes(test, nodes, 2, DEPTH, [(k * CONTROL_TREES, (k + 1) * CONTROL_TREES) for k in range(len(SEEDS))])
    seed_of = F.get(F.array(*[F.lit(s) for s in SEEDS]), F.col("part"))
    truth = shuffled.where(F.col("row_id") >= cut).select("seed", (F.col("row_id") - cut).alias("row_id"), "y")
    scored_rows = checkpointed(each.select(seed_of.alias("seed"), "row_id", (F.col("proba") / F.col("n")).alias("p")).join(truth, ["seed", "row_id"]))
    right = [F.max(F.when(F.col("seed") == s, metrics.right_of(F.col("y"), F.col("p")))).alias(f"v{s}") for s in SEEDS]
    drawn = resample.means(scored_rows.groupBy("row_id").agg(*right), n - cut, [f"v{s}" for s in SEEDS], CONTROL_DRAWS, 9)
    boot = drawn.select("b", F.inline(F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"v{s}").alias("v")) for s in SEEDS])))
    bounds = boot.groupBy("seed").agg(F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"))
    found = scored_rows.groupBy("seed").agg(metrics.accuracy(F.col("y"), F.col("p")).alias("accuracy"), F.greatest(F.avg("y"), 1 - F.avg("y")).alias("base_rate")).join(bounds, "seed")
    clear = F.col("base_rate") >= F.col("low") - 1e-9
    # five rows
    return found.withColumn("clear", clear).withColumn("passed", F.count_if("clear").over(W.Window.partitionBy()) >= len(SEEDS) - 1)


#: The variants of the features, each its model's columns: the first is what the others are compared with. Without ratings the rating's difference is constant, so no tree can split on it.
VARIANTS = (
    ("static only", matchup.feature_names()),
    ("+ rolling form", [n for n in matchup.feature_names(rolling=True) if n != "elo_diff"]),
    ("+ rolling + live Elo", matchup.feature_names(rolling=True)),
    ("+ rolling + weight", [n for n in matchup.feature_names(rolling=True, weight=True) if n != "elo_diff"]),
    ("+ rolling + bout context", [n for n in matchup.feature_names(rolling=True, context=True) if n != "elo_diff"]),
    ("+ rolling, pruned", matchup.feature_names(rolling=True, pruned=True)),
)


#: Slices that the as-of features of many bouts are worked out in, one after the other.
SLICES = 8


def ablation_scores(spark, sf_dir):
    """(row_id, y and a column for each variant) of the test part: all variants' trees grow together over rows that are packed once, each seeing its own columns."""
    names = matchup.feature_names(rolling=True, context=True, weight=True)
    parts = []
    with ExitStack() as whole:
        own = whole.enter_context(stored(matchup.decisive(bouts(spark, sf_dir))))
        # a slice at a time, each with all rows of its entities or bouts, so that shuffle files are those of one slice
        slices = min(SLICES, 1 + (own.count() >> 18))
        of = lambda df, key, k: df.where(F.pmod(F.xxhash64(key), F.lit(slices)) == k) if slices > 1 else df
        log = history.event_log(own)
        known = checkpointed(history.priors(log))
        with stored(rating.elo(log).select("bout_id", "ent", "elo_pre")) as ratings:
            as_of = [whole.enter_context(stored(history.features(of(log, "ent", k), of(ratings, "ent", k), known).select("bout_id", "ent", "support", *history.AS_OF))) for k in range(slices)]
        as_of = functools.reduce(DataFrame.unionByName, as_of)
        # the bout's number comes along in two columns that no tree sees: a double holds 53 bits
        key = F.array(F.shiftright("bout_id", 32).cast("double"), F.col("bout_id").bitwiseAND(F.lit((1 << 32) - 1)).cast("double"))
        at = F.coalesce(F.unix_date("dt").cast("double"), F.lit(-math.inf))
        for k in range(slices):
            rows = matchup.training_rows(matchup.feature_table(of(own, "bout_id", k), entities(spark, sf_dir)), of(as_of, "bout_id", k))
            parts.append(histogram.packed(matchup.matrix(rows, tuple(names), ("dt",)).select(F.concat("x", key).alias("x"), "y", at.alias("at")), len(names) + 2))
    chunks = functools.reduce(DataFrame.union, parts)
    start = splits.boundary_of([(day, n) for day, n, _ in histogram.totals(chunks) if day > -math.inf])
    start = math.inf if start is None else start
    trees = [histogram.Tree(k, start, *FOLD_TREES[0][1:]) for k in range(len(VARIANTS))]
    nodes = histogram.grow(chunks, len(names), trees, sees={k: sorted(names.index(n) for n in own) for k, (_, own) in enumerate(VARIANTS)})
    each = checkpointed(histogram.side_by_side(chunks, nodes, trees, start, [len(names), len(names) + 1]))
    bout = F.shiftleft(F.col("c0").cast("long"), 32) + F.col("c1").cast("long")
    test = each.select(bout.alias("key"), "y", *[F.col(f"p{k}").alias(name) for k, (name, _) in enumerate(VARIANTS)])
    return checkpointed(splits.numbered(test, "key").drop("key"))


@query("ablation", None)
def ablation(spark, sf_dir):
    """Test scores of six sets of features and their paired differences from the first."""
    rows = ablation_scores(spark, sf_dir)
    return metrics.paired_differences(rows, REPLICATES, [name for name, _ in VARIANTS])


@query("external_agreement", None)
def external_agreement(spark, sf_dir):
    """Share of rows on which the exact tree and Spark ML's binned tree agree, both root entropies, and their quotient: 1 where both count in bits (informational)."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    rows, nodes = depth2(spark, sf_dir)
    vectors = rows.select("row_id", array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
    model = DecisionTreeClassifier(impurity="entropy", maxDepth=2, minInstancesPerNode=5, maxBins=256).fit(vectors)
    theirs = float(model._java_obj.rootNode().impurity())
    other = model.transform(vectors).select("row_id", F.col("prediction").alias("other"))
    agreed = tree.predict(rows, nodes, 2).join(other, "row_id").agg(F.avg((F.col("prediction") == F.col("other")).cast("double")).alias("agreement"))
    ours = tree.entropy(rows, "y").select(F.col("h").alias("root_entropy"))
    return agreed.crossJoin(ours).withColumn("other_entropy", F.lit(theirs)).withColumn("quotient", F.col("other_entropy") / F.nullif("root_entropy", F.lit(0.0)))


@query("feature_positions", cte("entity", "bout") + FEATURES + " SELECT stance_matchup, count(*)::BIGINT AS n, round(avg(label), 6) AS a_wins FROM feat GROUP BY 1")
def feature_positions(spark, sf_dir):
    return feature_table(spark, sf_dir).groupBy("stance_matchup").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("label")).alias("a_wins"))
