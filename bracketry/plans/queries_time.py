"""The catalogue's temporal queries: event log, as-of features, ratings, matchups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from bracketry.functions import scalars as S
from bracketry.operators import history, matchup, rating
from bracketry.plans.adapters import bouts, cte, entities
from bracketry.plans.queries import COIN, feature_table, log_of, query, rnd
from bracketry.session import checkpointed, table

LOG = cte("bout", "elog")
PRIORS = """, prior AS (
  SELECT cls, coalesce(avg(won), 0.5) AS wr, coalesce(avg(is_finish::INTEGER) FILTER (WHERE won = 1), 0.5) AS fr, coalesce(avg(is_finish::INTEGER) FILTER (WHERE won = 0), 0.5) AS lr FROM elog GROUP BY GROUPING SETS ((cls), ())
)"""
#: Sums over the rows that have a statistic and seconds: the statistic's and the seconds'.
SUMS = ", ".join(f"sum(b.{c}) FILTER (WHERE b.secs > 0) AS s_{c}, sum(b.secs) FILTER (WHERE b.secs > 0 AND b.{c} IS NOT NULL) AS t_{c}" for c in ("own_q", "opp_q", "own_td", "own_sub", "own_ctrl"))
#: Every log row next to its entity's rows of earlier days.
PAST = PRIORS + f""", past AS (
  SELECT a.bout_id, a.ent, any_value(a.dt) AS dt, any_value(a.cls) AS cls, count(b.bout_id) AS n, coalesce(sum(b.won), 0)::BIGINT AS wins,
    count(*) FILTER (WHERE b.won = 1 AND b.is_finish) AS wf, count(*) FILTER (WHERE b.won = 0 AND b.is_finish) AS lf,
    {SUMS},
    sum(b.secs) AS secs, max(b.dt) AS last, list(b.won ORDER BY b.dt DESC, b.bout_id DESC) FILTER (WHERE b.bout_id IS NOT NULL) AS results
  FROM elog a LEFT JOIN elog b ON a.ent = b.ent AND b.dt < a.dt GROUP BY a.bout_id, a.ent
)"""
LANDED = "s_own_q / t_own_q * 60"
WITH_PRIOR = " FROM past p JOIN prior c ON c.cls = p.cls"


def asof(spark, sf_dir, ratings=None):
    # the log is read three times: by itself, for its days and for the priors
    return history.features(checkpointed(log_of(spark, sf_dir)), ratings)


@query("event_log", LOG + " SELECT * FROM elog")
def event_log(spark, sf_dir):
    return log_of(spark, sf_dir)


@query("division_priors", LOG + PRIORS + " SELECT cls, cls IS NULL AS is_global, round(wr, 6) AS win_rate, round(fr, 6) AS finish_rate, round(lr, 6) AS finished_rate FROM prior")
def division_priors(spark, sf_dir):
    return history.priors(log_of(spark, sf_dir)).select("cls", "is_global", *[rnd(F.col(c)).alias(c) for c in ("win_rate", "finish_rate", "finished_rate")])


@query("asof_counts_rates", LOG + PAST + " SELECT bout_id, ent, n::BIGINT AS n_fights, round(CASE WHEN n = 0 THEN wr ELSE wins / n END, 6) AS win_rate_raw" + WITH_PRIOR)
def asof_counts_rates(spark, sf_dir):
    return asof(spark, sf_dir).select("bout_id", "ent", "n_fights", rnd(F.col("win_rate_raw")).alias("win_rate_raw"))


@query("asof_shrunk_win_rate", LOG + PAST + " SELECT bout_id, ent, n::BIGINT AS n_fights, round(CASE WHEN n = 0 THEN wr ELSE (wins + 5 * wr) / (n + 5) END, 6) AS win_rate, date_diff('day', last, p.dt)::INTEGER AS days_since_last" + WITH_PRIOR)
def asof_shrunk_win_rate(spark, sf_dir):
    return asof(spark, sf_dir).select("bout_id", "ent", "n_fights", rnd(F.col("win_rate")).alias("win_rate"), "days_since_last")


@query("asof_last3", LOG + PAST + " SELECT bout_id, ent, round(CASE WHEN n = 0 THEN wr ELSE list_avg(results[1:3]) END, 6) AS last3_win_rate" + WITH_PRIOR)
def asof_last3(spark, sf_dir):
    return asof(spark, sf_dir).select("bout_id", "ent", rnd(F.col("last3_win_rate")).alias("last3_win_rate"))


@query("asof_finish_rates", LOG + PAST + " SELECT bout_id, ent, round(CASE WHEN n = 0 THEN fr ELSE (wf + 5 * fr) / (wins + 5) END, 6) AS finish_rate, round(CASE WHEN n = 0 THEN lr ELSE (lf + 5 * lr) / (n - wins + 5) END, 6) AS finished_rate" + WITH_PRIOR)
def asof_finish_rates(spark, sf_dir):
    return asof(spark, sf_dir).select("bout_id", "ent", rnd(F.col("finish_rate")).alias("finish_rate"), rnd(F.col("finished_rate")).alias("finished_rate"))


@query("asof_matched_rates", LOG + PAST + f" SELECT bout_id, ent, round({LANDED} + 1e-9, 6) AS landed_pm, round(s_opp_q / t_opp_q * 60 + 1e-9, 6) AS absorbed_pm, round(s_own_td / t_own_td * 900 + 1e-9, 6) AS td_landed_p15m, round(s_own_sub / t_own_sub * 900 + 1e-9, 6) AS sub_att_p15m, round(s_own_ctrl / t_own_ctrl + 1e-9, 6) AS ctrl_frac" + WITH_PRIOR)
def asof_matched_rates(spark, sf_dir):
    return asof(spark, sf_dir).select("bout_id", "ent", *[rnd(F.col(name) + 1e-9).alias(name) for name, _, _ in history.RATES])


@query("asof_layoff", LOG + PAST + " SELECT bout_id, ent, date_diff('day', last, p.dt)::INTEGER AS days_since_last, CASE WHEN n > 0 THEN coalesce(secs, 0) END AS total_fight_secs" + WITH_PRIOR)
def asof_layoff(spark, sf_dir):
    return asof(spark, sf_dir).select("bout_id", "ent", "days_since_last", "total_fight_secs")


@query("support_tier", LOG + PAST + " SELECT CASE WHEN n = 0 THEN 'none' WHEN n < 3 THEN 'thin' ELSE 'ok' END AS support, count(*)::BIGINT AS n" + WITH_PRIOR + " GROUP BY 1")
def support_tier(spark, sf_dir):
    return asof(spark, sf_dir).groupBy("support").agg(F.count(F.lit(1)).alias("n"))


@query("debut_rows", LOG + PAST + " SELECT bout_id, ent, round(wr, 6) AS win_rate, round(fr, 6) AS finish_rate, NULL::DOUBLE AS landed_pm, NULL::INTEGER AS days_since_last, 1500.0::DOUBLE AS elo" + WITH_PRIOR + " WHERE n = 0")
def debut_rows(spark, sf_dir):
    """Rows of entities without a bout on an earlier day; their ratings come from the sweep, of bouts on other days alone."""
    log = checkpointed(log_of(spark, sf_dir))
    before = rating.as_of_days(rating.elo(log), log)
    rows = history.features(log, before).where("n_fights = 0")
    return rows.select("bout_id", "ent", rnd(F.col("win_rate")).alias("win_rate"), rnd(F.col("finish_rate")).alias("finish_rate"), "landed_pm", "days_since_last", "elo")


@query("most_recent_class", LOG + " SELECT ent, arg_max(cls, dt::VARCHAR || lpad(bout_id::VARCHAR, 12, '0')) AS cls FROM elog GROUP BY 1")
def most_recent_class(spark, sf_dir):
    return log_of(spark, sf_dir).groupBy("ent").agg(F.max_by("cls", F.struct("dt", "bout_id")).alias("cls"))


INFER = " , latest AS (SELECT ent, arg_max(cls, dt::VARCHAR || lpad(bout_id::VARCHAR, 12, '0')) AS cls FROM elog GROUP BY 1), asked AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE s_suppkey END AS a, CASE WHEN s_suppkey % 5 = 0 THEN -2 ELSE s_suppkey + 1 END AS b FROM supplier)"


@query("infer_division", LOG + INFER + " SELECT key, coalesce(x.cls, y.cls) AS cls FROM asked LEFT JOIN latest x ON x.ent = a LEFT JOIN latest y ON y.ent = b")
def infer_division(spark, sf_dir):
    """The latest class of A, else of B, else none."""
    k = F.col("s_suppkey")
    asked = table(spark, sf_dir, "supplier").select(k.alias("key"), F.when(k % 3 == 0, -1).otherwise(k).alias("a"), F.when(k % 5 == 0, -2).otherwise(k + 1).alias("b"))
    return matchup.infer_class(asked, log_of(spark, sf_dir)).select("key", "cls")


@query("prior_bout_counts", cte("bout") + " SELECT e AS ent, count(*)::BIGINT AS n FROM (SELECT e1 AS e FROM bout WHERE dt < DATE '1997-01-01' UNION ALL SELECT e2 FROM bout WHERE dt < DATE '1997-01-01') GROUP BY 1")
def prior_bout_counts(spark, sf_dir):
    return bouts(spark, sf_dir).where("dt < DATE '1997-01-01'").select(F.explode(F.array("e1", "e2")).alias("ent")).groupBy("ent").agg(F.count(F.lit(1)).alias("n"))


@query("strictly_before_training", cte("bout") + " SELECT count(*)::BIGINT AS n, max(dt) AS last FROM bout WHERE dt < DATE '1998-01-01'")
def strictly_before_training(spark, sf_dir):
    return bouts(spark, sf_dir).where("dt < DATE '1998-01-01'").agg(F.count(F.lit(1)).alias("n"), F.max("dt").alias("last"))


@query("asof_external_probe", LOG + ", q AS (SELECT s_suppkey AS ent, DATE '1996-06-01' + (s_suppkey % 500)::INTEGER AS d FROM supplier) SELECT q.ent, count(e.bout_id)::BIGINT AS n, coalesce(sum(won), 0)::BIGINT AS wins FROM q LEFT JOIN elog e ON e.ent = q.ent AND e.dt < q.d GROUP BY 1")
def asof_external_probe(spark, sf_dir):
    probes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ent"), F.date_add(F.lit("1996-06-01").cast("date"), (F.col("s_suppkey") % 500).cast("int")).alias("d"))
    # days, not rows, meet the probes
    days = log_of(spark, sf_dir).groupBy("ent", "dt").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"))
    met = probes.alias("q").join(days.alias("e"), (F.col("q.ent") == F.col("e.ent")) & (F.col("e.dt") < F.col("q.d")), "left")
    return met.groupBy(F.col("q.ent").alias("ent")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("wins"))


# ---- ratings ----------------------------------------------------------------

#: The sweep over all bouts; the table keeps the ratings so far by entity (bout -1) and each bout's two rows.
ELO = cte("bout", "elog").replace("WITH ", "WITH RECURSIVE ", 1) + """, ord AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY dt, ent, bout_id) AS i, * FROM (SELECT bout_id, min(dt) AS dt, min(ent) AS ent, max(ent) AS opp, arg_min(won, ent) AS won FROM elog GROUP BY 1)
), elo(bout, ent, seq, pre, post) USING KEY (bout, ent) AS (
  SELECT -1::BIGINT, -1::BIGINT, 0::BIGINT, 0::DOUBLE, 0::DOUBLE
  UNION
  (WITH cur AS (SELECT o.*, coalesce(a.post, 1500) AS ra, coalesce(b.post, 1500) AS rb FROM (SELECT max(seq) AS s FROM elo) l JOIN ord o ON o.i = l.s + 1
     LEFT JOIN recurring.elo a ON a.bout = -1 AND a.ent = o.ent LEFT JOIN recurring.elo b ON b.bout = -1 AND b.ent = o.opp),
   d AS (SELECT *, 24 * (won - 1 / (1 + pow(10, (rb - ra) / 400))) AS ch FROM cur)
   SELECT -1::BIGINT, ent, i, ra, ra + ch FROM d UNION ALL SELECT -1::BIGINT, opp, i, rb, rb - ch FROM d UNION ALL SELECT bout_id, ent, i, ra, ra + ch FROM d UNION ALL SELECT bout_id, opp, i, rb, rb - ch FROM d)
)"""


def ratings_of(spark, sf_dir):
    return rating.elo(log_of(spark, sf_dir))


@query("elo_step", "SELECT c_custkey AS id, round(1500 + c_custkey % 300 + 24 * ((c_custkey % 2) - 1 / (1 + pow(10, ((1600.0 - c_custkey % 200) - (1500 + c_custkey % 300)) / 400))), 6) AS a, round((1600.0 - c_custkey % 200) - 24 * ((c_custkey % 2) - 1 / (1 + pow(10, ((1600.0 - c_custkey % 200) - (1500 + c_custkey % 300)) / 400))), 6)::DOUBLE AS b FROM customer")
def elo_step(spark, sf_dir):
    key = F.col("c_custkey")
    a, b = rating.update((1500 + key % 300).cast("double"), (1600 - key % 200).cast("double"), key % 2)
    return table(spark, sf_dir, "customer").select(key.alias("id"), rnd(a).alias("a"), rnd(b).alias("b"))


@query("elo_ratings", ELO + " SELECT bout AS bout_id, ent, round(pre, 6) AS elo_pre, round(post, 6) AS elo_post FROM elo WHERE bout >= 0")
def elo_ratings(spark, sf_dir):
    return ratings_of(spark, sf_dir).select("bout_id", "ent", rnd(F.col("elo_pre")).alias("elo_pre"), rnd(F.col("elo_post")).alias("elo_post"))


@query("elo_latest", ELO + " SELECT ent, round(post, 6) AS elo FROM elo WHERE bout = -1 AND ent >= 0")
def elo_latest(spark, sf_dir):
    return rating.latest(ratings_of(spark, sf_dir)).select("ent", rnd(F.col("elo")).alias("elo"))


@query("elo_asof", ELO + " SELECT e.ent, round(arg_max(post, seq), 6) AS elo FROM elo e JOIN bout b ON b.bout_id = e.bout WHERE b.dt < DATE '1997-01-01' GROUP BY 1")
def elo_asof(spark, sf_dir):
    return rating.as_of(ratings_of(spark, sf_dir), "1997-01-01").select("ent", rnd(F.col("elo")).alias("elo"))


@query("elo_chain_check", ELO + ", c AS (SELECT post, lead(pre) OVER (PARTITION BY ent ORDER BY seq) AS following FROM elo WHERE bout >= 0) SELECT count(*) FILTER (WHERE following IS NOT NULL AND abs(following - post) > 1e-9)::BIGINT AS broken, count(following)::BIGINT AS links FROM c")
def elo_chain_check(spark, sf_dir):
    following = F.lead("elo_pre").over(W.Window.partitionBy("ent").orderBy("seq"))
    return ratings_of(spark, sf_dir).withColumn("f", following).agg(F.count_if(F.abs(F.col("f") - F.col("elo_post")) > 1e-9).alias("broken"), F.count("f").alias("links"))


@query("elo_asof_disagreement", ELO + ", r AS (SELECT e.*, b.dt FROM elo e JOIN bout b ON b.bout_id = e.bout), d AS (SELECT r.pre, (SELECT arg_max(x.post, x.seq) FROM r x WHERE x.ent = r.ent AND x.dt < r.dt) AS before FROM r) SELECT count(*) FILTER (WHERE abs(pre - coalesce(before, 1500)) > 1e-9)::BIGINT AS n FROM d")
def elo_asof_disagreement(spark, sf_dir):
    rows = ratings_of(spark, sf_dir)
    last = rows.groupBy("ent", "dt").agg(F.max_by("elo_post", "seq").alias("day_end"))
    before = last.withColumn("before", F.lag("day_end").over(W.Window.partitionBy("ent").orderBy("dt")))
    return rows.join(before, ["ent", "dt"]).agg(F.count_if(F.abs(F.col("elo_pre") - F.coalesce("before", F.lit(rating.START))) > 1e-9).alias("n"))


@query("elo_variance", ELO + " SELECT round(var_pop(pre), 4) AS v FROM elo WHERE bout >= 0")
def elo_variance(spark, sf_dir):
    return ratings_of(spark, sf_dir).agg(rnd(F.var_pop("elo_pre"), 4).alias("v"))


# ---- matchups ---------------------------------------------------------------

DIFFS = LOG + PAST + f""", f AS (SELECT bout_id, ent, n::DOUBLE AS n, CASE WHEN n = 0 THEN wr ELSE (wins + 5 * wr) / (n + 5) END AS w, {LANDED} AS landed, date_diff('day', last, p.dt)::DOUBLE AS gap {WITH_PRIOR}),
s AS (SELECT bout_id, CASE WHEN {COIN} THEN e1 ELSE e2 END AS a, CASE WHEN {COIN} THEN e2 ELSE e1 END AS b, (winner = CASE WHEN {COIN} THEN e1 ELSE e2 END)::INTEGER AS label FROM bout WHERE winner IS NOT NULL)"""


def training(spark, sf_dir):
    return matchup.training_rows(feature_table(spark, sf_dir), asof(spark, sf_dir))


@query("matchup_diffs", DIFFS + " SELECT s.bout_id, x.n - y.n AS n_diff, round(x.w - y.w, 6) AS win_rate_diff, round(coalesce(x.landed - y.landed, 0), 6) AS landed_diff, x.landed - y.landed IS NULL AS landed_missing, coalesce(x.gap - y.gap, 0) AS gap_diff, label FROM s JOIN f x ON x.bout_id = s.bout_id AND x.ent = s.a JOIN f y ON y.bout_id = s.bout_id AND y.ent = s.b")
def matchup_diffs(spark, sf_dir):
    return training(spark, sf_dir).select(
        "bout_id", F.col("n_fights_diff").alias("n_diff"), rnd(F.col("win_rate_diff")).alias("win_rate_diff"), rnd(F.col("landed_pm_diff")).alias("landed_diff"), F.col("landed_pm_diff_missing").alias("landed_missing"), F.col("days_since_last_diff").alias("gap_diff"), "label"
    )


@query("matchup_support", DIFFS + " SELECT CASE WHEN least(x.n, y.n) = 0 THEN 'none' WHEN least(x.n, y.n) < 3 THEN 'thin' ELSE 'ok' END AS support, count(*)::BIGINT AS n FROM s JOIN f x ON x.bout_id = s.bout_id AND x.ent = s.a JOIN f y ON y.bout_id = s.bout_id AND y.ent = s.b GROUP BY 1")
def matchup_support(spark, sf_dir):
    both = F.array("a_n_fights", "b_n_fights")
    return training(spark, sf_dir).groupBy(S.support_label(F.get(both, 0), F.get(both, 1)).alias("support")).agg(F.count(F.lit(1)).alias("n"))


ASKED = """, asked AS (SELECT s_suppkey AS key, 1 + s_suppkey * 7 % (SELECT max(p_partkey) FROM part) AS a, 1 + (s_suppkey * 13 + 5) % (SELECT max(p_partkey) FROM part) AS b,
  CASE s_suppkey % 6 WHEN 0 THEN 'UFC Lightweight Title Bout' WHEN 1 THEN 'Women''s Strawweight Bout' WHEN 2 THEN 'Catch Weight Bout' WHEN 3 THEN 'Light Heavyweight Bout' WHEN 4 THEN 'Bantamweight Bout' ELSE 'UFC Heavyweight Bout' END AS cls,
  DATE '1996-06-01' + (s_suppkey % 700)::INTEGER AS dt FROM supplier),
q AS (SELECT key, 'a' AS side, a AS ent, cls, dt FROM asked UNION ALL SELECT key, 'b', b, cls, dt FROM asked),
f0 AS (SELECT q.key, q.side, any_value(q.cls) AS cls, any_value(q.dt) AS dt, count(b.bout_id) AS n, coalesce(sum(b.won), 0) AS wins, {sums}, max(b.dt) AS last,
  list(b.won ORDER BY b.dt DESC, b.bout_id DESC) FILTER (WHERE b.bout_id IS NOT NULL) AS results FROM q LEFT JOIN elog b ON b.ent = q.ent AND b.dt < q.dt GROUP BY 1, 2),
r0 AS (SELECT q.key, q.side, arg_max(x.post, x.seq) AS elo FROM q LEFT JOIN (SELECT e.*, b.dt FROM elo e JOIN bout b ON b.bout_id = e.bout) x ON x.ent = q.ent AND x.dt < q.dt GROUP BY 1, 2),
g0 AS (SELECT f0.*, r0.elo, coalesce(c.wr, z.wr) AS w0 FROM f0 JOIN r0 USING (key, side) LEFT JOIN prior c ON c.cls = f0.cls CROSS JOIN (SELECT wr FROM prior WHERE cls IS NULL) z),
g AS (SELECT key, side, n::DOUBLE AS n, CASE WHEN n = 0 THEN w0 ELSE (wins + 5 * w0) / (n + 5) END AS w, CASE WHEN n = 0 THEN w0 ELSE list_avg(results[1:3]) END AS l3,
  {landed} AS landed, s_own_td / t_own_td * 900 AS td, s_own_ctrl / t_own_ctrl AS ctrl, date_diff('day', last, dt)::DOUBLE AS gap, coalesce(elo, 1500) AS elo,
  CASE WHEN n = 0 THEN 'none' WHEN n < 3 THEN 'thin' ELSE 'ok' END AS support FROM g0)""".replace("{sums}", SUMS).replace("{landed}", LANDED)
LIMITS = "CASE k.cls WHEN 'UFC Lightweight Title Bout' THEN 155 WHEN 'Women''s Strawweight Bout' THEN 115 WHEN 'Light Heavyweight Bout' THEN 205 WHEN 'Bantamweight Bout' THEN 135 WHEN 'UFC Heavyweight Bout' THEN 265 END"


def asked_matchups(spark, sf_dir):
    """Pairs of entities, a class and a day that nobody fought on."""
    k, top = F.col("s_suppkey"), table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("top"))
    classes = ["UFC Lightweight Title Bout", "Women's Strawweight Bout", "Catch Weight Bout", "Light Heavyweight Bout", "Bantamweight Bout", "UFC Heavyweight Bout"]
    rows = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(top))
    return rows.select(
        k.alias("key"), (1 + k * 7 % F.col("top")).alias("a"), (1 + (k * 13 + 5) % F.col("top")).alias("b"), F.get(F.array(*[F.lit(c) for c in classes]), (k % 6).cast("int")).alias("cls"),
        F.date_add(F.lit("1996-06-01").cast("date"), (k % 700).cast("int")).alias("dt"),
    )


@query("matchup_row", ELO.replace("WITH RECURSIVE ", "WITH RECURSIVE " + cte("entity").removeprefix("WITH ") + ",\n", 1) + PRIORS + ASKED + f""" SELECT k.key, x.n - y.n AS n_fights_diff, round(x.w - y.w, 6) AS win_rate_diff, round(x.l3 - y.l3, 6) AS last3_win_rate_diff, round(coalesce(x.landed - y.landed, 0), 6) AS landed_pm_diff, x.landed - y.landed IS NULL AS landed_pm_diff_missing,
  round(coalesce(x.td - y.td, 0), 6) AS td_landed_p15m_diff, round(coalesce(x.ctrl - y.ctrl, 0), 6) AS ctrl_frac_diff, coalesce(x.gap - y.gap, 0) AS days_since_last_diff, round(x.elo - y.elo, 6) AS elo_diff, x.support AS support_a, y.support AS support_b,
  coalesce(p.height - q.height, 0) AS height_diff, p.height - q.height IS NULL AS height_diff_missing, coalesce(abs(p.weight - {LIMITS}) - abs(q.weight - {LIMITS}), 0) AS cut_burden_diff, k.cls LIKE '%Title%' AS is_title_bout,
  CASE WHEN k.cls LIKE '%Title%' THEN 5.0::DOUBLE ELSE 3.0::DOUBLE END AS scheduled_rounds
  FROM asked k JOIN g x ON x.key = k.key AND x.side = 'a' JOIN g y ON y.key = k.key AND y.side = 'b' LEFT JOIN entity p ON p.id = k.a LEFT JOIN entity q ON q.id = k.b""")
def matchup_row(spark, sf_dir):
    """The feature row of any two entities, a class and a day, with ratings as of the day."""
    asked, log = checkpointed(asked_matchups(spark, sf_dir)), checkpointed(log_of(spark, sf_dir))
    probes = asked.select(F.explode(F.array("a", "b")).alias("ent"), "dt")
    rows = matchup.matchup_rows(asked, entities(spark, sf_dir), log, rating.as_of_days(rating.elo(log), probes))
    rounded = ("win_rate_diff", "last3_win_rate_diff", "landed_pm_diff", "td_landed_p15m_diff", "ctrl_frac_diff", "elo_diff")
    plain = ("n_fights_diff", "landed_pm_diff_missing", "days_since_last_diff", "support_a", "support_b", "height_diff", "height_diff_missing", "cut_burden_diff", "is_title_bout", "scheduled_rounds")
    return rows.select("key", *plain, *[rnd(F.col(c)).alias(c) for c in rounded])


@query("mirror_average", cte("bout") + " SELECT bout_id AS key, round((1 / (1 + exp(-(coalesce(q1, 25) - coalesce(q2, 25)) / 10 - 0.1)) + 1 - 1 / (1 + exp(-(coalesce(q2, 25) - coalesce(q1, 25)) / 10 - 0.1))) / 2, 6) AS p FROM bout")
def mirror_average(spark, sf_dir):
    a, b = F.coalesce("q1", F.lit(25.0)), F.coalesce("q2", F.lit(25.0))
    p = lambda x, y: 1 / (1 + F.exp(-(x - y) / 10 - 0.1))
    both = F.array(F.struct(F.lit(False).alias("mirrored"), p(a, b).alias("p")), F.struct(F.lit(True).alias("mirrored"), p(b, a).alias("p")))
    asked = bouts(spark, sf_dir).select(F.col("bout_id").alias("key"), F.inline(both))
    return matchup.mirror_average(asked).withColumn("p", rnd(F.col("p")))


@query("static_swap_negates", cte("entity", "bout") + " SELECT round(sum(a.weight - b.weight), 4) AS forward, round(sum(b.weight - a.weight), 4) + 0.0 AS backward FROM bout JOIN entity a ON a.id = e1 JOIN entity b ON b.id = e2")
def static_swap_negates(spark, sf_dir):
    known = entities(spark, sf_dir)
    both = matchup.with_bios(bouts(spark, sf_dir).withColumnsRenamed({"e1": "a", "e2": "b"}), known)
    return both.agg(rnd(F.sum(F.col("a_weight") - F.col("b_weight")), 4).alias("forward"), rnd(F.sum(F.col("b_weight") - F.col("a_weight")), 4).alias("backward"))
