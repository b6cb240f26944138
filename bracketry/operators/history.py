"""Event log, priors and features known strictly before a bout.

As-of features are running sums over days, not rows: an entity's bouts of a day
are summed first (map-side), so a window holds one row a day however many bouts an
entity has, and same-day bouts never see each other. The sums are joined back to
the bouts by (entity, day), a join that adaptive execution may split. Days that are
asked for without a bout join the same window as empty rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from bracketry.functions.scalars import shrink, support_label

# Results that count as finishes; a debutant's rating; few bouts.
FINISHES, START_RATING, THIN = ("KO/TKO", "Submission", "TKO - Doctor's Stoppage"), 1500.0, 3
# Statistics that a log may have, and the rates: name, column, seconds that it is given for.
STATS = ("q", "td", "sub", "ctrl")
RATES = (("landed_pm", "own_q", 60.0), ("absorbed_pm", "opp_q", 60.0), ("td_landed_p15m", "own_td", 900.0), ("sub_att_p15m", "own_sub", 900.0), ("ctrl_frac", "own_ctrl", 1.0))
# The as-of features in their order.
AS_OF = ("n_fights", "win_rate", "win_rate_raw", "last3_win_rate", "finish_rate", "finished_rate", *[name for name, _, _ in RATES], "days_since_last", "total_fight_secs", "elo")


def available_stats(bouts: DataFrame, wanted: tuple[str, ...] = STATS) -> tuple[list[str], list[str]]:
    """Which of the wanted statistics both sides of the bouts have, and which are missing."""
    there = [s for s in wanted if f"{s}1" in bouts.columns and f"{s}2" in bouts.columns]
    return there, [s for s in wanted if s not in there]


def with_stats(bouts: DataFrame, stats: DataFrame, key: str = "bout_id") -> DataFrame:
    """Bouts left-joined with their statistics, one row of each; a key that stands twice on either side raises."""
    once = lambda df, side: df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*[c for c in df.columns if c != key])).alias("row")).select(
        key, F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit(f"duplicate key in the {side}: "), F.col(key).cast("string")))).otherwise(F.col("row")).alias(side)
    )
    return once(bouts, "bouts").join(once(stats, "statistics"), key, "left").select(key, "bouts.*", "statistics.*")


def event_log(bouts: DataFrame) -> DataFrame:
    """Two rows for each decisive bout, one from each side's view, with those of STATS that the bouts have."""
    decisive = bouts.where((F.col("winner") == F.col("e1")) | (F.col("winner") == F.col("e2")))

    def side(me: int, other: int) -> Column:
        return F.struct(
            F.col(f"e{me}").alias("ent"), F.col(f"e{other}").alias("opp"), "bout_id", "dt", "cls",
            (F.col("winner") == F.col(f"e{me}")).cast("int").alias("won"),
            F.coalesce(F.col("method").isin(*FINISHES), F.lit(False)).alias("is_finish"),
            "secs", *[c for s in available_stats(bouts)[0] for c in (F.col(f"{s}{me}").alias(f"own_{s}"), F.col(f"{s}{other}").alias(f"opp_{s}"))],
        )

    return decisive.select(F.inline(F.array(side(1, 2), side(2, 1))))


def priors(log: DataFrame) -> DataFrame:
    """Win, finish and finished rates of each class and of all (cls null, is_global), in one pass of grouping sets."""
    rate = lambda x, when=None: F.coalesce(F.avg(F.when(when, x) if when is not None else x), F.lit(0.5))
    finish = F.col("is_finish").cast("double")
    rates = [rate(F.col("won").cast("double")).alias("win_rate"), rate(finish, F.col("won") == 1).alias("finish_rate"), rate(finish, F.col("won") == 0).alias("finished_rate")]
    narrow = log.select("cls", "won", "is_finish")
    found = narrow.groupingSets([["cls"], []], "cls").agg(*rates, (F.grouping("cls") == 1).alias("is_global"))
    # a missing class has no prior of its own
    return found.where(F.col("cls").isNotNull() | F.col("is_global")).select("cls", "win_rate", "finish_rate", "finished_rate", "is_global")


def _matched(stat: str) -> Column:
    return F.col(stat).isNotNull() & F.col("secs").isNotNull() & (F.col("secs") > 0)


def _rated(log: DataFrame) -> list[str]:
    return [c for _, c, _ in RATES if c in log.columns]


def daily(log: DataFrame) -> DataFrame:
    """One row for each entity and day: what the day adds, and its last results."""
    win, loss = F.col("won") == 1, F.col("won") == 0
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = [x for c in _rated(log) for x in (F.sum(F.when(_matched(c), F.col(c))).alias(f"s_{c}"), F.sum(F.when(_matched(c), F.col("secs"))).alias(f"t_{c}"))]
    return log.where(F.col("dt").isNotNull()).groupBy("ent", "dt").agg(
        F.count(F.lit(1)).alias("n"), F.sum("won").alias("wins"), count(win & F.col("is_finish")).alias("win_finishes"), count(loss & F.col("is_finish")).alias("loss_finishes"),
        *sums, F.sum("secs").alias("total_secs"),
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("bout_id")).alias("o"), "won"))), 1, 3).alias("recent"),
    )


def as_of(log: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(ent, dt, ...): for each entity and day it has, or for those of asked too, sums over the days strictly before."""
    day = F.datediff("dt", F.lit("1970-01-01"))
    by_day = W.Window.partitionBy("ent").orderBy("day")
    before = by_day.rowsBetween(W.Window.unboundedPreceding, -1)
    total = lambda c: F.sum(c).over(before)
    # the last three results up to a day's end
    newest = F.slice(F.flatten(F.reverse(F.collect_list("recent").over(by_day.rowsBetween(-2, 0)))), 1, 3)
    days = daily(log).withColumn("day", day).withColumn("recent", F.transform(newest, lambda x: x["won"]))
    if asked is not None:
        # at most one row of a day has values; the others only ask
        days = days.unionByName(asked.select("ent", "dt").where("dt IS NOT NULL").withColumn("day", day), allowMissingColumns=True)
        days = days.groupBy("ent", "dt", "day").agg(*[F.max(c).alias(c) for c in days.columns if c not in ("ent", "dt", "day")])
    zero = lambda c: F.coalesce(total(c), F.lit(0)).alias(c)
    return days.select(
        "ent", "dt", zero("n"), zero("wins"), zero("win_finishes"), zero("loss_finishes"),
        *[total(f"{k}_{c}").alias(f"{k}_{c}") for c in _rated(log) for k in "st"],
        F.when(total("n") > 0, F.coalesce(total("total_secs"), F.lit(0.0))).alias("total_fight_secs"),
        F.datediff("dt", F.max(F.when(F.col("n").isNotNull(), F.col("dt"))).over(before)).alias("days_since_last"),
        F.coalesce(F.last("recent", ignorenulls=True).over(before), F.array().cast("array<int>")).alias("latest"),
    )


def rate(stat: str, per: float) -> Column:
    return F.when(F.col(f"t_{stat}") > 0, F.col(f"s_{stat}") / F.col(f"t_{stat}") * per)


def features(log: DataFrame, ratings: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """The log with each row's as-of features. ratings: (bout_id, ent, elo_pre); known as in features_at."""
    return features_at(log, None, ratings, known)


def features_at(log: DataFrame, asked: DataFrame | None, ratings: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """The rows of asked (ent, dt, cls, ...), or of the log itself, with their as-of features.

    ratings has elo_pre and any of the rows' columns to join by, such as bout_id and ent
    (the rating that a bout began with) or ent and dt (the rating before a day);
    without a rating a row has that of a debutant. known: the priors of the whole log,
    where log has all rows of some entities only. A rate whose statistic the log lacks is missing.
    """
    known = priors(log) if known is None else known
    # one row, for an empty log too
    world = F.broadcast(known.where("is_global").agg(*[F.coalesce(F.max(c), F.lit(0.5)).alias(f"g_{c}") for c in ("win_rate", "finish_rate", "finished_rate")]))
    # a row for each class, summed before: as bounded as the list of classes; adaptive execution broadcasts it by its size
    own = known.where("NOT is_global").select("cls", *[F.col(c).alias(f"c_{c}") for c in ("win_rate", "finish_rate", "finished_rate")])
    rows = (log if asked is None else asked).join(as_of(log, asked), ["ent", "dt"]).join(own, "cls", "left").crossJoin(world)
    prior = lambda c: F.coalesce(f"c_{c}", f"g_{c}")
    debut, losses = F.col("n") == 0, F.col("n") - F.col("wins")
    there = _rated(log)
    rows = rows.withColumns(
        {
            "n_fights": F.col("n"),
            "win_rate_raw": F.when(debut, prior("win_rate")).otherwise(F.col("wins") / F.col("n")),
            "win_rate": F.when(debut, prior("win_rate")).otherwise(shrink(F.col("wins"), F.col("n"), prior("win_rate"))),
            "last3_win_rate": F.when(debut, prior("win_rate")).otherwise(F.aggregate("latest", F.lit(0), lambda a, x: a + x) / F.size("latest")),
            "finish_rate": F.when(debut, prior("finish_rate")).otherwise(shrink(F.col("win_finishes"), F.col("wins"), prior("finish_rate"))),
            "finished_rate": F.when(debut, prior("finished_rate")).otherwise(shrink(F.col("loss_finishes"), losses, prior("finished_rate"))),
            **{name: rate(c, per) if c in there else F.lit(None).cast("double") for name, c, per in RATES},
            "support": support_label(F.col("n"), F.col("n"), THIN),
        }
    )
    if ratings is None:
        return rows.withColumn("elo", F.lit(START_RATING))
    keys = [c for c in ratings.columns if c != "elo_pre"]
    return rows.join(ratings, keys, "left").withColumn("elo", F.coalesce("elo_pre", F.lit(START_RATING)))
