"""Sides, differences, imputation, the matchup row and the model matrix.

Training and serving share one set of expressions: `static_columns` makes the
features of two bios, a class and a day for both, and `rolling_columns` the
differences of two as-of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bracketry.functions import scalars as S
from bracketry.operators import history, resolve

# Columns of a bio; differences that are imputed by zero with a flag; rounds when unknown; levels of the stance.
BIO = ("id", "weight", "reach", "height", "stance", "born")
DIFFS = ("reach", "height", "age", "weight", "cut_burden")
DEFAULT_ROUNDS, TITLE_ROUNDS = 3.0, 5.0
STANCES = ("Same", "Opposite", "Unknown")
# The model's columns by group, each in its order, and those that are pruned as collinear.
STATIC = ("reach_diff", "height_diff", "age_diff", "reach_diff_missing", "height_diff_missing", "age_diff_missing", "stance_same", "stance_unknown")
ROLLING = tuple(f"{name}_diff" for name in history.AS_OF)
CONTEXT = ("is_title_bout", "is_womens_bout", "is_nonstandard_weight", "scheduled_rounds", "scheduled_rounds_missing")
WEIGHT = ("weight_diff", "weight_diff_missing", "cut_burden_diff", "cut_burden_diff_missing")
PRUNED = ("win_rate_raw_diff", "elo_diff", "n_fights_diff", "total_fight_secs_diff")


def decisive(bouts: DataFrame) -> DataFrame:
    """Drops draws, no contests and unknown winners."""
    return bouts.where((F.col("winner") == F.col("e1")) | (F.col("winner") == F.col("e2")))


def a_is_first(key: Column, seed: str = "42") -> Column:
    """The coin that puts a bout's first side on side A; the same for the same key and seed everywhere."""
    return S.draw(seed, key) < 2**31


def imputed(name: str, value: Column) -> dict[str, Column]:
    return {f"{name}_diff": F.coalesce(value, F.lit(0.0)), f"{name}_diff_missing": value.isNull()}


def with_bios(bouts: DataFrame, bios: DataFrame) -> DataFrame:
    """Bouts with both sides' bios, prefixed a_ and b_: two one-to-one left joins on the id, pruned first."""
    out = bouts
    for side in ("a", "b"):
        own = bios.select(*[F.col(c).alias(f"{side}_{c}") for c in BIO if c in bios.columns])
        out = out.join(own, F.col(side) == F.col(f"{side}_id"), "left")
    return out


def static_columns(rounds: Column, rounds_missing: Column) -> dict[str, Column]:
    """The features of rows that have dt, cls and both sides' bios."""
    a, b = ({c: F.col(f"{side}_{c}") for c in BIO} for side in "ab")
    limit = S.class_lbs(F.col("cls"))
    age = lambda side: S.age_years(F.col("dt"), side["born"])
    return {
        **imputed("reach", a["reach"] - b["reach"]),
        **imputed("height", a["height"] - b["height"]),
        **imputed("age", age(a) - age(b)),
        **imputed("weight", a["weight"] - b["weight"]),
        **imputed("cut_burden", S.cut_burden_diff(a["weight"], b["weight"], limit)),
        "stance_matchup": S.stance_matchup(a["stance"], b["stance"]),
        "is_title_bout": S.is_title_bout(F.col("cls")),
        "is_womens_bout": S.is_womens_bout(F.col("cls")),
        "is_nonstandard_weight": S.is_nonstandard_weight(F.col("cls")),
        "scheduled_rounds": rounds,
        "scheduled_rounds_missing": rounds_missing,
    }


def feature_table(bouts: DataFrame, bios: DataFrame, seed: str = "42") -> DataFrame:
    """One row for each decisive bout: ids and outcome, sides drawn, A minus B differences with flags, context and label."""
    coin = a_is_first(F.col("bout_id"), seed)
    sided = decisive(bouts).withColumns({"a": F.when(coin, F.col("e1")).otherwise(F.col("e2")), "b": F.when(coin, F.col("e2")).otherwise(F.col("e1")), "a_is_first": coin})
    rounds = S.scheduled_rounds(F.col("layout"))
    columns = static_columns(F.coalesce(rounds, F.lit(DEFAULT_ROUNDS)), rounds.isNull())
    columns["label"] = (F.col("winner") == F.col("a")).cast("int")
    return with_bios(sided, bios).withColumns(columns).select("bout_id", "dt", "cls", "a", "b", "a_is_first", "method", "end_round", *columns)


def build(bouts: DataFrame, bios: DataFrame, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """The feature table of bouts known by names (bout_id, dt, cls, n1, n2, wn, method, end_round, layout), and a row of counts: raw, resolved, final.

    Each distinct name and class is resolved to a profile once; bouts with an
    unresolved side go, then those whose winner is neither side's name.
    """
    limit = S.class_lbs(F.col("cls"))
    named = bouts.withColumn("limit", limit)
    asked = named.select(F.explode(F.array("n1", "n2")).alias("name"), "limit").distinct()
    ids = resolve.resolve(asked, bios).select(F.col("name").alias("of"), F.col("limit").alias("at"), "id")
    for side in (1, 2):
        own = ids.withColumnRenamed("id", f"e{side}")
        named = named.join(own, (F.col(f"n{side}") == F.col("of")) & F.col("limit").eqNullSafe(F.col("at")), "left").drop("of", "at")
    resolved = F.col("e1").isNotNull() & F.col("e2").isNotNull()
    decided = F.coalesce(F.col("wn").isin(F.col("n1"), F.col("n2")), F.lit(False))
    counts = named.agg(F.count(F.lit(1)).alias("raw"), F.count_if(resolved).alias("resolved"), F.count_if(resolved & decided).alias("final"))
    # both sides may have the winner's name: the label is then what the names say
    won_by = F.when(a_is_first(F.col("bout_id"), seed), F.col("n1")).otherwise(F.col("n2")) == F.col("wn")
    rows = named.where(resolved & decided).withColumns({"winner": F.col("e1"), "label_by_name": won_by.cast("int")})
    table_ = feature_table(rows, bios, seed).drop("label").join(rows.select("bout_id", F.col("label_by_name").alias("label")), "bout_id")
    return table_, counts


def rolling_columns(a: Column, b: Column) -> dict[str, Column]:
    """The A minus B differences of two structs of as-of features, imputed and flagged, and both sides' support."""
    out = {k: v for n in history.AS_OF for k, v in imputed(n, a[n].cast("double") - b[n].cast("double")).items()}
    return {**out, "support_a": F.coalesce(a["support"], F.lit("none")), "support_b": F.coalesce(b["support"], F.lit("none")), "a_n_fights": a["n_fights"], "b_n_fights": b["n_fights"]}


def training_rows(features: DataFrame, as_of: DataFrame) -> DataFrame:
    """The feature table with the rolling columns. A bout's two as-of rows are first brought together, so the table is joined once."""
    row = F.struct("ent", "support", *history.AS_OF)
    both = as_of.groupBy("bout_id").agg(F.min(row).alias("x"), F.max(row).alias("y"))
    rows = features.join(both, "bout_id")
    first = F.col("a") == F.col("x.ent")
    sided = rows.withColumns({"x": F.when(first, F.col("x")).otherwise(F.col("y")), "y": F.when(first, F.col("y")).otherwise(F.col("x"))})
    return sided.withColumns(rolling_columns(F.col("x"), F.col("y"))).drop("x", "y")


def matchup_rows(asked: DataFrame, bios: DataFrame, log: DataFrame | None = None, ratings: DataFrame | None = None) -> DataFrame:
    """The feature rows of asked (key, a, b, cls, dt and, where known, rounds): A against B in a class, as known strictly before a day.

    Rounds default to five for a title bout, otherwise three, and never count as
    missing. With a log come the rolling columns; ratings as in history.features_at
    (by ent and dt, or by key and ent). Sides stay as they are given.
    """
    title = S.is_title_bout(F.col("cls"))
    default = F.when(title, F.lit(TITLE_ROUNDS)).otherwise(F.lit(DEFAULT_ROUNDS))
    rounds = F.coalesce(F.col("rounds"), default) if "rounds" in asked.columns else default
    columns = static_columns(rounds, F.lit(False))
    out = with_bios(asked, bios).withColumns(columns).select("key", "a", "b", "cls", "dt", *columns)
    if log is None:
        return out
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("ent")) for s in "ab"])
    rows = history.features_at(log, asked.select("key", "cls", "dt", F.inline(sides)), ratings)
    row = F.struct("support", *history.AS_OF)
    both = rows.groupBy("key").agg(*[F.max(F.when(F.col("side") == s, row)).alias(name) for s, name in (("a", "x"), ("b", "y"))])
    return out.join(both, "key", "left").withColumns(rolling_columns(F.col("x"), F.col("y"))).drop("x", "y")


def infer_class(asked: DataFrame, log: DataFrame) -> DataFrame:
    """asked (key, a, b) with cls: the class of A's latest bout, else of B's, else missing."""
    latest = log.groupBy("ent").agg(F.max_by("cls", F.struct("dt", "bout_id")).alias("latest"))
    out = asked
    for side in "ab":
        out = out.join(latest.select(F.col("ent").alias(side), F.col("latest").alias(f"latest_{side}")), side, "left")
    return out.select(*asked.columns, F.coalesce("latest_a", "latest_b").alias("cls"))


def matrix(features: DataFrame, names: tuple[str, ...] = STATIC, also: tuple[str, ...] = ()) -> DataFrame:
    """(bout_id, x array<double> in the order of names, y, and columns that also names); an unknown stance raises, and so does a name without a column."""
    stance = F.col("stance_matchup")
    made = {"stance_same": stance == "Same", "stance_unknown": stance == "Unknown"}
    if missing := [n for n in names if n not in made and n not in features.columns]:
        raise ValueError(f"no such feature: {', '.join(missing)}")
    x = F.array(*[made.get(n, F.col(n)).cast("double") for n in names]).cast("array<double>")
    bad = F.raise_error(F.concat(F.lit("unknown stance: "), F.coalesce(stance, F.lit("none"))))
    return features.select("bout_id", F.when(F.coalesce(stance.isin(*STANCES), F.lit(False)), x).otherwise(bad).alias("x"), F.col("label").alias("y"), *also)


def feature_names(rolling: bool = False, context: bool = False, weight: bool = False, pruned: bool = False) -> list[str]:
    """The model's columns in the one order of training and serving."""
    out = [*STATIC, *(ROLLING if rolling else ()), *(CONTEXT if context else ()), *(WEIGHT if weight else ())]
    return [n for n in out if not (pruned and n in PRUNED)]


def mirror_average(scored: DataFrame) -> DataFrame:
    """(key, p) from rows (key, mirrored, p): the mean of p as asked and of 1 - p with sides swapped."""
    return scored.groupBy("key").agg(F.avg(F.when(F.col("mirrored"), 1 - F.col("p")).otherwise(F.col("p"))).alias("p"))
