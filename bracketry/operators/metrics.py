"""Scores of probabilities, with intervals. Metrics are aggregate Columns over (y, p), weighted by m."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bracketry.operators import resample

# Fixed value: probabilities are clipped by this for the logarithm.
EPS = 1e-15


def _mean(value: Column, weight: Column | None) -> Column:
    return F.avg(value) if weight is None else F.sum(value * weight) / F.sum(weight)


def right_of(y: Column, p: Column) -> Column:
    return ((p > 0.5) == (y == 1)).cast("double")


def loss_of(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return -F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))


def square_of(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def accuracy(y: Column, p: Column, m: Column | None = None) -> Column:
    return _mean(right_of(y, p), m)


def log_loss(y: Column, p: Column, m: Column | None = None) -> Column:
    return _mean(loss_of(y, p), m)


def brier(y: Column, p: Column, m: Column | None = None) -> Column:
    return _mean(square_of(y, p), m)


#: name, metric, whether lower is better.
METRICS: tuple[tuple[str, Callable[..., Column], bool], ...] = (("accuracy", accuracy, False), ("log_loss", log_loss, True), ("brier", brier, True))
#: What each metric is the mean of.
OF_ROW: dict[str, Callable[[Column, Column], Column]] = {"accuracy": right_of, "log_loss": loss_of, "brier": square_of}


def scores(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(*[f(F.col("y"), F.col("p")).alias(n) for n, f, _ in METRICS])


def reference_scores(rows: DataFrame) -> DataFrame:
    """The scores of the constant base rate."""
    base = rows.agg(F.avg("y").alias("p"))
    return rows.select("y").crossJoin(F.broadcast(base)).transform(scores)


def with_rows(draws: DataFrame, rows: DataFrame) -> DataFrame:
    """Draws joined with what they draw. The draws are many times the rows, which the planner can't see: rows are hashed, part by part, and draws never sent whole."""
    return draws.join(rows.hint("shuffle_hash"), "row_id")


def intervals(rows: DataFrame, draws: DataFrame, value: Callable[[Column | None], Column], alpha: float = 0.05) -> DataFrame:
    """(point, low, high) of an aggregate under resampling. draws: (b, row_id), a row for each draw, or with m how often; value: the aggregate given weights."""
    point = rows.agg(value(None).alias("point"))
    draws = draws if "m" in draws.columns else draws.withColumn("m", F.lit(1))
    boot = with_rows(draws, rows).groupBy("b").agg(value(F.col("m")).alias("v"))
    bounds = boot.agg(F.percentile("v", F.lit(alpha / 2)).alias("low"), F.percentile("v", F.lit(1 - alpha / 2)).alias("high"))
    return point.crossJoin(bounds)


def mean_intervals(rows: DataFrame, n: int, value: Column, replicates: int, alpha: float = 0.05) -> DataFrame:
    """intervals of the mean of a value of each row (row_id 0 .. n - 1), its draws worked out where they are used: none is sent."""
    point = rows.agg(F.avg(value).alias("point"))
    boot = resample.means(rows.select("row_id", value.alias("v")), n, ["v"], replicates)
    return point.crossJoin(boot.agg(F.percentile("v", F.lit(alpha / 2)).alias("low"), F.percentile("v", F.lit(1 - alpha / 2)).alias("high")))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Bins [low, high) of equal width, the last closed; empty bins are left out."""
    edges = [i / bins for i in range(bins)]
    place = F.aggregate(F.array(*[F.lit(e) for e in edges]), F.lit(-1), lambda a, e: a + (F.col("p") >= e).cast("int"))
    return rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("mean_y"))


def confusion(rows: DataFrame) -> DataFrame:
    hit = F.col("p") > 0.5
    return rows.agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 0)).alias("tn"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"))


def majority_vote(votes: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_id, vote) from (tree_id, row_id, vote): ties are 0, rows without a vote -1."""
    return rows.select("row_id").join(votes.groupBy("row_id").agg(F.when(2 * F.sum("vote") > F.count(F.lit(1)), 1).otherwise(0).alias("vote")), "row_id", "left").withColumn("vote", F.coalesce("vote", F.lit(-1)))


def soft_vote(probas: DataFrame) -> DataFrame:
    return probas.groupBy("row_id").agg(F.avg("proba").alias("p"))


def paired_differences(rows: DataFrame, draws: DataFrame | int, models: list[str], alpha: float = 0.05) -> DataFrame:
    """(model, metric, score, delta, low, high, verdict) of each model against the first, on the same draws. rows: (row_id, y, models); draws: (b, row_id), or the number of replicates, which are then worked out where they are used."""
    from bracketry.functions.scalars import verdict

    base, rest = models[0], models[1:]
    name = lambda model, metric: f"{models.index(model)}_{metric}"
    y = F.col("y")
    value = lambda model, f: f(y, F.col(model))
    scored = rows.agg(*[value(m, f).alias(name(m, n)) for m in models for n, f, _ in METRICS])
    if isinstance(draws, int):
        apart = [(OF_ROW[n](y, F.col(m)) - OF_ROW[n](y, F.col(base))).alias(name(m, n)) for m in rest for n, _, _ in METRICS]
        boot = resample.means(rows.select("row_id", *apart), rows.count(), [name(m, n) for m in rest for n, _, _ in METRICS], draws)
    else:
        boot = with_rows(draws, rows).groupBy("b").agg(*[(value(m, f) - value(base, f)).alias(name(m, n)) for m in rest for n, f, _ in METRICS])
    bounds = boot.agg(*[F.struct(F.percentile(name(m, n), F.lit(alpha / 2)).alias("low"), F.percentile(name(m, n), F.lit(1 - alpha / 2)).alias("high")).alias(f"ci_{name(m, n)}") for m in rest for n, _, _ in METRICS])
    both = scored.crossJoin(bounds)
    out = []
    for m in models:
        for n, _, lower in METRICS:
            delta = F.col(name(m, n)) - F.col(name(base, n))
            ci = F.col(f"ci_{name(m, n)}") if m != base else F.struct(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
            said = verdict(delta, ci["low"], ci["high"], F.lit(lower)) if m != base else F.lit(None).cast("string")
            out.append(F.struct(F.lit(m).alias("model"), F.lit(n).alias("metric"), F.col(name(m, n)).alias("score"), (delta if m != base else F.lit(None).cast("double")).alias("delta"), ci["low"].alias("low"), ci["high"].alias("high"), said.alias("verdict")))
    return both.select(F.inline(F.array(*out)))
