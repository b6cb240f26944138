"""Splits and folds on date boundaries, and bootstrap draws."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bracketry.functions.scalars import LOW_BITS, folded_down, scrambling


def boundary(rows: DataFrame, test_share: float = 0.18) -> DataFrame:
    """One row (boundary): the date at the position where the test part begins.

    Rows are counted by date first, so the running count is over dates, of which
    there are few whatever the number of rows.
    """
    from pyspark.sql import window as W

    days = rows.where(F.col("dt").isNotNull()).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.Window.orderBy("dt"))
    total = F.sum("n").over(W.Window.partitionBy())
    place = F.least(F.greatest(F.bround(total * (1 - test_share)), F.lit(1.0)), total - 1)
    return days.withColumns({"upto": upto, "place": place}).where(F.col("upto") > F.col("place")).agg(F.min("dt").alias("boundary"))


def boundary_of(days: list[tuple[float, int]], test_share: float = 0.18) -> float | None:
    """boundary of (day, rows) by rising day; none without rows."""
    total = sum(n for _, n in days)
    place, upto = min(max(round(total * (1 - test_share)), 1), total - 1), 0
    for day, n in days:
        upto += n
        if upto > place:
            return day
    return None


def chronological(rows: DataFrame, test_share: float = 0.18) -> DataFrame:
    """rows with is_test; a date is never on both sides, rows without a date are for training."""
    return rows.crossJoin(F.broadcast(boundary(rows, test_share))).withColumn("is_test", F.coalesce(F.col("dt") >= F.col("boundary"), F.lit(False)))


def cut_places(n: int, folds: int = 8, least_share: float = 0.5) -> list[int]:
    """Positions among n distinct dates at which folds begin, and the end."""
    start = math.ceil(least_share * n)
    if n < 2 or start > n - 1:
        return []
    return sorted({int(start + (n - 1 - start) * i / folds) for i in range(folds + 1)})


def fold_bounds(dates: list, folds: int = 8, least_share: float = 0.5) -> list[tuple]:
    """(fold, first of the test part, first of the next fold or none) of rising dates."""
    at = cut_places(len(dates), folds, least_share)
    return [(i, dates[a], dates[b] if i < len(at) - 2 else None) for i, (a, b) in enumerate(zip(at, at[1:], strict=False))]


def walk_forward(rows: DataFrame, folds: int = 8, least_share: float = 0.5) -> DataFrame:
    """(fold, role, rows' columns): training is all before a fold's first date, testing the dates up to the next fold; the last runs to the end."""
    cuts = fold_bounds([r[0] for r in rows.select("dt").where(F.col("dt").isNotNull()).distinct().orderBy("dt").toLocalIterator()], folds, least_share)
    bounds = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(a).alias("start"), F.lit(b).cast("date").alias("stop")) for i, a, b in cuts]) if cuts else F.array().cast("array<struct<fold:int,start:date,stop:date>>")
    spread = rows.where(F.col("dt").isNotNull()).select("*", F.explode(bounds).alias("f"))
    role = F.when(F.col("dt") < F.col("f.start"), "train").when(F.col("f.stop").isNull() | (F.col("dt") < F.col("f.stop")), "test")
    return spread.withColumns({"fold": F.col("f.fold"), "role": role}).where("role IS NOT NULL").drop("f")


def numbered(rows: DataFrame, key: str, width: int = 4096, by: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with row_id 0 .. n - 1 in the order of an integer key and then of ties, anew for each value of by: a running sum over ranges of the key, and a number within each."""
    from pyspark.sql import window as W

    parts = rows.withColumn("__part", F.coalesce(F.floor(F.col(key) / width), F.lit(-(1 << 62))))
    before = W.Window.partitionBy(*by).orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = parts.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n")).select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(W.Window.partitionBy(*by, "__part").orderBy(key, *ties)) - 1
    return parts.join(sums, [*by, "__part"]).withColumn("row_id", (F.col("__before") + inner).cast("long")).drop("__part", "__before")


def drawn(rows: DataFrame, n: int, replicates: int, seed: int = 7) -> DataFrame:
    """(b, row_id): the row of 0 .. n - 1 that each of n draws of a replicate takes, by plain arithmetic on seed, replicate and place. Only the places are shuffled, to spread the work."""
    places = rows.select(F.col("row_id").cast("bigint").alias("place")).repartition(max(rows.sparkSession.sparkContext.defaultParallelism, 1))
    x = places.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    # a column for each step: an expression of all steps would repeat each step twice in the next
    x = x.withColumn("x", (F.col("b").cast("bigint") * F.lit(2654435761) + F.lit(seed)).bitwiseAND(F.lit(LOW_BITS)))
    for last in (False, True):
        for _ in range(2):
            x = x.withColumn("x", scrambling(F.col("x")))
        x = x.withColumn("x", folded_down(F.col("x")))
        if not last:
            x = x.withColumn("x", F.col("x").bitwiseXOR(F.col("place").bitwiseAND(F.lit(LOW_BITS))))
    # never missing, and said so: a join would otherwise test all the steps once more
    return x.select("b", F.coalesce(F.pmod("x", F.lit(n)), F.lit(0)).alias("row_id"))


def bootstrap(rows: DataFrame, n: int, replicates: int, seed: int = 7) -> DataFrame:
    """(b, row_id, m): how often replicate b draws each row of 0 .. n - 1; rows it never draws are absent (out of bag)."""
    return drawn(rows, n, replicates, seed).groupBy("b", "row_id").agg(F.count(F.lit(1)).alias("m"))


def out_of_bag(rows: DataFrame, drawn: DataFrame, replicates: int) -> DataFrame:
    every = rows.select("row_id").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return every.join(drawn.select("b", "row_id"), ["b", "row_id"], "left_anti")
