"""Elo: the sequential sweep, and lookups in its table.

The sweep depends on order across all entities, so it can't be cut by entity: one
task reads the bouts in order, in streamed batches, and holds one number for each
entity. It is the one sequential operator of the engine, and only narrow rows
(five numbers a bout) reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

# Step, start and scale of the ratings.
K, START, SCALE = 24.0, 1500.0, 400.0


def expected(a, b):
    return 1 / (1 + 10 ** ((b - a) / SCALE))


def update(a: Column, b: Column, a_won: Column, k: float = K) -> tuple[Column, Column]:
    """Both ratings after one bout; what one gains the other loses."""
    change = k * (a_won - 1 / (1 + F.pow(F.lit(10.0), (b - a) / SCALE)))
    return a + change, b - change


def elo(log: DataFrame, k: float = K, initial: float = START) -> DataFrame:
    """(bout_id, ent, dt, seq, elo_pre, elo_post), two rows a bout; the rating before is recorded before the bout is applied.

    One group goes through one Python worker in streamed batches: ratings are
    sequential by nature. The worker holds one float an entity.
    """
    first = log.groupBy("bout_id").agg(F.min(F.struct("ent", "opp", "dt", "won")).alias("x")).select("bout_id", "x.*")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratings: dict[int, float] = {}
        known, seq = ratings.get, 0
        for batch in batches:
            pre, post = [], []
            for ent, opp, won in zip(*(batch.column(c).to_pylist() for c in ("ent", "opp", "won")), strict=True):
                a, b = known(ent, initial), known(opp, initial)
                change = k * (won - expected(a, b))
                ratings[ent], ratings[opp] = a + change, b - change
                pre += (a, b)
                post += (a + change, b - change)
            twice = np.repeat(np.arange(batch.num_rows), 2)
            sides = np.stack([batch.column(c).to_numpy() for c in ("ent", "opp")], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([batch.column("bout_id").take(twice), pa.array(sides), batch.column("dt").take(twice), pa.array(twice + seq), pa.array(pre, pa.float64()), pa.array(post, pa.float64())], ["bout_id", "ent", "dt", "seq", "elo_pre", "elo_post"])
            seq += batch.num_rows

    # one task sorts and sweeps; what comes before it keeps its own tasks
    ordered = first.repartition(1).sortWithinPartitions("dt", "ent", "bout_id")
    return ordered.mapInArrow(sweep, "bout_id long, ent long, dt date, seq long, elo_pre double, elo_post double")


def latest(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("ent").agg(F.max_by("elo_post", "seq").alias("elo"))


def as_of(ratings: DataFrame, day: str) -> DataFrame:
    """Each entity's rating from bouts strictly before a day."""
    return latest(ratings.where(F.col("dt") < F.lit(day).cast("date")))


def as_of_days(ratings: DataFrame, asked: DataFrame) -> DataFrame:
    """(ent, dt, elo_pre): the rating of each asked entity and day from bouts strictly before the day; missing before its first. Days of bouts and asked days go through one window."""
    ends = ratings.groupBy("ent", "dt").agg(F.max_by("elo_post", "seq").alias("end")).withColumn("is_asked", F.lit(False))
    days = ends.unionByName(asked.select("ent", "dt").distinct().withColumns({"end": F.lit(None).cast("double"), "is_asked": F.lit(True)}))
    days = days.groupBy("ent", "dt").agg(F.max("end").alias("end"), F.max("is_asked").alias("is_asked"))
    before = W.Window.partitionBy("ent").orderBy("dt").rowsBetween(W.Window.unboundedPreceding, -1)
    return days.withColumn("elo_pre", F.last("end", ignorenulls=True).over(before)).where("is_asked").select("ent", "dt", "elo_pre")
