"""Profiles of tables, and rules that new rows must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, share) of the columns that have any missing value: one pass over the table."""
    n = F.count(F.lit(1))
    each = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing"), (F.count_if(F.col(c).isNull()) / n).alias("share")) for c in columns]
    return rows.agg(F.array(*each).alias("a")).select(F.inline("a")).where("missing > 0")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg((F.sum("n") - F.count(F.lit(1))).alias("duplicates"), F.count_if(F.col("n") > 1).alias("repeated"))


def violations(new: DataFrame, old: DataFrame) -> DataFrame:
    """(rule, n): rows of new bouts that break each rule of an append."""
    keys = new.groupBy("bout_id").agg(F.count(F.lit(1)).alias("n"))
    last = old.agg(F.max("dt").alias("last"))
    rules = [
        keys.agg(F.sum(F.col("n") - 1).alias("n")).withColumn("rule", F.lit("duplicate key")),
        new.join(old.select("bout_id"), "bout_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit("already present")),
        new.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("dt") <= F.col("last")).alias("n")).withColumn("rule", F.lit("not after the last date")),
        new.agg(F.count_if(F.col("winner").isNotNull() & (F.col("winner") != F.col("e1")) & (F.col("winner") != F.col("e2"))).alias("n")).withColumn("rule", F.lit("winner is no side")),
        new.agg(F.count_if(F.col("dt").isNull() | F.col("e1").isNull() | F.col("e2").isNull()).alias("n")).withColumn("rule", F.lit("missing field")),
    ]
    out = rules[0].select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    for r in rules[1:]:
        out = out.unionByName(r.select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    return out


def append(new: DataFrame, old: DataFrame, path: str, dry_run: bool = True) -> list[str]:
    """Write old and new rows to a new place unless a rule is broken; returns the broken rules. A dry run writes nothing."""
    broken = [f"{r.rule}: {r.n}" for r in violations(new, old).where("n > 0").collect()]
    if not broken and not dry_run:
        old.unionByName(new, allowMissingColumns=True).write.mode("errorifexists").parquet(path)
    return broken


def extrapolation(train: DataFrame, asked: DataFrame, names: list[str]) -> DataFrame:
    """(row_id, feature, value, p99): values beyond the 99th percentile of the training rows' sizes, zeros included."""
    limits = train.agg(*[F.percentile(F.abs(n), F.lit(0.99)).alias(n) for n in names]).select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("p99")) for n in names])))
    long = asked.select("row_id", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])))
    return long.join(F.broadcast(limits), "feature").where((F.abs("value") > F.col("p99")) & (F.col("value") != 0))


def same(a: Column, b: Column) -> Column:
    """Equality for which two missing values are equal, as are two that aren't numbers."""
    return a.eqNullSafe(b)
