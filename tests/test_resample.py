"""Draws that are worked out where they are used."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bracketry.catalogue import QUERIES
from bracketry.operators import metrics, resample, splits


def no_draw_is_sent(*_, **__):
    raise AssertionError("draws are sent")


@pytest.mark.parametrize("n", [1, 2000, 70001])
def test_draws_are_those_of_the_sql(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    want = {}
    for r in splits.bootstrap(rows, n, 3).collect():
        want[r.b, r.row_id] = r.m
    for b in range(3):
        own = np.concatenate([resample.draws(b, a, min(n, a + 999), n) for a in range(0, n, 999)])
        ids, counts = np.unique(own, return_counts=True)
        assert {(b, int(i)): int(m) for i, m in zip(ids, counts, strict=True)} == {k: m for k, m in want.items() if k[0] == b}


@pytest.mark.parametrize("slice_bytes", [64 << 20, 1000])
def test_means_are_those_of_joined_draws(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(resample, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(resample, "CHUNK", 512)
    rows = spark.range(2500).select(F.col("id").alias("row_id"), F.sin("id").alias("u"), (F.col("id") % 7).cast("double").alias("v"))
    chunks = resample.packed(rows, ["u", "v"])
    assert chunks.count() == 5 and resample.dealt(chunks, 9)[2] == (1 if slice_bytes > 1000 else 5)
    got = {r.b: (r.u, r.v) for r in resample.means(rows, 2500, ["u", "v"], 9).collect()}
    want = splits.drawn(rows, 2500, 9).join(rows, "row_id").groupBy("b").agg(F.avg("u"), F.avg("v")).collect()
    assert sorted(got) == list(range(9))
    assert all(got[r[0]] == pytest.approx((r[1], r[2]), abs=1e-12) for r in want)


@pytest.mark.parametrize("name", ["bootstrap_ci", "paired_ci", "verdict", "ablation"])
def test_intervals_send_no_draws(spark, sf, monkeypatch, name):
    monkeypatch.setattr(splits, "drawn", no_draw_is_sent)
    assert QUERIES[name](spark, sf).count() == (18 if name == "ablation" else 1)


def test_paired_differences_by_number_of_replicates(spark):
    rows = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") * 7 % 11) / 11.0).alias("one"), ((F.col("id") * 5 % 13) / 13.0).alias("other"))
    one, other = (metrics.paired_differences(rows, d, ["one", "other"]).collect() for d in (20, splits.drawn(rows, 40, 20)))
    assert [(r.model, r.metric, r.verdict) for r in one] == [(r.model, r.metric, r.verdict) for r in other]
    for r, s in zip(one, other, strict=True):
        assert [r.score, r.delta, r.low, r.high] == [v if v is None else pytest.approx(v, abs=1e-12) for v in (s.score, s.delta, s.low, s.high)]
