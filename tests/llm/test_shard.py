import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from bracketry.llm import shard


def test_flow_is_cheapest():
    rng = random.Random(2)
    for _ in range(40):
        n, m = rng.randint(1, 5), rng.randint(1, 6)
        supply = [rng.randint(0, 30) for _ in range(n)]
        capacity = shard.equal_capacities(sum(supply), m)
        flow = shard.min_cost_flow(supply, capacity)
        assert [sum(v for (a, _), v in flow.items() if a == i) for i in range(n)] == supply
        assert [sum(v for (_, b), v in flow.items() if b == j) for j in range(m)] == capacity
        moved = sum(v for (a, b), v in flow.items() if a != b)
        assert moved == sum(supply) - sum(min(s, c) for s, c in zip(supply, capacity, strict=False))


def test_flow_with_other_costs_matches_brute_force():
    rng = random.Random(4)
    for _ in range(20):
        supply, capacity = [rng.randint(0, 3) for _ in range(3)], [4, 3, 2]
        costs = [[rng.randint(0, 4) for _ in range(3)] for _ in range(3)]
        flow = shard.min_cost_flow(supply, capacity, lambda i, j: costs[i][j])
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        best = min(sum(costs[i][j] for i, j in zip(units, to, strict=True)) for to in itertools.product(range(3), repeat=len(units)) if all(to.count(j) <= capacity[j] for j in range(3)))
        assert sum(costs[i][j] * v for (i, j), v in flow.items()) == best


def test_flow_refuses_too_little_room():
    with pytest.raises(ValueError):
        shard.min_cost_flow([5], [4])


def test_rows_are_placed_whole_and_near_equal(spark, monkeypatch):
    monkeypatch.setattr(shard, "BLOCK_ROWS", 64)
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 60), i, "k") for i in range(6000)] + [(7, None, 1, "k"), (7, None, 1, "k"), (None, "é", 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long, shard string").repartition(5)
    out = shard.reshard(docs, shard.key_shard("doc_id", 5), 7, old_shards=5).collect()
    assert len(out) == len(rows)
    sizes = [sum(r.size for r in out if r.shard == j) for j in range(7)]
    assert max(sizes) - min(sizes) <= 400
    for j in range(7):
        assert sorted(r.slot for r in out if r.shard == j) == list(range(sum(r.shard == j for r in out)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    old = [sum(r.size for r in out if r.old_shard == i) for i in range(5)]
    moved = sum(r.size for r in out if r.old_shard != r.shard)
    assert moved <= sum(old) - sum(min(o, sum(old) // 7) for o in old) + 400


def test_rewrite_writes_only_what_changes(spark, tmp_path):
    docs = spark.createDataFrame([(i, "y" * 20, f"s{i}") for i in range(300)], "doc_id long, text string, slot string").withColumnRenamed("slot", "note")
    placed = shard.reshard(docs, shard.key_shard("doc_id", 3), 4, old_shards=3)
    touched = shard.rewrite(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted({r.shard for r in back.collect()}) == touched
    assert back.count() == placed.where(F.col("shard").isin(touched)).count()


def test_rewrite_writes_null_and_repeated_ids_once(spark, tmp_path):
    rows = [(i % 40 if i % 5 else None, "z" * (i % 3), f"n{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    old = shard.key_shard("note", 3)
    placed = shard.reshard(docs, old, 4, old_shards=3)
    touched = shard.rewrite(docs, placed, str(tmp_path / "out"), old=old)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert touched == [0, 1, 2, 3]
    assert sorted(r.note for r in back) == sorted(n for *_, n in rows)
    assert sorted((r.shard, r.slot) for r in back) == sorted((r.shard, r.slot) for r in placed.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shard.reshard(docs, shard.key_shard("doc_id", 3), 4, old_shards=3).collect() == []


def laid_out(spark, path):
    return sorted((r.doc_id, r.shard, r.note) for r in spark.read.parquet(path).collect())


def test_rewrite_of_a_live_layout_keeps_every_row(spark, tmp_path):
    path = str(tmp_path / "live")
    rows = [(i, "t" * (i % 50), f"n{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    docs.withColumn("shard", F.col("doc_id") % 3).write.partitionBy("shard").parquet(path)
    for old, new in ((3, 4), (4, 4), (4, 2)):
        live = spark.read.parquet(path)
        files = {p: p.stat().st_mtime_ns for p in (tmp_path / "live").rglob("*.parquet")}
        capacities = [3000, 1000, 9000, 9000] if new == 4 and old == 4 else None
        placed = shard.reshard(live, F.col("shard"), new, capacities, old_shards=old).cache()
        want = sorted((r.doc_id, r.shard) for r in placed.collect())
        touched = shard.rewrite(live, placed, path)
        assert [(d, n) for d, n, _ in laid_out(spark, path)] == want
        assert sorted(n for _, _, n in laid_out(spark, path)) == sorted(n for _, _, n in rows)
        assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in files.items() if int(p.parent.name[6:]) not in touched)
        assert not (tmp_path / "live" / shard.STAGING).exists()
    assert sorted(p.name for p in (tmp_path / "live").glob("shard=*")) == ["shard=0", "shard=1"]


def test_a_rewrite_that_breaks_off_loses_nothing_and_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "live")
    docs = spark.createDataFrame([(i, "t" * 20, f"n{i}") for i in range(200)], "doc_id long, text string, note string")
    docs.withColumn("shard", F.col("doc_id") % 2).write.partitionBy("shard").parquet(path)
    live = spark.read.parquet(path)
    before = laid_out(spark, path)
    placed = shard.reshard(live, F.col("shard"), 3, old_shards=2).cache()
    monkeypatch.setattr(shard, "finish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        shard.rewrite(live, placed, path)
    monkeypatch.undo()
    assert laid_out(spark, path) == before
    with pytest.raises(ValueError, match="finish"):
        shard.rewrite(live, placed, path)
    shard.finish(spark, path)
    assert [(d, n) for d, n, _ in laid_out(spark, path)] == sorted((r.doc_id, r.shard) for r in placed.collect())
    shard.finish(spark, path)


def test_rows_that_are_alike_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(shard, "BLOCK_ROWS", 50)
    rows = [(None, "same")] * 2000 + [(i, "x" * (i % 9)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = shard.reshard(docs, shard.key_shard("text", 4), 5, old_shards=4).collect()
    assert len(out) == len(rows)
    sizes = [sum(r.size for r in out if r.shard == j) for j in range(5)]
    assert max(sizes) - min(sizes) <= 100
    for j in range(5):
        assert sorted(r.slot for r in out if r.shard == j) == list(range(sum(r.shard == j for r in out)))
