"""Resharding by minimum-cost flow.

Rows lie in old shards; new shards have capacities in bytes. On the graph
source -> old shards -> new shards -> sink a minimum-cost flow (successive
shortest paths, potentials) says how many bytes each old shard sends to each new
one; what keeps its number costs nothing, so the flow moves the fewest bytes. The
flow is then laid on the rows: an old shard's rows stand in a fixed order cut into
blocks, blocks and, within the blocks that a cut falls into, rows go to the new
shards in turn. Rows larger than a 256th of a capacity stand first, so cuts fall
among small rows and the new sizes are near equal.

Only the sizes of old and new shards reach the driver (both counts are
parameters). Prefix sums are taken over blocks of some BLOCK_ROWS rows, then within
a block, so no task needs a whole shard, whatever its share of the rows. A row's
block follows from its id, size and checksum; where more rows than a block's are
alike in all three, they are numbered and dealt over blocks.

Defined results: a null text has no bytes; a null id stands first in its order;
repeated rows are placed each for itself, in any order among themselves; an empty
table gives no rows. Equal texts need not share a shard: a group of copies may
exceed one.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from bracketry.llm.common import checkpointed, packed_row, table, unpacked_row

#: Shards before and after, what a row costs besides its text, and rows of a block.
OLD_SHARDS, NEW_SHARDS, ROW_BYTES, BLOCK_ROWS = 32, 40, 16, 4096
#: Rows over this part of a capacity are dealt first.
LARGE_PART = 256


def min_cost_flow(supply: list[int], capacity: list[int], cost=lambda i, j: 0 if i == j else 1) -> dict[tuple[int, int], int]:
    """(old, new) -> bytes of the cheapest flow that sends all supply within the capacities."""
    if sum(supply) > sum(capacity):
        raise ValueError("capacities don't hold the supply")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    head: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, price = [], [], []

    def arc(a: int, b: int, most: int, c: int) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((most, 0))
        price.extend((c, -c))

    between = {}
    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    for i, s in enumerate(supply):
        for j in range(m):
            between[i, j] = len(to)
            arc(i, n + j, s, cost(i, j))
    potential, left = [0] * (n + m + 2), sum(supply)
    while left:
        far = [float("inf")] * (n + m + 2)
        by = [-1] * (n + m + 2)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in head[a]:
                b = to[e]
                if room[e] and (new := d + price[e] + potential[a] - potential[b]) < far[b]:
                    far[b], by[b] = new, e
                    heapq.heappush(heap, (new, b))
        for v, d in enumerate(far):
            if d < float("inf"):
                potential[v] += d
        step, v = left, sink
        while v != source:
            step, v = min(step, room[by[v]]), to[by[v] ^ 1]
        v = sink
        while v != source:
            room[by[v]] -= step
            room[by[v] ^ 1] += step
            v = to[by[v] ^ 1]
        left -= step
    return {k: room[e ^ 1] for k, e in between.items() if room[e ^ 1]}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def reshard(docs: DataFrame, old: Column, new_shards: int, capacities: list[int] | None = None, id_column: str = "doc_id", text_column: str = "text", old_shards: int = OLD_SHARDS) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, old_shard, shard, slot. old: a column of numbers 0 to old_shards - 1."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        old.cast("int").alias("old"),
    )
    rows = checkpointed(rows.withColumn("number", F.monotonically_increasing_id()))
    by_old = {r.old: (r.bytes, r.n) for r in rows.groupBy("old").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    supply = [by_old.get(i, (0, 0))[0] for i in range(old_shards)]
    capacities = capacities or equal_capacities(sum(supply), new_shards)
    moves = min_cost_flow(supply, capacities)
    # each old shard's flow as consecutive cuts; what stays comes first
    cuts, schema = [], "old int, target int, low long, high long"
    for i in range(old_shards):
        at = 0
        for j in sorted((j for a, j in moves if a == i), key=lambda j: (j != i, j)):
            cuts.append((i, j, at, at + moves[i, j]))
            at += moves[i, j]
    large = max(1, min(capacities, default=1) // LARGE_PART)
    blocks = max(1, -(-max([n for _, n in by_old.values()], default=0) // BLOCK_ROWS))
    # the order of an old shard: large rows first, then by a hash that gives the blocks
    alike = ["id", "size", "crc"]
    many = checkpointed(rows.groupBy(*alike).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > BLOCK_ROWS))
    salt = F.lit(0).cast("long")
    if not many.isEmpty():
        many = many.select(*[F.col(c).alias(f"{c}_of") for c in alike], "copies")
        same = F.col("id").eqNullSafe(F.col("id_of")) & (F.col("size") == F.col("size_of")) & (F.col("crc") == F.col("crc_of"))
        rows = rows.join(many, same, "left")
        salt = F.when(F.col("copies").isNull(), salt).otherwise(F.pmod(F.xxhash64("number"), F.ceil(F.col("copies") / BLOCK_ROWS)))
    spread = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "size", "crc", salt)
    rows = rows.withColumn("block", (F.pmod(spread, F.lit(blocks)) + F.when(F.col("size") > large, 0).otherwise(blocks)).cast("long"))
    order = ["old", "block"]
    sums = rows.groupBy(*order).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = W.Window.partitionBy("old").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.select("old", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = W.Window.partitionBy(*order).orderBy(F.col("id").asc_nulls_first(), "size", "crc").rowsBetween(W.Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # at most old + new - 1 cuts: a flow of successive shortest paths on two bounded counts
    cut = docs.sparkSession.createDataFrame(cuts, schema).groupBy("old").agg(F.sort_array(F.collect_list(F.struct("low", "high", "target"))).alias("cuts"))
    placed = rows.join(sums, order).join(F.broadcast(cut), "old")
    middle = F.col("base") + F.col("inner") + F.col("size") / 2
    inside_cut = F.filter("cuts", lambda c: (c["low"] <= middle) & (middle < c["high"]))
    placed = placed.select("id", "size", "crc", "old", "block", F.coalesce(F.get(inside_cut, 0)["target"], F.element_at("cuts", -1)["target"]).alias("shard"))
    # slots: rows before the block in its new shard, then rows before in the block
    part = ["shard", "old", "block"]
    counts = placed.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    earlier = W.Window.partitionBy("shard").orderBy("old", "block").rowsBetween(W.Window.unboundedPreceding, -1)
    counts = counts.select(*part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    rank = F.row_number().over(W.Window.partitionBy(*part).orderBy(F.col("id").asc_nulls_first(), "size", "crc"))
    placed = placed.withColumn("rank", rank).join(counts, part)
    return placed.select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.col("old").alias("old_shard"), F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("rank") - 1).cast("long").alias("slot")
    )


def rewrite(docs: DataFrame, placed: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", old: Column | None = None) -> list[int]:
    """Put the files of every shard that gains or loses rows under path/shard=N; returns those numbers. All other shards there stay as they are, and a shard that loses its last row goes.

    docs may be read from path itself: the new files are written whole to a staging
    folder below it before a live one is touched, and `finish` then moves them shard
    by shard. A run that breaks off before the staging is whole changes nothing; one
    that breaks off later is completed by calling `finish`, and until then rewrite
    refuses the path. Every row is written once: rows of one id and text, null ids too,
    are numbered and take their places in turn. old: the column given to reshard, where
    such rows may lie in different shards. Columns shard and slot of docs give way.
    """
    spark = docs.sparkSession
    if _staged(spark, path):
        raise ValueError(f"an earlier rewrite of {path} has not ended: call finish")
    moved = placed.where(F.col("old_shard") != F.col("shard"))
    touched = [r[0] for r in moved.select(F.explode(F.array("old_shard", "shard"))).distinct().collect()]
    text = F.coalesce(F.col(text_column), F.lit(""))
    alike = ["__id", "__size", "__crc", "__old"]
    place = placed.select(F.col(id_column).alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), (F.lit(0) if old is None else F.col("old_shard")).alias("__old"), "shard", "slot")
    place = place.withColumn("__rank", F.row_number().over(W.Window.partitionBy(*alike).orderBy("shard", "slot"))).where(F.col("shard").isin(touched))
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    rows = docs.select(
        packed_row(docs, "shard", "slot").alias("__doc"), F.col(id_column).alias("__id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("__size"), F.crc32(text.cast("binary")).alias("__crc"),
        (F.lit(0) if old is None else old.cast("int")).alias("__old"), order.alias("__order"),
    )
    rows = rows.withColumn("__rank", F.row_number().over(W.Window.partitionBy(*alike).orderBy("__order")))
    keys = [*alike, "__rank"]
    place = place.withColumnsRenamed({k: f"{k}_of" for k in keys})
    matched = F.lit(True)
    for k in keys:
        matched &= F.col(k).eqNullSafe(F.col(f"{k}_of"))
    whole = rows.join(place, matched).select(*unpacked_row(docs, "__doc", "shard", "slot"), "shard", "slot")
    # a shard's rows are dealt to tasks by ranges of slots
    whole = whole.repartition("shard", F.floor(F.col("slot") / (16 * BLOCK_ROWS))).sortWithinPartitions("shard", "slot")
    # a folder for every touched shard, even where no row is left for it
    staging = f"{path.rstrip('/')}/{STAGING}"
    whole.write.mode("overwrite").partitionBy("shard").parquet(f"{staging}/new")
    for n in touched:
        _files(spark, staging).mkdirs(_path(spark, f"{staging}/new/shard={n}"))
    _files(spark, staging).create(_path(spark, f"{staging}/WHOLE")).close()
    finish(spark, path)
    return sorted(touched)


#: The staging folder below a layout; readers pass over names that begin so.
STAGING = "_resharding"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _staged(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, f"{path.rstrip('/')}/{STAGING}/WHOLE"))


def finish(spark: SparkSession, path: str) -> None:
    """Move the staged shards of a rewrite to their places. It may be called again after it was broken off; without a whole staging it does nothing."""
    if not _staged(spark, path):
        return
    base, files = path.rstrip("/"), _files(spark, path)
    for status in files.listStatus(_path(spark, f"{base}/{STAGING}/new")):
        name = status.getPath().getName()
        if name.startswith("shard="):
            live = _path(spark, f"{base}/{name}")
            files.delete(live, True)
            # a folder without files is a shard without rows
            if len(files.listStatus(status.getPath())) == 0:
                files.delete(status.getPath(), True)
            elif not files.rename(status.getPath(), live):
                raise OSError(f"{status.getPath()} could not be moved")
    files.delete(_path(spark, f"{base}/{STAGING}"), True)


def key_shard(column: str, shards: int) -> Column:
    """The old layout: the id alone decides."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(shards))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = reshard(docs, key_shard("doc_id", OLD_SHARDS), NEW_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "old_shard")
