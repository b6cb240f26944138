"""Bootstrap draws worked out where they are used, so that no draw is ever sent.

Rows 0 .. n - 1 are packed in chunks: the distinct tuples of a chunk's values and each
row's number among them. A task gets the chunks of a slice of at most SLICE_BYTES and a
share of the replicates; it works out all n draws of a replicate, the same ones as
splits.drawn, and counts how often each tuple of its slice is drawn. What is sent is a
slice for each group of replicates, and one row for each replicate and slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bracketry.session import checkpointed, ship

#: Rows of a chunk, bytes of packed rows that a task holds, draws worked out at a time, and least number of groups that replicates are dealt to.
CHUNK, SLICE_BYTES, BLOCK, GROUPS = 1 << 16, 64 << 20, 1 << 17, 48


def scrambled(x: int) -> int:
    for _ in range(2):
        x = (x ^ x >> 16) * 73244475 & 0xFFFFFFFF
    return x ^ x >> 16


def draws(b: int, start: int, stop: int, n: int, seed: int = 7) -> np.ndarray:
    """The rows that the places start .. stop - 1 of a replicate draw, as splits.drawn has them."""
    x = np.arange(start, stop, dtype=np.uint64).astype(np.uint32)
    x ^= np.uint32(scrambled(b * 2654435761 + seed & 0xFFFFFFFF))
    part = np.empty_like(x)
    for _ in range(2):
        np.right_shift(x, 16, out=part)
        x ^= part
        x *= np.uint32(73244475)
    np.right_shift(x, 16, out=part)
    x ^= part
    if n < 1 << 32:
        # twice as fast as a remainder
        np.floor_divide(x, np.uint32(n), out=part)
        part *= np.uint32(n)
        x -= part
    return x


def coded(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a table of numbers, bit by bit, and the place of each row among them."""
    table = np.ascontiguousarray(table, dtype=np.float64)
    if table.shape[1] == 1:
        whole = table.view(np.uint64).ravel()
    else:
        whole = table.view(np.dtype((np.void, table.itemsize * table.shape[1]))).ravel()
    _, first, codes = np.unique(whole, return_index=True, return_inverse=True)
    return table[first], codes.ravel()


def narrow(codes: np.ndarray, distinct: int) -> np.ndarray:
    return codes.astype(np.uint8 if distinct <= 1 << 8 else np.uint16 if distinct <= 1 << 16 else np.uint32)


def packed(rows: DataFrame, columns: list[str], width: int | None = None) -> DataFrame:
    """(chunk, start, distinct, codes, tuples) of rows (row_id, columns of numbers), row_id 0 .. n - 1. width: rows of a chunk, 65,536 at most."""
    ship(rows.sparkSession)
    width = width or CHUNK

    def pack(key, part):
        ids = part["row_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        values = np.stack([part[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], 1)[order]
        tuples, codes = coded(values)
        own = {"chunk": [key[0].as_py()], "start": [int(ids.min())], "distinct": [len(tuples)], "codes": [narrow(codes, len(tuples)).tobytes()], "tuples": [tuples.tobytes()]}
        return pa.table(own, pa.schema([*[(c, pa.int64()) for c in ("chunk", "start", "distinct")], ("codes", pa.binary()), ("tuples", pa.binary())]))

    chunked = rows.select(F.floor(F.col("row_id") / width).cast("long").alias("chunk"), "row_id", *[F.col(c).cast("double").alias(c) for c in columns])
    return checkpointed(chunked.groupBy("chunk").applyInArrow(pack, "chunk long, start long, distinct long, codes binary, tuples binary"))


def unpacked(part: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The tuples of some chunks in a row, each row's number among them, and the first row."""
    part = part.sort_by("chunk")
    sizes, tuples, codes = part["distinct"].to_pylist(), [], []
    for distinct, own, table in zip(sizes, part["codes"], part["tuples"], strict=True):
        kind = np.uint8 if distinct <= 1 << 8 else np.uint16
        codes.append(np.frombuffer(own.as_buffer(), kind))
        tuples.append(np.frombuffer(table.as_buffer(), np.float64).reshape(distinct, columns))
    every, place = coded(np.concatenate(tuples))
    place, upto = narrow(place, len(every)), np.cumsum([0, *sizes])
    return every, np.concatenate([place[a:][c] for a, c in zip(upto, codes, strict=False)]), part["start"][0].as_py()


def counted(codes: np.ndarray, distinct: int, first: int, b: int, n: int, seed: int) -> np.ndarray:
    """How often a replicate draws each tuple of a slice."""
    counts, whole, block = np.zeros(distinct, np.int64), len(codes) == n, max(BLOCK, 4 * distinct)
    for start in range(0, n, block):
        own = draws(b, start, min(n, start + block), n, seed)
        if not whole:
            own = own[(own >= first) & (own < first + len(codes))] - np.uint32(first)
        counts += np.bincount(codes[own], minlength=distinct)
    return counts


def dealt(chunks: DataFrame, replicates: int) -> tuple[DataFrame, int, int]:
    """The chunks for each group of replicates and slice of rows, and the numbers of both."""
    size = chunks.agg(F.sum(F.octet_length("codes") + F.octet_length("tuples")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    wide = max(1, (size.n or 0) * SLICE_BYTES // max(size.bytes or 0, 1))
    slices = max(1, -(-(size.n or 0) // wide))
    groups = max(1, min(replicates, max(GROUPS, 4 * chunks.sparkSession.sparkContext.defaultParallelism)))
    spread = chunks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.floor(F.col("chunk") / wide).cast("long").alias("slice"), "*")
    return spread.repartition(groups * slices, "group", "slice"), groups, slices


def means(rows: DataFrame, n: int, columns: list[str], replicates: int, seed: int = 7) -> DataFrame:
    """(b, columns): the columns' means over the n draws of each replicate. rows: (row_id, columns), row_id 0 .. n - 1, no value missing."""
    spread, groups, _ = dealt(packed(rows, columns), replicates)

    def sums(key, part):
        tuples, codes, first = unpacked(part, len(columns))
        own = range(key[0].as_py(), replicates, groups)
        found = np.array([counted(codes, len(tuples), first, b, n, seed) @ tuples for b in own]).reshape(len(own), len(columns))
        return pa.table([pa.array(own, pa.int32()), *found.T], names=["b", *columns])

    parts = spread.groupBy("group", "slice").applyInArrow(sums, ", ".join(["b int", *[f"`{c}` double" for c in columns]]))
    return parts.groupBy("b").agg(*[(F.sum(f"`{c}`") / n).alias(c) for c in columns])
