"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows. Words of the benchmark are numbered, a
document's other words are all zero, and a window is a place in one flat array of
numbers, so a pattern costs a few bytes and no objects. Windows of one length form
a matcher: a block is the last B words of a would-be window; the shift table, one
byte for each hash of a block, says how far the window can move before that block
could end a pattern, so most positions are never looked at. Where the shift is zero,
a hash of the suffix block and the first word names the bucket of patterns, and a
direct comparison of all words confirms the occurrence.

The patterns are broadcast in slices of at most SLICE_BYTES of benchmark words and
SLICE_WORDS distinct ones, so what a worker holds is bounded whatever the benchmark's
size; an item longer than a slice is cut into pieces that share no window and lose
none. With several slices the hits of a document are united per document.

Defined results: null texts have no words, in documents (never contaminated) and
items (never found); rows of one item_id are one item, a null item_id is never
listed or counted though its windows still hit; repeated document rows are judged
each for itself; an empty benchmark hits nothing. Input columns may have any name.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm.common import checkpointed, packed_row, resident, ship, table, unpacked_row

#: Words of a window and of a block; bytes of benchmark words, and distinct ones, that are searched for at once.
WINDOW, BLOCK, SLICE_BYTES, SLICE_WORDS = 13, 2, 16 << 20, 1 << 19
#: Most bits of a place in the shift table; words of documents that are searched at once; candidates that are compared at once.
SHIFT_BITS, GROUP_WORDS, COMPARED = 24, 1 << 18, 1 << 20

# Word bytes are digits, letters (lower-cased) and all bytes from 0x80; others separate.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


def hashed(*columns: np.ndarray) -> np.ndarray:
    """One hash for each row of columns of numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * M1
        h = (h ^ h >> np.uint64(29)) * M2
    return h ^ h >> np.uint64(32)


class WuManber:
    """All windows of one length: those that begin at `starts` in the flat array `words`, each with its owner's number."""

    def __init__(self, length: int, words: np.ndarray, starts: np.ndarray, owners: np.ndarray):
        self.length, self.words = length, words
        self.block = b = min(BLOCK, length)
        whole = hashed(*[words[starts + k] for k in range(length)])
        order = np.lexsort((owners, whole))
        starts, owners, whole = starts[order], owners[order], whole[order]
        alike = np.zeros(len(starts), bool)
        alike[1:] = whole[1:] == whole[:-1]
        for k in range(length):
            alike[1:] &= words[starts[1:] + k] == words[starts[:-1] + k]
        first = np.flatnonzero(~alike)
        # the distinct patterns, and where the owners of each begin and end
        self.starts, self.owners = starts[first], owners
        self.low, self.high = first, np.append(first[1:], len(starts))
        bits = min(SHIFT_BITS, max(12, (4 * len(first)).bit_length()))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, length - b + 1, np.uint8)
        for end in range(b, length + 1):
            # later ends have smaller shifts and overwrite
            self.shift[self.blocks(words, self.starts + end - 1)] = length - end
        suffix = self.suffixes(words, self.starts)
        order = np.argsort(suffix, kind="stable")
        self.buckets, self.of_bucket = suffix[order], order

    def blocks(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The places in the shift table of the blocks that end at `last`."""
        return (hashed(*[words[last - k] for k in range(self.block)]) >> self.down).astype(np.int64)

    def suffixes(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        last = starts + self.length - 1
        return hashed(words[starts], *[words[last - k] for k in range(self.block)])

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence in words."""
        m, n = self.length, len(words)
        if n < m or not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        steps = self.shift[self.blocks(words, np.arange(m - 1, n))].tobytes()
        stops, at, end = [], 0, len(steps)
        while at < end:
            if step := steps[at]:
                at += step
            else:
                stops.append(at)
                at += 1
        starts = np.array(stops, np.int64)
        suffix = self.suffixes(words, starts)
        low, high = np.searchsorted(self.buckets, suffix, "left"), np.searchsorted(self.buckets, suffix, "right")
        starts, low, counts = starts[high > low], low[high > low], (high - low)[high > low]
        group = np.cumsum(counts) // COMPARED
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(group)) + 1):
            n_of = counts[part]
            where = np.repeat(starts[part], n_of)
            pattern = self.of_bucket[np.repeat(low[part] - np.cumsum(n_of) + n_of, n_of) + np.arange(n_of.sum())]
            for k in range(m):
                ok = words[where + k] == self.words[self.starts[pattern] + k]
                where, pattern = where[ok], pattern[ok]
            found.append((where, pattern))
        return np.concatenate([w for w, _ in found]), np.concatenate([p for _, p in found])


class Patterns:
    """The matchers of all window lengths of some items, and the words that they number."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.number: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items if i is not None})
        place = {name: k for k, name in enumerate(self.names)} | {None: -1}
        flat, by_length, at = [], {}, 0
        for item, text in items:
            words = text.split()
            flat.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int32))
            if m := min(WINDOW, len(words)):
                by_length.setdefault(m, []).append((np.arange(at, at + len(words) - m + 1), place[item]))
            at += len(words)
        whole = np.concatenate([*flat, np.zeros(0, np.int32)])
        self.matchers = [WuManber(m, whole, np.concatenate([s for s, _ in own]), np.concatenate([np.full(len(s), i, np.int32) for s, i in own])) for m, own in sorted(by_length.items())]

    def search(self, texts: list[str | None]) -> list[tuple[int, list[int], set]]:
        """Of each text its words, the hit intervals as start, end, start, end, ... and the items found."""
        out, group, held = [], [], 0
        for text in texts:
            words = words_of(text)
            if group and held + len(words) > GROUP_WORDS:
                out += self._group(group)
                group, held = [], 0
            group.append(words)
            held += len(words)
        return out + self._group(group)

    def _group(self, docs: list[list[bytes]]) -> list[tuple[int, list[int], set]]:
        number = self.number.get
        # a zero, which no pattern has, stands between documents
        flat = np.array([x for words in docs for x in (*map(number, words, [0] * len(words)), 0)], np.int32)
        begin = np.cumsum([0, *[len(words) + 1 for words in docs]])
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set] = {}
        for matcher in self.matchers:
            where, pattern = matcher.find(flat)
            doc = np.searchsorted(begin, where, "right") - 1
            for d, s, p in zip(doc.tolist(), (where - begin[doc]).tolist(), pattern.tolist(), strict=True):
                spans.setdefault(d, []).append((s, s + matcher.length))
                items.setdefault(d, set()).update(self.names[i] for i in set(matcher.owners[matcher.low[p] : matcher.high[p]].tolist()) if i >= 0)
        out = []
        for d, words in enumerate(docs):
            flat_spans: list[int] = []
            for start, end in sorted(spans.get(d, ())):
                if flat_spans and start <= flat_spans[-1]:
                    flat_spans[-1] = max(flat_spans[-1], end)
                else:
                    flat_spans += [start, end]
            out.append((len(words), flat_spans, items.get(d, set())))
        return out


SCHEMA = "n_words long, spans array<long>, items array<string>"


def searched_by(spark: SparkSession, items: list[tuple[str | None, bytes]], text: Column) -> Column:
    """A struct of the words, hit intervals and items of each whole text."""
    shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def search(texts: pa.Array) -> pa.Array:
        found = resident(("patterns", key), lambda: Patterns(shared.value)).search(texts.to_pylist())
        columns = [
            pa.array([n for n, _, _ in found], pa.int64()),
            pa.array([s for _, s, _ in found], pa.list_(pa.int64())),
            pa.array([sorted(x) for _, _, x in found], pa.list_(pa.string())),
        ]
        return pa.StructArray.from_arrays(columns, ["n_words", "spans", "items"])

    return F.arrow_udf(search, SCHEMA)(text)


def _slices(benchmark: DataFrame, item_column: str, text_column: str):
    """The benchmark's (item, words) pairs, a slice at a time; the driver holds one slice. An item goes on in the next slice with its last WINDOW - 1 words once more."""
    held, size, distinct = [], 0, set()
    for r in benchmark.select(F.col(item_column).cast("string"), text_column).toLocalIterator():
        words, first = words_of(r[1]), 0
        for k, word in enumerate(words):
            size += len(word) + 1
            distinct.add(word)
            if (size >= SLICE_BYTES or len(distinct) >= SLICE_WORDS) and k - first + 1 >= WINDOW and k + 1 < len(words):
                held.append((r[0], b" ".join(words[first : k + 1])))
                yield held
                first = k + 2 - WINDOW
                held, distinct = [], set(words[first : k + 1])
                size = sum(len(w) + 1 for w in words[first : k + 1])
        if words:
            held.append((r[0], b" ".join(words[first:])))
        if size >= SLICE_BYTES or len(distinct) >= SLICE_WORDS:
            yield held
            held, size, distinct = [], 0, set()
    if held:
        yield held


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_column: str = "item_id", item_text: str = "text", out: str = "__found") -> DataFrame:
    """docs with struct column `out`: n_words, spans (hit word intervals, flattened) and items (ids found). An input column of that name gives way."""
    spark = docs.sparkSession
    ship(spark)
    slices = _slices(benchmark, item_column, item_text)
    first, second = next(slices, []), next(slices, None)
    held = docs.select(packed_row(docs, out).alias("__doc"), F.col(text).alias("__text"))
    if second is None:
        return held.select("__doc", searched_by(spark, first, F.col("__text")).alias("__f")).select(*unpacked_row(docs, "__doc", out), F.col("__f").alias(out))
    keyed = checkpointed(held.withColumn("__row", F.monotonically_increasing_id()))
    parts = None
    for part in (x for group in ([first, second], slices) for x in group):
        hits = keyed.select("__row", searched_by(spark, part, F.col("__text")).alias("f")).where(F.size("f.spans") > 0)
        parts = hits if parts is None else parts.union(hits)
    united = parts.groupBy("__row").agg(
        F.sort_array(F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0), F.size("f.spans") - 2, F.lit(2)), lambda i: F.struct(F.get(F.col("f.spans"), i).alias("a"), F.get(F.col("f.spans"), i + 1).alias("b")))))).alias("pairs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("items"),
    )
    merged = F.aggregate(
        "pairs",
        F.array().cast("array<long>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["a"] <= F.element_at(acc, -1)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), x["b"])))).otherwise(F.concat(acc, F.array(x["a"], x["b"]))),
    )
    united = united.select("__row", merged.alias("__spans"), F.col("items").alias("__items"))
    counted = keyed.withColumn("__f", searched_by(spark, [], F.col("__text"))).join(united, "__row", "left")
    whole = F.struct(F.col("__f.n_words").alias("n_words"), F.coalesce("__spans", F.array().cast("array<long>")).alias("spans"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"))
    return counted.select(*unpacked_row(docs, "__doc", out), whole.alias(out))


def hit_words(spans):
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of docs."""
    held = docs.select(packed_row(docs).alias("__doc"), F.col(text).alias("__text"))
    found = find_benchmark(held, benchmark, "__text", item_column, item_text)
    hit, words = hit_words(F.col("__found.spans")), F.col("__found.n_words")
    return found.where(~((hit > 0) & (20 * hit >= words))).select(*unpacked_row(docs, "__doc"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    found = found.select("doc_id", F.col("__found.n_words").alias("n_words"), hit_words(F.col("__found.spans")).alias("n_hit"), F.col("__found.items").alias("items"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
