"""Language-model scoring with a log-frequency Bloom filter.

Counting covers all training rows. Texts are dealt into blocks; a block sends each
bucket of hashes its distinct words, word pairs and word triples with their counts,
packed. A bucket sums them. It returns the exact counts of the words to the blocks that
hold them, and builds its own segment of the filter: a pair or triple counted c times is
inserted at the levels 1 to 1 + floor(log2 c), K bits a level. Every one is held,
whatever its count: a segment has the bytes its entries need at half load, so the filter
grows with what it holds, and so do the buckets it is dealt over. No task holds more
than a slice of FILTER_BYTES of it, and nothing of it is broadcast: the pairs and
triples of all blocks, held-out rows too, are probed in their bucket.

Probing goes up an entry's levels until one is missing. The last level L that is there
gives the count 2^(L-1), never above the true one but for false positives. The levels go
back to the blocks, a byte for each distinct entry of a block.

With tokens u, v, w in a row, c exact counts, q filter counts, L(x) = 1 + floor(log2 x)
and N, V the number of training tokens and of distinct ones:
  p1(w) = (c(w) + 1) / (N + V + 1)
  p2(w|v) = a q(v, w) / c(v) + (1 - a) p1(w), a = A[L(c(v))]
  p3(w|u, v) = b q(u, v, w) / (2 q(u, v) - 1) + (1 - b) p2(w|v), b = B[L(q(u, v))]
where an unknown context leaves the shorter one's probability, and 2 q - 1 is the largest
count of its level, so no context gives out more than one. A and B are fitted by
expectation maximisation on all training rows, each occurrence taken out of the counts
that judge it: every block fits its own tokens, and the weights of all blocks are
averaged by their tokens.

Defined results: a null text is empty and has one token, the end; a null id counts as
the empty text where rows are held out; repeated rows count each; an empty table gives
an empty table. Words are told apart by 64-bit hashes, pairs and triples by MARGIN bits
more than the number of tokens has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm.common import checkpointed, remainder, ship, table
from bracketry.llm.substring import M1, M2, M3, blocks_of, dealt, hashed_words, mixed, packed, planes, sparse, table_of, unpacked, unplaned, unsparse

#: Bytes of the filter that a task holds at a time, hash functions of a level, levels, bits beyond the number of tokens.
FILTER_BYTES, K, LEVELS, MARGIN = 32 << 20, 6, 24, 12
#: The part of rows that is held out: remainder HELD of crc32 by FOLDS.
FOLDS, HELD = 7, 2
#: Steps of the fit, parts of an octave that likelihood ratios are counted by in it, and the weight of a first level without data.
FIT_STEPS, FINE, UNFITTED = 20, 64, 0.1

# Fixed value: ratios lie within 2^-64 and 2^64.
BINS = 128 * FINE
# Upper to lower case of ASCII letters; hashes of the start and the end of a text.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
START, END = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of every text, one after the other, and where each text ends."""
    words, starts = hashed_words(b"\n".join(texts).translate(LOWER))
    upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]), "left").astype(np.int64)
    ends = upto + np.arange(1, len(texts) + 1)
    out = np.full(len(words) + len(texts), END)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = words
    return out, ends


def before(values: np.ndarray, ends: np.ndarray, at_start) -> np.ndarray:
    """The value of the token before each token; at the start of a text another one."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    if len(ends):
        out[np.concatenate([[0], ends[:-1]])] = at_start
    return out


def pairs(last: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(last * M1 + words * M2)


def triples(words: np.ndarray, ends: np.ndarray, drop: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the pair and the triple that each token ends."""
    last = before(words, ends, START)
    two = pairs(last, words)
    three = mixed(before(last, ends, START) * M3 + two)
    return two >> drop, three >> drop


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat, n = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
    order = np.argsort(flat, kind="stable")
    flat, n = flat[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    return flat[first], np.add.reduceat(n, first) if len(first) else n


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64))


def probes(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The K places of each hash at a level in a segment of `bits` bits."""
    base = mixed(hashes + np.uint64(level * int(M2) & (1 << 64) - 1))
    step = mixed(base + M1) | np.uint64(1)
    return (base[:, None] + np.arange(K, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def segment(hashes: np.ndarray, levels: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size * 8, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        bits[probes(hashes[levels >= level], level, size * 8).ravel().astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class LogFrequencyFilter:
    """The segments of all buckets side by side; a hash's top bits name its segment."""

    def __init__(self, data: bytes, bucket_bits: int):
        self.data, self.bucket_bits = np.frombuffer(data, np.uint8), bucket_bits
        self.segment = len(data) >> bucket_bits

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """2^(L-1) for the last level L found of each hash; 0 where none is."""
        out, live = np.zeros(len(hashes), np.int64), np.arange(len(hashes))
        base = (hashes >> np.uint64(64 - self.bucket_bits)).astype(np.int64) * (self.segment * 8)
        for level in range(1, LEVELS + 1):
            at = probes(hashes[live], level, self.segment * 8).astype(np.int64) + base[live, None]
            live = live[(self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)]
            if not len(live):
                break
            out[live] = 1 << level - 1
        return out


def found_levels(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The level found for each of the sorted distinct hashes in the segment of those counted at all, slice by slice."""
    levels = np.where(counts > 0, level_of(counts), 0)
    room = max(1, int(FILTER_BYTES * 8 * math.log(2) / K))
    out, slices = np.zeros(len(hashes), np.uint8), np.cumsum(levels) // room
    cuts = np.flatnonzero(np.diff(slices)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hashes)], strict=True):
        size = max(8, math.ceil(int(levels[a:b].sum()) * K / (8 * math.log(2))))
        there = LogFrequencyFilter(segment(hashes[a:b], levels[a:b], size), 0).counts(hashes[a:b])
        out[a:b] = np.where(there > 0, level_of(there), 0)
    return out


SENT = [("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]
SCHEMA = "bucket long, block long, kind long, hashes binary, counts binary"
WORD, PAIR, TRIPLE, TOTALS = 0, 1, 2, 3


class Known:
    """What a block's texts are scored with: of each token its count, the count of the one before, and the levels of its pair and triple and of the pair before."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, known: pa.Table, drop: np.uint64):
        kinds, sent = known.column("kind").to_pylist(), known.column("counts").to_pylist()
        rows = list(zip(kinds, known.column("bucket").to_pylist(), known.column("hashes").to_pylist(), sent, strict=True))
        of = lambda kind: sorted((r for r in rows if r[0] == kind), key=lambda r: r[1])
        # buckets are ranges of hashes, so what they sent stands in the order of the block's distinct hashes
        hashes = np.concatenate([*[unpacked(h) for _, _, h, _ in of(WORD)], np.zeros(0, np.uint64)])
        counts = np.concatenate([*[unplaned(c) for _, _, _, c in of(WORD)], np.zeros(0, np.int64)])
        distinct, place = np.unique(words, return_inverse=True)
        two, three = (np.unique(x, return_inverse=True)[1] for x in triples(words, ends, drop))
        levels = [np.concatenate([*[unsparse(c) for _, _, _, c in of(kind)], np.zeros(0, np.int64)]) for kind in (PAIR, TRIPLE)]
        if not np.array_equal(hashes, distinct) or any(len(x) != n for x, n in zip(levels, (two.max(initial=-1) + 1, three.max(initial=-1) + 1), strict=True)):
            raise RuntimeError("a block's rows changed between counting and scoring: the input isn't the same when read twice")
        self.c = counts[place]
        self.two, self.three = levels[0][two], levels[1][three]
        self.c_before = before(self.c, ends, self.c[ends[0] - 1] if len(ends) else 0)
        self.two_before = before(self.two, ends, 0)

    def probabilities(self, total: int, distinct: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each token by its count alone, and by the model."""
        p1 = (self.c + 1) / (total + distinct + 1)
        return p1, smoothed(p1, np.minimum(1 << self.two >> 1, self.c_before), self.c_before, 1 << self.three >> 1, self.two_before, a, b)

    def fit(self, total: int, distinct: int) -> list[tuple[int, int, float, int]]:
        """(order, level, weight, tokens) fitted to these tokens, each taken out of its counts."""
        p1 = self.c / (total + distinct)
        less = lambda levels: np.maximum((1 << levels >> 1) - 1, 0)
        left = self.c_before - 1
        of_two = np.where(left > 0, np.minimum(less(self.two), left) / np.maximum(left, 1), 0)
        at = np.where(left > 0, level_of(left), 0)
        a, n_a = mixture(of_two, p1, at)
        weight = filled(a, n_a)[at]
        p2 = weight * of_two + (1 - weight) * p1
        # a context of the second level, two or three occurrences, stands for one and for two without its own
        most = np.maximum((1 << self.two_before) - 2, 0)
        b, n_b = mixture(np.where(most > 0, less(self.three) / np.maximum(most, 1), 0), p2, np.where(most > 0, self.two_before, 0))
        one = self.two_before == 2
        b_one, n_one = mixture(np.minimum(less(self.three), 1)[one], p2[one], np.ones(int(one.sum()), np.int64))
        b[1], n_b[1] = b_one[1], n_one[1]
        return [(order, k, float(w[k]), int(n[k])) for order, w, n in ((PAIR, a, n_a), (TRIPLE, b, n_b)) for k in range(1, LEVELS + 1) if n[k]]


def smoothed(p1, two, c_before, three, two_before, a, b) -> np.ndarray:
    """p3 of the module's formula, of arrays over tokens."""
    weight = np.where(c_before > 0, a[level_of(c_before)], 0)
    p2 = weight * two / np.maximum(c_before, 1) + (1 - weight) * p1
    most = (1 << two_before) - 1
    weight = np.where(two_before > 0, b[two_before], 0)
    return weight * np.minimum(three, most) / np.maximum(most, 1) + (1 - weight) * p2


def mixture(high: np.ndarray, low: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By level the weight of high against low that makes the tokens likeliest, and the number of tokens; level 0 is left out."""
    known = (level > 0) & (low > 0)
    high, low, level = high[known], low[known], level[known]
    n = np.bincount(level, minlength=LEVELS + 1)
    # the steps go over counts of ratios by level: 0, or FINE bins an octave, each with its mean of logarithms
    ratio = np.log2(np.maximum(high, 1e-300) / low)
    bins = np.where(high > 0, np.clip(np.floor(ratio * FINE).astype(np.int64) + BINS // 2, 1, BINS - 1), 0) + level * BINS
    held = np.bincount(bins, minlength=(LEVELS + 1) * BINS)
    mean = np.exp2(np.bincount(bins, ratio, (LEVELS + 1) * BINS) / np.maximum(held, 1)).reshape(LEVELS + 1, BINS)
    mean[:, 0], held = 0.0, held.reshape(LEVELS + 1, BINS)
    weight = np.full(LEVELS + 1, 0.5)
    for _ in range(FIT_STEPS):
        own = weight[:, None]
        part = own * mean / (own * mean + 1 - own)
        weight = np.clip((held * part).sum(1) / np.maximum(n, 1), 0.001, 0.999)
    return weight, n


def filled(weight: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights, where a level has no tokens the one below it."""
    out, last = np.zeros(LEVELS + 1), UNFITTED
    for k in range(1, LEVELS + 1):
        last = out[k] = weight[k] if n[k] else last
    return out


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", held_out=None, weights: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: a boolean column; those rows teach nothing. weights: A and B by level, otherwise fitted."""
    ship(docs.sparkSession)
    held_out = remainder(id_column, FOLDS) == HELD if held_out is None else held_out
    placed, size, bits, tasks = blocks_of(docs, id_column, text_column, held_out.alias("held_out"))
    drop = np.uint64(max(0, 64 - max(bits, size.bit_length() + MARGIN)))

    def texts_of(group: pa.Table) -> list[bytes]:
        return group.column("text").cast(pa.binary()).to_pylist()

    def send(key, group):
        words, ends = tokens(texts_of(group))
        taught = np.repeat(~np.array(group.column("held_out").to_pylist(), bool), np.diff(ends, prepend=0)).astype(np.int64)
        rows = []
        for kind, entries in zip((WORD, PAIR, TRIPLE), (words, *triples(words, ends, drop)), strict=True):
            hashes, counts = summed([entries], [taught])
            rows += [(b, key[0].as_py(), kind, packed(hashes[s]), sparse(counts[s])) for b, s in dealt(hashes, bits, 64 if kind == WORD else 64 - int(drop))]
        return table_of(SENT, rows)

    def count(key, sent):
        kinds, senders = sent.column("kind").to_pylist(), sent.column("block").to_pylist()
        hashes, numbers = sent.column("hashes").to_pylist(), sent.column("counts").to_pylist()
        bucket, rows = key[0].as_py(), []
        for kind in (WORD, PAIR, TRIPLE):
            own = [i for i, k in enumerate(kinds) if k == kind]
            arrays = [unpacked(hashes[i]) for i in own]
            distinct, counts = summed(arrays, [unsparse(numbers[i]) for i in own])
            if kind == WORD:
                rows += [(bucket, senders[i], WORD, packed(x), planes(counts[np.searchsorted(distinct, x)])) for i, x in zip(own, arrays, strict=True)]
                rows.append((bucket, -1, TOTALS, b"", planes(np.array([(counts > 0).sum(), counts.sum()], np.int64))))
            else:
                # a block knows its entries of a bucket in this order
                levels = found_levels(distinct, counts)
                rows += [(bucket, senders[i], kind, b"", sparse(levels[np.searchsorted(distinct, x)].astype(np.int64))) for i, x in zip(own, arrays, strict=True)]
        return table_of(SENT, rows)

    sent = placed.groupBy("block").applyInArrow(send, SCHEMA).repartition(tasks, "bucket")
    counted = checkpointed(sent.groupBy("bucket").applyInArrow(count, SCHEMA))
    totals = [unplaned(bytes(r.counts)) for r in counted.where(F.col("kind") == TOTALS).select("counts").toLocalIterator()]
    distinct, total = (int(sum(t[i] for t in totals)) for i in (0, 1))
    back = counted.where(F.col("kind") != TOTALS)

    def fit(key, group, known):
        del key
        group_words, ends = tokens(texts_of(group))
        held = Known(group_words, ends, known, drop)
        taught = np.repeat(~np.array(group.column("held_out").to_pylist(), bool), np.diff(ends, prepend=0))
        for name in ("c", "two", "three", "c_before", "two_before"):
            setattr(held, name, getattr(held, name)[taught])
        return table_of([("kind", pa.int64()), ("level", pa.int64()), ("weight", pa.float64()), ("n", pa.int64())], held.fit(total, distinct))

    if weights is None:
        fitted = checkpointed(placed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(fit, "kind long, level long, weight double, n long"))
        # at most a row for each block, order and level
        rows = fitted.groupBy("kind", "level").agg((F.sum(F.col("weight") * F.col("n")) / F.sum("n")).alias("weight"), F.sum("n").alias("n")).collect()
        weights = tuple(filled(*(np.array([next((r[c] for r in rows if (r.kind, r.level) == (order, k)), 0) for k in range(LEVELS + 1)]) for c in ("weight", "n"))) for order in (PAIR, TRIPLE))
    a, b = weights

    def scored(key, group, known):
        del key
        words, ends = tokens(texts_of(group))
        held = Known(words, ends, known, drop)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        base, model = (np.add.reduceat(np.log10(x), starts) if len(starts) else np.zeros(0) for x in held.probabilities(total, distinct, a, b))
        n_known = np.add.reduceat((held.c > 0).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        return pa.table(
            [group.column("id"), group.column("held_out"), np.diff(ends, prepend=0), n_known, np.full(len(ends), total, np.int64), base, model],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    id_type = placed.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return placed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(scored, schema).withColumnRenamed("id", id_column)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
