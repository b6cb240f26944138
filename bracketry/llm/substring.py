"""Substring dedup by level-wise doubling.

Level one takes every window of two words and asks which of them stand more than once
in the corpus. Only where a window and the one that follows it are repeated are the two
joined to a window of twice the length, which the next level asks for: 2, 4, 8, and at
last the length asked for, joined of two windows that overlap. Every other position is
dropped, so a level carries only what the one before left (`survivors` counts them),
and when no candidate survives, nothing is left to send. Candidates that survive the
last level in a document after another are the repeats. The doubling ends at the length
asked for: longer windows consist of windows of that length and would remove no further
word.

Texts are dealt into blocks by a hash of row, text and input partition. A block sends
one packed, sorted and delta-coded array of distinct hashes to each bucket of hashes (a
passage that a third of all rows holds is one entry for each block), and gets back
those entries that other blocks hold as well. The levels before the last are filters:
they compare FILTER_MARGIN bits more than the number of the corpus's windows has. The
last level compares these and CHECK_BITS of a second, independent hash: among 10^13
windows a false match of any two is expected in a thousandth of corpora, so words are
taken for equal without being sent.

Defined results: null and empty texts have no words; rows of one doc_id never remove
each other's words; a row whose doc_id is null removes nothing and loses nothing;
an empty table gives an empty table. Ids of whole numbers are ordered as numbers, those
of other types as their text. Extra columns stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bracketry.llm.common import ship, table

#: Words of a window; text bytes of a block and of a task; hashes of a bucket; bits of a hash beyond the number of windows, and of the second hash.
WINDOW, BLOCK_BYTES, TASK_BYTES, BUCKET_HASHES, FILTER_MARGIN, CHECK_BITS = 13, 8 << 20, 64 << 20, 1 << 20, 4, 48
#: Bytes whose words are hashed at once.
PIECE = 1 << 20

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Base of the polynomial hash of a word's bytes, and its inverse by 2^64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
# ASCII white space.
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * M2
    h = (h ^ h >> np.uint64(32)) * M3
    return h ^ h >> np.uint64(31)


def ladder(window: int) -> list[int]:
    """The lengths of the levels: doubled from two words on, the last the window itself."""
    lengths = [min(2, window)]
    while lengths[-1] < window:
        lengths.append(min(2 * lengths[-1], window))
    return lengths


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse up to n."""
    held = _POWERS.get(0)
    if held is None or len(held[0]) < n:
        size = max(n, PIECE + 1)
        held = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (BASE, INVERSE))
        if size == PIECE + 1:
            _POWERS[0] = held
    return held


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of data, all words at once, and where each begins."""
    whole, hashes, starts, at = np.frombuffer(data, np.uint8), [], [], 0
    while at < len(whole):
        end = at + PIECE
        if end < len(whole):
            gaps = np.flatnonzero(SPACE[whole[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                # a word longer than a piece: on to its end
                while end < len(whole) and not SPACE[whole[end]]:
                    end += 1
        piece = whole[at:end]
        gap = np.concatenate([[True], SPACE[piece], [True]])
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        first, last = edges[::2], edges[1::2]
        up, down = powers(len(piece) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)])])
        hashes.append(mixed((sums[last] - sums[first]) * down[first]))
        starts.append(first + at)
        at = end
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)


class Block:
    """The words of a block's texts one after the other."""

    def __init__(self, docs: pa.Table):
        self.texts = [t or b"" for t in docs.column("text").cast(pa.binary()).to_pylist()]
        self.ids = docs.column("id").to_pylist()
        self.words, starts = hashed_words(b"\n".join(self.texts))
        ends = np.cumsum([len(t) + 1 for t in self.texts])
        self.ends = np.searchsorted(starts, ends, "left")
        self.counts = np.diff(self.ends, prepend=0)
        self.doc = np.repeat(np.arange(len(self.texts)), self.counts)
        self.left = np.repeat(self.ends, self.counts) - np.arange(len(self.words))

    def windows(self, lengths: list[int]) -> np.ndarray:
        """The hash of the window of the last of the lengths at each word; near the end of a text it means nothing."""
        h = self.words
        for before, length in zip([1, *lengths], lengths, strict=False):
            far = length - before
            h = np.concatenate([mixed(h[: max(0, len(h) - far)] * M1 + h[far:] * M2 + np.uint64(length)), h[max(0, len(h) - far) :]]) if far else h
        return h

    def able(self, window: int) -> np.ndarray:
        """Whether each word is of a document that has an id and a whole window."""
        named = np.array([i is not None for i in self.ids], bool)
        return (named & (self.counts >= window))[self.doc]

    def checks(self, docs: np.ndarray, window: int) -> np.ndarray:
        """A second hash of the window at each word of some documents, of other hashes of their words; zero elsewhere."""
        import xxhash

        out = np.zeros(len(self.words), np.uint64)
        for d in docs.tolist():
            words = self.texts[d].split()
            own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            n = len(words) - window + 1
            h = np.zeros(max(0, n), np.uint64)
            for k in range(window):
                h = mixed(h * M3 + own[k : k + len(h)])
            at = self.ends[d] - self.counts[d]
            out[at : at + len(h)] = h >> np.uint64(64 - CHECK_BITS)
        return out


def planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, as many planes as the largest needs (a negative one needs all); their number stands first."""
    bare = values.astype(np.uint64)
    used = max(1, (int(bare.max(initial=0)).bit_length() + 7) // 8)
    return bytes([used]) + bare.view(np.uint8).reshape(-1, 8).T[:used].tobytes()


def unplaned(data: bytes) -> np.ndarray:
    used = data[0]
    out = np.zeros(((len(data) - 1) // used, 8), np.uint8)
    out[:, :used] = np.frombuffer(data, np.uint8, offset=1).reshape(used, -1).T
    return out.view(np.int64).ravel()


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers as differences: of each the low bits that the mean has, and the rest as so many zeros before a one. Some two and a half bits more than the mean's logarithm for each."""
    gaps = np.diff(values, prepend=np.uint64(0))
    n = len(gaps)
    if not n:
        return b""
    # the first number counts from zero and says nothing about the gaps
    low = max(0, (int(values[-1] - values[0]) // max(1, n - 1)).bit_length() - 1)
    first, gaps[0] = int(gaps[0]), 0
    low_bits = np.packbits(np.unpackbits(gaps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=low or 1)[:, :low], bitorder="little").tobytes()
    ones = np.cumsum((gaps >> np.uint64(low)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    return first.to_bytes(8, "little") + n.to_bytes(4, "little") + bytes([low]) + low_bits + np.packbits(unary, bitorder="little").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    first, n, low = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:12], "little"), data[12]
    end = 13 + (n * low + 7) // 8
    gaps = np.zeros((n, 64), np.uint8)
    if low:
        gaps[:, :low] = np.unpackbits(np.frombuffer(data, np.uint8, end - 13, 13), bitorder="little", count=n * low).reshape(n, low)
    gaps = np.packbits(gaps, axis=1, bitorder="little").view(np.uint64).ravel()
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=end), bitorder="little"))
    gaps += (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(low)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(first)


def sparse(values: np.ndarray) -> bytes:
    """Numbers that are mostly one: a bit for each, and those that aren't."""
    other = values != 1
    return len(values).to_bytes(4, "little") + np.packbits(other, bitorder="little").tobytes() + planes(values[other])


def unsparse(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    end = 4 + (n + 7) // 8
    other = np.unpackbits(np.frombuffer(data, np.uint8, end - 4, 4), bitorder="little", count=n).astype(bool)
    out = np.ones(n, np.int64)
    out[other] = unplaned(data[end:])
    return out


def dealt(values: np.ndarray, bits: int, width: int = 64):
    """(bucket, slice) of a sorted array of numbers of `width` bits by their top `bits`."""
    if not len(values):
        return
    bucket = (values >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True):
        yield int(bucket[a]), slice(a, b)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct numbers, sorted."""
    flat = np.sort(values)
    return flat[np.concatenate([[True], flat[1:] != flat[:-1]])] if len(flat) else flat


def repeated(values: np.ndarray) -> np.ndarray:
    """The numbers that stand twice or more, sorted."""
    flat = np.sort(values)
    return distinct(flat[1:][flat[1:] == flat[:-1]])


def maybe_known(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each number may be among some others: certain where not, by a table of their low bits."""
    mask = np.uint64((1 << min(24, max(10, (16 * len(some)).bit_length()))) - 1)
    table_ = np.zeros(int(mask) + 1, bool)
    table_[(some & mask).astype(np.int64)] = True
    return table_[(values & mask).astype(np.int64)]


def table_of(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def least_of(h: np.ndarray, c: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the least owner of its pair (h, c) and the number of its pair in the order of h, and the places of one row of each pair in that order."""
    order = np.argsort(h)
    sorted_h, sorted_c = h[order], c[order]
    first = np.ones(len(order), bool)
    first[1:] = sorted_h[1:] != sorted_h[:-1]
    if (~first[1:] & (sorted_c[1:] != sorted_c[:-1])).any():
        # different windows of one h
        order = np.lexsort((c, h))
        sorted_h, sorted_c = h[order], c[order]
        first[1:] = (sorted_h[1:] != sorted_h[:-1]) | (sorted_c[1:] != sorted_c[:-1])
    at = np.flatnonzero(first)
    by_pair = np.minimum.reduceat(owner[order], at) if len(at) else owner[:0]
    number = np.empty(len(owner), np.int64)
    number[order] = np.cumsum(first) - 1
    return by_pair[number], number, order[at]


FIRST = [("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary())]
FIRST_DDL = "bucket long, block long, n long, hashes binary"
#: What the last level sends besides, and what comes back: the hits of the level before (bucket -1), or a bit for each of a block's windows of a bucket.
LAST, LAST_DDL = [*FIRST, ("checks", pa.binary()), ("ranks", pa.binary())], f"{FIRST_DDL}, checks binary, ranks binary"


def blocks_of(docs: DataFrame, id_column: str, text_column: str, *more) -> tuple[DataFrame, int, int, int]:
    """(id, text, more, block) of every row, dealt to tasks by block, with the bytes of all texts, the bits of a bucket's number and the number of tasks."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    # rows that are alike in all but come from many input partitions are spread by these
    block = F.pmod(F.xxhash64(F.col(id_column), text, F.spark_partition_id()), F.lit(blocks))
    placed = docs.select(F.col(id_column).alias("id"), text.alias("text"), *more, block.alias("block")).repartition(tasks, "block")
    return placed, size, max(1, (size // 6 // BUCKET_HASHES).bit_length()), tasks


def filters(placed: DataFrame, size: int, bits: int, tasks: int, window: int) -> tuple[list[tuple[int, DataFrame, DataFrame]], np.uint64]:
    """Of each level before the last its length, what blocks send and what they get back; and the bits that hashes drop."""
    lengths = ladder(window)
    drop = np.uint64(max(0, 64 - max(bits, (size // 6).bit_length() + FILTER_MARGIN)))

    def sender(level: int):
        def send(key, docs, hits=None):
            flat = distinct(candidates(Block(docs), lengths[: level + 1], window, hits, drop)[0])
            return table_of(FIRST, [(b, key[0].as_py(), s.stop - s.start, packed(flat[s])) for b, s in dealt(flat, bits, 64 - int(drop))])

        return (lambda key, docs: send(key, docs)) if level == 0 else (lambda key, docs, hits: send(key, docs, hits))

    def find(key, sent):
        arrays = [unpacked(x) for x in sent.column("hashes").to_pylist()]
        again = repeated(np.concatenate(arrays))
        hits = [(block, a[maybe_known(a, again)]) for block, a in zip(sent.column("block").to_pylist(), arrays, strict=True)]
        return table_of(FIRST, [(key[0].as_py(), block, len(a), packed(a)) for block, a in hits if len(a)])

    out, hits = [], None
    for level, length in enumerate(lengths[:-1]):
        dealt_out = placed.groupBy("block")
        sent = dealt_out.applyInArrow(sender(0), FIRST_DDL) if level == 0 else dealt_out.cogroup(hits.groupBy("block")).applyInArrow(sender(level), FIRST_DDL)
        hits = sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(find, FIRST_DDL)
        out.append((length, sent, hits))
    return out, drop


def candidates(block: Block, lengths: list[int], window: int, hits: pa.Table | None, drop: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the windows of the last length that may be repeated, and their places. hits: the repeated ones of the length before."""
    able = block.able(window)
    ok = able & (block.left >= lengths[-1])
    if hits is not None:
        earlier = block.windows(lengths[:-1]) >> drop
        valid = able & (block.left >= lengths[-2])
        shared = np.concatenate([*[unpacked(x) for x in hits.column("hashes").to_pylist()], repeated(earlier[valid])])
        live = valid & maybe_known(earlier, shared)
        far = lengths[-1] - lengths[-2]
        ok &= live
        ok[: len(ok) - far] &= live[far:]
    at = np.flatnonzero(ok)
    return block.windows(lengths)[at] >> drop, at


def survivors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """(length, candidates, repeated) of each level before the last: the windows, distinct in each block, that it asks for, and those of them that other blocks hold too."""
    ship(docs.sparkSession)
    out = None
    for length, sent, hits in filters(*blocks_of(docs, id_column, text_column), window)[0]:
        total = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
        one = total(sent, "candidates").crossJoin(total(hits, "repeated")).select(F.lit(length).alias("length"), "candidates", "repeated")
        out = one if out is None else out.unionByName(one)
    return out


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    ship(docs.sparkSession)
    own_type = docs.schema[id_column].dataType
    whole = isinstance(own_type, T.IntegralType)
    id_type = "long" if whole else "string"
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    docs = docs.withColumn("id", F.col("id").cast(id_type))
    placed, size, bits, tasks = blocks_of(docs, "id", "text")
    lengths = ladder(window)
    levels, drop = filters(placed, size, bits, tasks, window)
    names_type = pa.list_(pa.int64() if whole else pa.string())
    sent_schema, width = [*LAST, ("names", names_type)], 64 - int(drop)

    def wholes(block: Block, hits: pa.Table | None):
        """The candidates of the last level: hashes, second hashes, places, the ranks of their ids and all ids, and what least_of says of them."""
        h, at = candidates(block, lengths, window, hits, drop)
        c = block.checks(np.flatnonzero(np.bincount(block.doc[at], minlength=1)), window)[at]
        names = sorted({i for i in block.ids if i is not None})
        place = {name: k for k, name in enumerate(names)}
        owner = np.array([place.get(i, -1) for i in block.ids], np.int64)[block.doc[at]]
        return h, c, at, owner, names, *least_of(h, c, owner)

    def send(key, docs, hits=None):
        h, c, _, _, names, least, _, first = wholes(Block(docs), hits)
        h, c, owner = h[first], c[first], least[first]
        rows = []
        for b, s in dealt(h, bits, width):
            used, place = np.unique(owner[s], return_inverse=True)
            rows.append((b, key[0].as_py(), s.stop - s.start, packed(h[s]), planes(c[s]), planes(place), [names[k] for k in used.tolist()]))
        return table_of(sent_schema, rows)

    def find(key, sent):
        hashes = [unpacked(x) for x in sent.column("hashes").to_pylist()]
        checks = [unplaned(x).view(np.uint64) for x in sent.column("checks").to_pylist()]
        names = sent.column("names").to_pylist()
        place = {name: k for k, name in enumerate(sorted({x for own in names for x in own}))}
        owners = [np.array([place[x] for x in own], np.int64)[unplaned(r)] for own, r in zip(names, sent.column("ranks").to_pylist(), strict=True)]
        least = least_of(np.concatenate(hashes), np.concatenate(checks), np.concatenate(owners))[0]
        rows, at = [], 0
        for block, own in zip(sent.column("block").to_pylist(), owners, strict=True):
            rows.append((key[0].as_py(), block, len(own), np.packbits(least[at : at + len(own)] < own).tobytes()))
            at += len(own)
        return table_of(FIRST, rows)

    def remove(key, docs, back):
        del key
        block = Block(docs)
        own = back.column("bucket").to_numpy() < 0
        _, _, at, owner, _, least, number, first = wholes(block, back.filter(pa.array(own)) if len(lengths) > 1 else None)
        # the answers stand in the order of the buckets, so in that of the block's distinct windows
        answers = sorted((r["bucket"], r["n"], r["hashes"]) for r in back.filter(pa.array(~own)).to_pylist())
        earlier = np.concatenate([*[np.unpackbits(np.frombuffer(x, np.uint8), count=n) for _, n, x in answers], np.zeros(0, np.uint8)]).astype(bool)
        if len(earlier) != len(first):
            raise RuntimeError("a block's rows changed between two readings: the input isn't the same when read twice")
        # a document before all of this block's that hold the window, or before this one in the block
        hit = earlier[number] | (least < owner)
        cover = np.zeros(len(block.words) + window + 1, np.int64)
        cover[at[hit]] += 1
        cover[at[hit] + window] -= 1
        covered = np.cumsum(cover)[: len(block.words)] > 0
        upto = np.concatenate([[0], np.cumsum(covered)])
        begin = block.ends - block.counts
        removed = upto[block.ends] - upto[begin]
        kept = []
        for text, gone, s, e in zip(block.texts, removed.tolist(), begin.tolist(), block.ends.tolist(), strict=True):
            words = text.split()
            kept.append(b" ".join([w for w, x in zip(words, covered[s:e].tolist(), strict=True) if not x] if gone else words))
        return pa.table([docs.column("id"), pa.array(block.counts), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    dealt_out, last = placed.groupBy("block"), f"{LAST_DDL}, names array<{id_type}>"
    sent = dealt_out.cogroup(levels[-1][2].groupBy("block")).applyInArrow(lambda key, docs, hits: send(key, docs, hits), last) if levels else dealt_out.applyInArrow(lambda key, docs: send(key, docs), last)
    back = sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(find, FIRST_DDL)
    if levels:
        back = back.unionByName(levels[-1][2].withColumn("bucket", F.lit(-1).cast("long")))
    # one job: all readers of the dealt texts share one exchange
    out = placed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(remove, f"id {id_type}, n_words long, n_removed long, kept string")
    return out.select(F.col("id").cast(own_type).alias(id_column), "n_words", "n_removed", "kept")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
