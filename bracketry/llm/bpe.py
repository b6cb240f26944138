"""BPE encoding and decoding.

Text is cut at special tokens and then into pre-tokens; each pre-token's bytes
are merged with a segment tree over the ranks of its adjacent pairs. A leaf holds
the rank above the position, so the root is the leftmost pair of lowest rank; a
merge changes at most three leaves, each a logarithmic update. The loop ends when
the root is empty.

Defined results: a null text encodes as the empty text (an empty list of ids); a
null list of ids decodes to the empty text. Repeated rows, ties and extra columns
pass through unchanged; an empty table gives an empty table. Very long pieces cost
n log n and aren't cached. Bytes that form no valid UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bracketry.llm.common import broadcast_bytes, packed_row, resident, ship, table, unpacked_row

#: Bound on the tokenizer file that is broadcast (compressed).
MAX_TOKENIZER_BYTES = 64 << 20
#: Entries of a generation of the per-worker cache of encoded chunks, and the text that is encoded at once.
CACHE_ENTRIES, GROUP_CHARS = 1 << 17, 1 << 20
#: Children of a node of the segment tree.
FAN = 16
#: Above every rank.
NO_RANK = 1 << 31

# Unicode White_Space, as the tokenizer's regular expressions read \s.
WHITE = "\t-\r \x85\xa0  -     　"
# Fixed value: the public byte-level BPE pre-tokenisation pattern.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: A chunk is white space and what follows it up to the next; no piece crosses from non-space to space.
CHUNKS = re.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, others take code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTree:
    """Segment tree of fan-out FAN over the ranks of adjacent pairs of one piece; the last level is the root."""

    __slots__ = ("levels",)

    def __init__(self, leaves: list[int]):
        self.levels = levels = [leaves]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])

    def put(self, i: int, leaf: int) -> None:
        levels = self.levels
        below = levels[0]
        below[i] = leaf
        for above in levels[1:]:
            i //= FAN
            low = min(below[i * FAN : i * FAN + FAN])
            if above[i] == low:
                return
            above[i] = low
            below = above


class PairRanks:
    """Ranks of pairs of ids, looked up for whole arrays: a hash table with linear probing."""

    BITS = 18

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, NO_RANK, np.int64)
        keys, rank = left.astype(np.int64) << 32 | right, np.arange(len(left))
        keys, first = np.unique(keys, return_index=True)
        rank = rank[first]
        self.probes = 0
        while len(keys):
            slot = self.slot(keys) + self.probes & (1 << self.BITS) - 1
            _, pick = np.unique(slot, return_index=True)
            pick = pick[self.keys[slot[pick]] < 0]
            self.keys[slot[pick]], self.ranks[slot[pick]] = keys[pick], rank[pick]
            keys, rank = np.delete(keys, pick), np.delete(rank, pick)
            self.probes += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = self.slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NO_RANK)
        open_ = np.flatnonzero((out == NO_RANK) & (self.keys[slot] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = slot[open_] + step & (1 << self.BITS) - 1
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (self.keys[at] >= 0)]
        return out


class ByteBpe:
    """A byte-level BPE tokenizer read from a tokenizers JSON file's text."""

    def __init__(self, spec: str):
        import regex

        read = json.loads(spec)
        vocab, merges = read["model"]["vocab"], read["model"]["merges"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.byte_id = [vocab[alphabet[b]] for b in range(256)]
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in reversed([*enumerate(pairs)])}
        self.merged = [vocab[a + b] for a, b in pairs]
        added = {x["content"]: x["id"] for x in read.get("added_tokens", [])}
        self.special = added
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.pieces = regex.compile(PIECES)
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        ids = np.array([[vocab[a], vocab[b]] for a, b in pairs], np.int64).reshape(-1, 2)
        self.pairs, self.merged_ids = PairRanks(ids[:, 0], ids[:, 1]), np.array(self.merged, np.int64)
        self.byte_ids = np.array(self.byte_id, np.int64)
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of many pieces: all trees of one size take their next merge together."""
        out: list[list[int]] = [[]] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        for low, leaves in ((0, 8), (8, 16), (16, 32), (32, 64)):
            group = np.flatnonzero((sizes > low) & (sizes <= leaves))
            for at in range(0, len(group), 1 << 15):
                rows = group[at : at + (1 << 15)]
                for i, ids in zip(rows.tolist(), self._merge_equal([pieces[i] for i in rows], sizes[rows], leaves), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > 64).tolist():
            out[i] = self.merge(pieces[i])
        return out

    def _merge_equal(self, pieces: list[bytes], sizes: np.ndarray, leaves: int) -> list[list[int]]:
        n, none = len(pieces), np.int64(NO_RANK) * leaves
        ids = np.full((n, leaves + 1), -1, np.int64)
        ids[np.arange(leaves + 1) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, leaves)
        tree = np.full((n, 2 * leaves), none, np.int64)
        tree[:, leaves:] = np.where((ids[:, 1:] < 0) | (rank == NO_RANK), none, rank * leaves + np.arange(leaves))
        k = leaves // 2
        while k:
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
            k //= 2
        flat = tree.ravel()
        after = np.tile(np.arange(1, leaves + 3, dtype=np.int64), (n, 1))
        before = after - 2

        def put(base: np.ndarray, i: np.ndarray, leaf: np.ndarray) -> None:
            k = i + leaves
            flat[base + k] = leaf
            for _ in range(leaves.bit_length() - 1):
                k = k >> 1
                at = base + 2 * k
                flat[base + k] = np.minimum(flat[at], flat[at + 1])

        def leaf_of(i: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            rank = self.pairs.find(left, right)
            return np.where(rank == NO_RANK, none, rank * leaves + i)

        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            root, base = tree[live, 1], live * (2 * leaves)
            i, new = root % leaves, self.merged_ids[root // leaves]
            gone = after[live, i]
            right = after[live, gone]
            ids[live, i], ids[live, gone], after[live, i] = new, -1, right
            inner = gone < leaves
            put(base[inner], gone[inner], np.full(inner.sum(), none))
            more = right < sizes[live]
            before[live[more], right[more]] = i[more]
            leaf = np.full(len(live), none)
            leaf[more] = leaf_of(i[more], new[more], ids[live[more], right[more]])
            put(base, i, leaf)
            left = before[live, i]
            has = left >= 0
            put(base[has], left[has], leaf_of(left[has], ids[live[has], left[has]], new[has]))
            live = live[tree[live, 1] < none]
        kept = ids >= 0
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        flat_ids = ids[kept].tolist()
        return [flat_ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        byte_id, rank, merged = self.byte_id, self.rank.get, self.merged
        ids = [byte_id[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        shift = n.bit_length()
        none = NO_RANK << shift
        tree = PairTree([rank(a << 32 | b, NO_RANK) << shift | i for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))])
        top, put, mask = tree.levels[-1], tree.put, (1 << shift) - 1
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while (root := top[0]) < none:
            i = root & mask
            ids[i] = new = merged[root >> shift]
            gone = after[i]
            ids[gone] = -1
            after[i] = right = after[gone]
            if gone < n - 1:
                put(gone, none | gone)
            if right < n:
                before[right] = i
                put(i, rank(new << 32 | ids[right], NO_RANK) << shift | i)
            else:
                put(i, none | i)
            left = before[i]
            if left >= 0:
                put(left, rank(ids[left] << 32 | new, NO_RANK) << shift | left)
        return [i for i in ids if i >= 0]

    def _learn(self, wanted: set[str]) -> None:
        """Put every wanted chunk into self.chunks; an older generation is kept as long as the new one grows."""
        if len(self.chunks) > CACHE_ENTRIES:
            self.older, self.chunks = self.chunks, {}
        older, missing = self.older, []
        for chunk in wanted:
            if chunk in self.chunks:
                continue
            if (packed := older.get(chunk)) is None:
                missing.append(chunk)
            else:
                self.chunks[chunk] = packed
        cut = list(map(self.pieces.findall, missing))
        pieces = list(set(chain.from_iterable(cut)))
        ids = dict(zip(pieces, self.merge_many([p.encode() for p in pieces]), strict=True))
        for chunk, parts in zip(missing, cut, strict=True):
            self.chunks[chunk] = array("i", chain.from_iterable(map(ids.__getitem__, parts))).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native int32; texts are taken some GROUP_CHARS at a time."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= GROUP_CHARS):
                chars += len(texts[end])
                end += 1
            cut = [[CHUNKS.findall(part) if part not in self.special else part for part in self._parts(t)] for t in texts[at:end]]
            self._learn({chunk for parts in cut for part in parts if isinstance(part, list) for chunk in part})
            known = self.chunks.__getitem__
            for parts in cut:
                out.append(b"".join([b"".join(map(known, p)) if isinstance(p, list) else array("i", [self.special[p]]).tobytes() for p in parts]))
            at = end
        return out

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_many([text])[0]).tolist()

    def _parts(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut else [text]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _tokenizer(shared) -> ByteBpe:
    payload = shared.value
    return resident(("bpe", zlib.crc32(payload)), lambda: ByteBpe(zlib.decompress(payload).decode()))


class Bpe:
    """Column builders for one tokenizer file; the path is read on the driver and its content broadcast."""

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        with open(path, "rb") as f:
            self.shared = broadcast_bytes(spark, zlib.compress(f.read()), MAX_TOKENIZER_BYTES)

    def encode(self, text: Column) -> Column:
        shared = self.shared

        def encoded(texts: pa.Array) -> pa.Array:
            return _lists(_tokenizer(shared).encode_many([t or "" for t in texts.to_pylist()]))

        return F.arrow_udf(encoded, T.ArrayType(T.IntegerType()))(text)

    def decode(self, ids: Column) -> Column:
        shared = self.shared

        def decoded(lists: pa.Array) -> pa.Array:
            bpe = _tokenizer(shared)
            return pa.array([bpe.decode(x.values.to_pylist() if x.is_valid else []) for x in lists], pa.string())

        return F.arrow_udf(decoded, T.StringType())(ids)

    def both(self, text: Column) -> Column:
        """struct<ids, decoded>: encoding and then decoding of the ids in one worker, so that texts pass through Python once."""
        shared = self.shared

        def coded(texts: pa.Array) -> pa.Array:
            bpe = _tokenizer(shared)
            packed = bpe.encode_many([t or "" for t in texts.to_pylist()])
            decoded = pa.array([bpe.decode(np.frombuffer(x, np.int32).tolist()) for x in packed], pa.string())
            return pa.StructArray.from_arrays([_lists(packed), decoded], ["ids", "decoded"])

        return F.arrow_udf(coded, "ids array<int>, decoded string")(text)


def _lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with the ids of each whole text in column `ids`."""
    return docs.withColumn(ids, Bpe(docs.sparkSession, path).encode(F.col(text)))


def decode_documents(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """docs with the text that each list of ids stands for in column `text`."""
    return docs.withColumn(text, Bpe(docs.sparkSession, path).decode(F.col(ids)))


def code_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """docs with the ids of each whole text and the text that those ids decode to; input columns of these two names give way."""
    coded = docs.select(packed_row(docs, ids, decoded).alias("__doc"), Bpe(docs.sparkSession, path).both(F.col(text)).alias("__coded"))
    return coded.select(*unpacked_row(docs, "__doc", ids, decoded), F.col("__coded.ids").alias(ids), F.col("__coded.decoded").alias(decoded))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = code_documents(docs, path)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
