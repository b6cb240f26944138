"""SimHash near-dedup through Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into four segments of 16. Two fingerprints at most
three bits apart agree wholly in some segment i whose successor j = i + 1 (mod 4)
differs in at most two bits: were that false for every agreeing segment, the
differing bits would number more than three. Segment j, padded to 23 bits, is
decoded by the perfect binary Golay code together with its 23 single-bit
neighbours; words at distance two or less then share a decoded codeword, and a
word has six codewords at most. So each fingerprint has at most 24 keys
``(i, segment i, codeword of segment j)``, every link shares one, and members of a
key's bucket are verified by their Hamming distance. Of a bucket only a spanning
forest of its links leaves the task, which keeps components and stays linear in
the bucket. Buckets above BUCKET fingerprints are dealt out as pairs of blocks.

Equal fingerprints are one node from the start, so groups of copies, however
large, are summed to one row before any join.

Near copies by their shingles (`dedup_similar`: five words, Jaccard similarity 0.8 or
more) differ in more bits than exact segments bear: some ten of 64 at 0.8. Their keys
are therefore taken before the sums of the shingle hashes are cut to bits: 24 sums are
a segment, and its PROBES nearest words of the extended Golay code (24, 12, 8), by the
inner product with the sums, are its codewords. A key holds a codeword of each segment
of a table. At similarity 0.8 two texts share a codeword of a segment in 0.74 of cases,
both of a table in 0.54 and one of four tables in 0.96; at 0.9 in more than 0.999
(simulated with Gaussian sums; unrelated texts: 2e-5). Members of a bucket within
SKETCH_BITS of 128 bits are candidates; components of candidates are gathered with
their texts, and every link is decided by the shingles themselves. Components of more
text than GROUP_BYTES are dealt out as pairs of blocks.

Defined results: null texts, empty texts and white space have fingerprint zero and
are linked like any other; rows of one doc_id are one document, its rows keep
their own fingerprints, and each row has the component of its own fingerprint; a
null doc_id is never a component id: such a row gets the smallest id that its
fingerprint reaches, or null. Texts of fewer words than a shingle are one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bracketry.llm.common import checkpointed, packed_row, ship, table, unpacked_row

#: Words of a shingle, hash seed, and the most bits in which linked fingerprints differ.
SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Fingerprints of a bucket that are compared in one task.
BUCKET = 8192
#: Shingles whose bits are summed at once.
STEP = 1 << 14
#: Near copies: words of a shingle, the least similarity as a fraction, codewords of a segment, bits in which candidates may differ, and text bytes of a block.
SIMILAR_WORDS, SIMILAR, PROBES, SKETCH_BITS, GROUP_BYTES = 5, (4, 5), 3, 32, 4 << 20
#: Documents whose segments are decoded at once.
DECODED = 32

# Fixed value: generator polynomial of the perfect binary Golay code (23, 12, 7).
GENERATOR = 0b101011100011
# The bytes that separate words, and upper case to lower case.
WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def golay_remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial: the 11-bit syndrome."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ GENERATOR << bit - 11, left)
    return left


def golay_decoder() -> np.ndarray:
    """The error pattern of weight three at most for each of the 2048 syndromes."""
    ones = 1 << np.arange(23, dtype=np.int64)
    errors = [np.zeros(1, np.int64), ones]
    for weight in (2, 3):
        grown = (errors[weight - 1][:, None] | ones).ravel()
        errors.append(np.unique(grown[np.array([int(x).bit_count() == weight for x in grown])]))
    patterns = np.concatenate(errors)
    table_ = np.zeros(2048, np.int64)
    table_[golay_remainder(patterns)] = patterns
    return table_


def golay_indices(words: np.ndarray, decoder: np.ndarray) -> np.ndarray:
    """The index (upper twelve bits) of the codeword nearest to each 23-bit word."""
    return (words ^ decoder[golay_remainder(words)]) >> 11


def segment_keys() -> np.ndarray:
    """For each 16-bit segment, padded with seven zeros, the six (or fewer, repeated) codeword indices of itself and its single-bit neighbours."""
    decoder = golay_decoder()
    words = np.arange(1 << 16, dtype=np.int64) << 7
    around = np.stack([golay_indices(words ^ flip, decoder) for flip in [0, *(1 << b for b in range(23))]], axis=1)
    around.sort(axis=1)
    fresh = np.ones_like(around, bool)
    fresh[:, 1:] = around[:, 1:] != around[:, :-1]
    keys = np.repeat(around[:, :1], 6, axis=1)
    rows, at = np.nonzero(fresh)
    rank = np.cumsum(fresh, axis=1)[rows, at] - 1
    keys[rows, rank] = around[rows, at]
    return keys.astype(np.uint16)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: -SHINGLE].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        part = hashes[at : at + STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column) -> Column:
    """The fingerprint of each whole text as a signed long of the same bits."""

    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))

    return F.arrow_udf(fingerprints, T.LongType())(text)


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """(fp, node) to (key, fp, node): the fuzzy keys of every fingerprint."""

    def keyed(batches):
        codewords = segment_keys()
        for batch in batches:
            fp, node = batch.column("fp").to_numpy(), batch.column("node").to_numpy()
            bits = fp.view(np.uint64)
            segments = [(bits >> np.uint64(16 * s) & np.uint64(0xFFFF)).astype(np.int64) for s in range(4)]
            rows = np.arange(len(fp))
            for i in range(4):
                found = codewords[segments[(i + 1) % 4]].astype(np.int64)
                fresh = np.ones(found.shape, bool)
                for a in range(1, found.shape[1]):
                    fresh[:, a] = (found[:, a : a + 1] != found[:, :a]).all(axis=1)
                at, which = np.nonzero(fresh)
                key = i << 28 | segments[i][at] << 12 | found[at, which]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[rows[at]]), pa.array(node[rows[at]])], ["key", "fp", "node"])

    return nodes.select("fp", "node").mapInArrow(keyed, "key long, fp long, node long")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits in which rows of unsigned fingerprint words differ (of signed ones numpy would count those of the absolute value)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(fps: np.ndarray, nodes: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Edges (smaller node, other) of a spanning forest of the links among fingerprints: each found node is compared once with what isn't found yet."""
    left, right = [], []
    todo = np.argsort(nodes, kind="stable")
    fps, nodes = fps[todo], nodes[todo]
    rest = np.arange(len(fps))
    while len(rest):
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = apart(fps[rest], fps[queue.pop()]) <= bits
            if near.any():
                found = rest[near]
                queue.extend(found.tolist())
                rest = rest[~near]
                left += [int(nodes[root])] * len(found)
                right += nodes[found].tolist()
    return left, right


def edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(keyed: DataFrame, keys: list[str], fps: list[str], bits: int) -> DataFrame:
    """(a, b): a spanning forest of the links of every bucket. Rows of a bucket follow each other; only one bucket is held at a time."""

    def linked(batches):
        held: list[tuple] = []
        held_key = None

        def emit(key_rows, fp, node):
            if len(key_rows) < 2:
                return [], []
            cuts = np.flatnonzero((key_rows[1:] != key_rows[:-1]).any(axis=1)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            sizes = ends - starts
            a, b = [], []
            for n in (2, 3, 4):
                at = starts[sizes == n]
                for x in range(n):
                    for y in range(x + 1, n):
                        near = apart(fp[at + x], fp[at + y]) <= bits
                        a += np.minimum(node[at + x], node[at + y])[near].tolist()
                        b += np.maximum(node[at + x], node[at + y])[near].tolist()
            for s, e in zip(starts[sizes > 4].tolist(), ends[sizes > 4].tolist(), strict=True):
                x, y = forest(fp[s:e], node[s:e], bits)
                a += x
                b += y
            return a, b

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
            fp, node = np.stack([batch.column(f).to_numpy().view(np.uint64) for f in fps], axis=1), batch.column("node").to_numpy()
            last = tuple(rows[-1])
            first_of_last = int(np.flatnonzero((rows != rows[-1]).any(axis=1)).max(initial=-1)) + 1
            if held_key == last and first_of_last == 0:
                held.append((rows, fp, node))
                continue
            held.append((rows[:first_of_last], fp[:first_of_last], node[:first_of_last]))
            yield edges(*emit(*(np.concatenate(x) for x in zip(*held, strict=True))))
            held, held_key = [(rows[first_of_last:], fp[first_of_last:], node[first_of_last:])], last
        if held:
            yield edges(*emit(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return keyed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(linked, "a long, b long")


def paired_blocks(rows: DataFrame, blocks: Column, *by: Column) -> DataFrame:
    """rows, each once for every pair (x, y) of blocks that its own, a hash of `by`, is in; without blocks once, as (0, 0)."""
    blocks = F.coalesce(blocks, F.lit(1))
    dealt = rows.withColumns({"own": F.pmod(F.xxhash64(*by), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))})
    return dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})


def bucket_links(keyed: DataFrame, fps: list[str], bits: int) -> DataFrame:
    """(a, b), a < b: enough links of at most `bits` bits among the rows (key, fps, node) of every bucket to keep its components."""
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET)
    large = checkpointed(large.select("key", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks")))
    if large.isEmpty():
        found = links(keyed, ["key"], fps, bits)
    else:
        dealt = paired_blocks(keyed.join(large, "key", "left"), F.col("blocks"), *map(F.col, fps))
        found = links(dealt.select("key", "x", "y", *fps, "node"), ["key", "x", "y"], fps, bits)
    return found.distinct()


def near_links(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: enough links of at most MAX_BITS bits among (fp, node) to keep every component."""
    return bucket_links(checkpointed(bucket_keys(nodes)), ["fp"], MAX_BITS)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches, by alternating large and small stars until neither the number nor a sum of hashes of the pairs changes."""
    state = lambda p: p.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    pairs = checkpointed(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = state(pairs)
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        pairs = checkpointed(small)
        after = state(pairs)
        if after == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after


def grouped(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(doc, text_hash, fp) of every row, and (fp, group) of every distinct fingerprint: the smallest fingerprint of its component. Ids have no part in the links."""
    ship(docs.sparkSession)
    text = F.col(text_column)
    marked = checkpointed(docs.select(F.col(id_column).alias("doc"), F.xxhash64(text).alias("text_hash"), fingerprint_column(text).alias("fp")))
    nodes = marked.select("fp", F.col("fp").alias("node")).distinct()
    found = components(near_links(nodes))
    return marked, nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("group"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: the id, its fingerprint (16 lowercase hex digits) and component_id."""
    marked, groups = grouped(docs, id_column, text_column)
    held = marked.groupBy("fp").agg(F.min("doc").alias("doc")).join(groups, "fp")
    ids = held.groupBy("group").agg(F.min("doc").alias("component_id"))
    named = held.join(ids, "group").select("fp", "component_id")
    return marked.join(named, "fp", "left").select(
        F.col("doc").alias(id_column),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def staying(docs: DataFrame, classes: DataFrame, groups: DataFrame, keys: list[str], id_column: str, text_column: str) -> DataFrame:
    """The rows of docs that stay: of each group the row of the smallest (id, text hash), and of its rows without id one. classes: (keys, doc, text_hash) of every row; groups: (keys, group)."""
    least = F.min(F.struct("doc", "text_hash")).alias("w")
    # a class is reduced to a row or two before it meets its group
    by_class = classes.groupBy(*keys, F.isnull("doc").alias("nameless")).agg(least)
    stays = by_class.join(groups, keys).groupBy("group", "nameless").agg(F.min("w").alias("w")).select(F.col("w.doc").alias("__of"), F.col("w.text_hash").alias("__stays"))
    own = docs.select(packed_row(docs).alias("__doc"), F.col(id_column).alias("__id"), F.xxhash64(F.col(text_column)).alias("__hash"))
    kept = own.join(stays, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__hash") == F.col("__stays")), "left_semi")
    return kept.dropDuplicates(["__id", "__hash"]).select(*unpacked_row(docs, "__doc"))


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay where linked fingerprints are copies: of each component one row of the smallest id, and one of those without id. Where rows of one id have different texts, each goes or stays with its own component."""
    marked, groups = grouped(docs, id_column, text_column)
    return staying(docs, marked, groups, ["fp"], id_column, text_column)


# ---- near copies by their shingles -------------------------------------------


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def golay_signs() -> np.ndarray:
    """The 4096 words of the extended code as rows of 24 signs."""
    upper = np.arange(1 << 12, dtype=np.int64) << 11
    words = upper | golay_remainder(upper)
    words = words << 1 | (np.bitwise_count(words) & 1)
    return (2.0 * (words[:, None] >> np.arange(24) & 1) - 1).astype(np.float32)


def shingles(text: str | None) -> tuple[np.ndarray, bytes]:
    """The distinct hashes of a text's shingles (fewer words: one of all; none: none), and its words joined by one space."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()
    joined = b" ".join(words)
    n = len(words) - SIMILAR_WORDS + 1
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(joined)] if words else [], np.uint64), joined
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(SIMILAR_WORDS):
        h = mixed(h + own[k : k + n])
    return np.unique(h), joined


def layout(n: int) -> tuple[int, int]:
    """Segments of a key and tables for n rows: the chance members of a bucket stay few, and the texts that share one as many."""
    return (2, 4) if n < 1 << 30 else (3, 6)


SKETCH = "h1 long, h2 long, f1 long, f2 long, size long, keys array<long>"


def sketch_column(text: Column, parts: int, tables: int) -> Column:
    """A struct: a hash of 128 bits of the text's words, its fingerprint of 128 bits, its bytes, and its keys."""
    import xxhash

    sums_of = 24 * parts * tables

    def sums(hashes: np.ndarray) -> np.ndarray:
        """The signed sums of all bits of the shingles' hashes."""
        wide = np.stack([mixed(hashes + np.uint64(k << 40)) for k in range(-(-sums_of // 64))], axis=1)
        ones = np.zeros(sums_of, np.int64)
        for at in range(0, len(wide), STEP):
            ones += np.unpackbits(wide[at : at + STEP].view(np.uint8), axis=1, bitorder="little", count=sums_of).sum(axis=0, dtype=np.int64)
        return 2 * ones - len(wide)

    def sketched(texts: pa.Array) -> pa.Array:
        signs = golay_signs().T.copy()
        out: list[tuple] = []
        for at in range(0, len(texts), DECODED):
            some = texts[at : at + DECODED].to_pylist()
            cut = [shingles(t) for t in some]
            rows = np.stack([sums(h) for h, _ in cut])
            near = rows.reshape(-1, 24).astype(np.float32) @ signs
            codes = np.empty((len(near), PROBES), np.int64)
            for k in range(PROBES):
                codes[:, k] = near.argmax(axis=1)
                near[np.arange(len(near)), codes[:, k]] = -np.inf
            codes = codes.reshape(len(some), tables, parts, PROBES)
            key = np.zeros((len(some), tables, 1), np.int64) + np.arange(tables)[None, :, None]
            for k in range(parts):
                key = (key[..., None] << 12 | codes[:, :, k, None, :]).reshape(len(some), tables, -1)
            bits = np.packbits(rows[:, :128] > 0, axis=1, bitorder="little").view(np.int64)
            for (_, joined), text, fp, keys in zip(cut, some, bits, key.reshape(len(some), -1), strict=True):
                whole = xxhash.xxh3_128_digest(joined)
                out.append((int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True), int(fp[0]), int(fp[1]), len((text or "").encode("utf-8", "surrogatepass")), keys))
        columns = list(zip(*out, strict=True)) or [()] * 6
        keys = pa.array(columns[5], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:5]], keys], ["h1", "h2", "f1", "f2", "size", "keys"])

    return F.arrow_udf(sketched, SKETCH)(text)


def similar_forest(sets: list[np.ndarray], nodes: list[int]) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the pairs of sets whose Jaccard similarity is SIMILAR or more."""
    order = sorted(range(len(nodes)), key=nodes.__getitem__)
    sets, names = [sets[i] for i in order], np.array([nodes[i] for i in order])
    sizes = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    mark, ends = np.zeros(len(values) + 1, bool), np.cumsum(sizes)
    left, right = [], []
    rest = np.arange(len(sets))
    while len(rest):
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            own = place[ends[i] - sizes[i] : ends[i]]
            mark[own] = True
            upto = np.concatenate([[0], np.cumsum(mark[place])])
            mark[own] = False
            common = (upto[ends] - upto[ends - sizes])[rest]
            near = (common > 0) & (SIMILAR[1] * common >= SIMILAR[0] * (sizes[rest] + sizes[i] - common))
            if near.any():
                found = rest[near]
                queue.extend(found.tolist())
                rest = rest[~near]
                left += [int(names[root])] * len(found)
                right += names[found].tolist()
    return left, right


def similar_links(members: DataFrame) -> DataFrame:
    """(a, b): enough links among the rows (component, x, y, node, text) of every block pair to keep its components. One run of rows is held at a time."""
    keys = ["component", "x", "y"]

    def linked(batches):
        key, sets, nodes = None, [], []

        def emit():
            return edges(*similar_forest(sets, nodes)) if len(nodes) > 1 else edges([], [])

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (*keys, "node")), batch.column("text"), strict=True)
            for *own, node, text in rows:
                if own != key:
                    yield emit()
                    key, sets, nodes, seen = own, [], [], set()
                # repeated rows stand for the node once
                if node not in seen:
                    seen.add(node)
                    sets.append(shingles(text.as_py())[0])
                    nodes.append(node)
        yield emit()

    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(linked, "a long, b long").distinct()


def dedup_similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay where texts of a similarity of SIMILAR or more are copies: of each component of links one row of the smallest id, and one of those without id.

    Texts of equal words are one node, empty and null ones too; a text of fewer words
    than a shingle is like none but its equals. Rows of one id with different texts each
    go or stay with their own component.
    """
    ship(docs.sparkSession)
    parts, tables = layout(docs.count())
    text = F.col(text_column)
    marked = docs.select(F.col(id_column).alias("doc"), F.xxhash64(text).alias("text_hash"), sketch_column(text, parts, tables).alias("s"))
    marked = checkpointed(marked.select("doc", "text_hash", "s.*"))
    whole = ["h1", "h2"]
    # any row of a class may stand for its text
    one = F.min(F.struct(F.isnull("doc").alias("nameless"), "doc", "text_hash")).alias("row")
    nodes = marked.groupBy(*whole).agg(*[F.first(c).alias(c) for c in ("f1", "f2", "size", "keys")], one)
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    near = components(bucket_links(nodes.select(F.explode("keys").alias("key"), "f1", "f2", "node"), ["f1", "f2"], SKETCH_BITS))
    near = near.union(near.select(F.col("component").alias("node"), "component").distinct())
    near = checkpointed(near.join(nodes.select("node", "size", "row"), "node"))
    blocks = near.groupBy("component").agg(F.ceil(F.sum("size") / GROUP_BYTES).cast("int").alias("blocks"))
    wanted = near.join(blocks, "component").select("node", "component", F.greatest("blocks", F.lit(1)).alias("blocks"), F.col("row.doc").alias("of"), F.col("row.text_hash").alias("hash"))
    texts = docs.select(F.col(id_column).alias("doc"), text.alias("text"))
    found = texts.join(wanted, F.col("doc").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("hash")))
    members = paired_blocks(found.select("node", "component", "blocks", "text"), F.col("blocks"), F.col("node"))
    final = components(similar_links(members.select("component", "x", "y", "node", "text")))
    groups = nodes.select(*whole, "node").join(final, "node", "left").select(*whole, F.coalesce("component", "node").alias("group"))
    return staying(docs, marked, groups, whole, id_column, text_column)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
