"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Each word is a word embedding next to the mean embedding of its character n-grams.
A window's words run through gated recurrent units in both directions; attention
pools the states and a logistic unit scores the window. A document's score is the
highest of all its overlapping windows, over the whole text.

The network is trained in numpy on the driver, on at most TRAIN_TOXIC + TRAIN_CLEAN
labelled rows of at most TRAIN_CHARS characters (documented bounds of the sample;
scoring has none). A document's label is known, not its windows': the highest window
of each document is trained (multiple-instance learning), from a start at which the
first component of every embedding is the log odds of its words or n-grams.

Defined results: null texts and texts without a word score 0; rows of one doc_id are
scored each for itself; of several labels of one doc_id the highest counts; labels
that are null are left out; without any toxic or any clean labelled row every score
is 0. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bracketry.llm.common import packed_row, remainder, resident, ship, table, unpacked_row

#: Bounds of the training sample.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1000, 2000, 20_000
#: Words of a window, words from one window to the next, units of a direction, size of an embedding.
WINDOW, STRIDE, UNITS, SIZE = 32, 16, 8, 8
#: Rows of the embedding tables and lengths of n-grams in bytes.
WORD_ROWS, GRAM_ROWS, GRAMS = 1 << 15, 1 << 17, (3, 4, 5)
#: Passes, times the highest windows are chosen anew, windows of a step, rate.
EPOCHS, ROUNDS, BATCH, RATE = 4, 2, 128, 0.01
#: Words kept with their projections, words looked up at once, windows scored at once.
CACHE, GROUP_WORDS, SCORED = 1 << 17, 1 << 18, 4096
#: A score from here on is a rejection; rows whose crc32 remainder by FOLDS is HELD are never learnt from.
REJECT, FOLDS, HELD = 0.3, 4, 2

# Digits, letters (lower-cased) and bytes from 0x80 are word bytes; others separate.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, n-gram rows of all words one after the other, and where each word's n-grams begin. A mark stands at both ends of a word."""
    text = np.frombuffer(b"\x01" + b"\x01".join(words) + b"\x01", np.uint8).astype(np.uint64)
    mark = np.cumsum(text == 1)
    rows, owners = [], []
    for n in GRAMS:
        m = len(text) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) ^ text[k : k + m]
        ok = mark[n - 2 : n - 2 + m] == mark[:m]
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        rows.append((h >> np.uint64(40))[ok] % np.uint64(GRAM_ROWS))
        owners.append(mark[:m][ok] - 1)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[order], np.arange(len(words)))
    word = np.fromiter((zlib.crc32(w) % WORD_ROWS for w in words), np.int64, len(words))
    return word, np.concatenate(rows).astype(np.int64)[order], begin


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters, the forward pass, and the backward pass by hand."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = 2 * SIZE, UNITS
        draw = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        self.word, self.gram = draw(WORD_ROWS, SIZE, by=0.02), draw(GRAM_ROWS, SIZE, by=0.02)
        self.dense = {
            "wx": draw(2, d, 3 * h, by=d**-0.5), "wh": draw(2, h, 3 * h, by=h**-0.5), "b": np.zeros((2, 1, 3 * h), np.float32),
            "attention": draw(2 * h, by=0.3), "out": draw(2 * h, by=0.5), "bias": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[bytes]):
        word, gram, begin = features(words)
        counts = np.diff(begin, append=len(gram))
        mean = np.add.reduceat(self.gram[gram], begin, axis=0) / counts[:, None]
        return np.concatenate([self.word[word], mean], axis=1).astype(np.float32), (word, gram, counts)

    def project(self, x: np.ndarray) -> np.ndarray:
        """(words, 2, 3 * UNITS): what each word brings to the gates of both directions."""
        return np.stack([x @ self.dense["wx"][d] + self.dense["b"][d] for d in (0, 1)], axis=1)

    def run(self, projected: np.ndarray, mask: np.ndarray, keep: bool = False):
        """projected (L, windows, 2, 3 * UNITS), mask (L, windows). Probabilities, and with keep what the backward pass needs."""
        steps, n = mask.shape
        h = np.zeros((2, n, UNITS), np.float32)
        states = np.empty((steps, n, 2 * UNITS), np.float32)
        trace, wh = [], self.dense["wh"]
        for t in range(steps):
            x = np.stack([projected[t, :, 0], projected[steps - 1 - t, :, 1]])
            g = h @ wh
            zr = sigmoid(x[..., : 2 * UNITS] + g[..., : 2 * UNITS])
            z, r = zr[..., :UNITS], zr[..., UNITS:]
            c = np.tanh(x[..., 2 * UNITS :] + r * g[..., 2 * UNITS :])
            # padding leaves the state as it was
            live = np.stack([mask[t], mask[steps - 1 - t]])[..., None]
            new = np.where(live, c + z * (h - c), h)
            if keep:
                trace.append((h, z, r, c, g[..., 2 * UNITS :], live))
            h = new
            states[t, :, :UNITS], states[steps - 1 - t, :, UNITS:] = h[0], h[1]
        e = np.where(mask, states @ self.dense["attention"] * 4, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        p = sigmoid(pooled @ self.dense["out"] * 4 + self.dense["bias"])
        return (p, (states, trace, a, pooled)) if keep else p

    def backward(self, x: np.ndarray, mask: np.ndarray, p: np.ndarray, y: np.ndarray, kept):
        """Gradients of the mean log loss: dense ones by name, and of the inputs x (L, windows, 2 * SIZE)."""
        states, trace, a, pooled = kept
        steps, n = mask.shape
        grad = {k: np.zeros_like(v) for k, v in self.dense.items()}
        d_out = ((p - y) / n).astype(np.float32)
        grad["bias"] += d_out.sum()
        grad["out"] = 4 * pooled.T @ d_out
        d_pooled = 4 * d_out[:, None] * self.dense["out"]
        d_a = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = 4 * a * (d_a - (a * d_a).sum(axis=0))
        grad["attention"] = np.einsum("tn,tnh->h", d_e, states)
        d_states = a[..., None] * d_pooled + d_e[..., None] * self.dense["attention"]
        d_x = np.zeros_like(x)
        d_h, wh = np.zeros((2, n, UNITS), np.float32), self.dense["wh"]
        for t in range(steps - 1, -1, -1):
            h, z, r, c, gc, live = trace[t]
            d_h = d_h + np.stack([d_states[t, :, :UNITS], d_states[steps - 1 - t, :, UNITS:]])
            d_new = np.where(live, d_h, 0)
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * gc * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_c], axis=-1)
            d_g = np.concatenate([d_z, d_r, d_c * r], axis=-1)
            grad["wh"] += np.swapaxes(h, 1, 2) @ d_g
            grad["b"] += d_in.sum(axis=1, keepdims=True)
            grad["wx"][0] += x[t].T @ d_in[0]
            grad["wx"][1] += x[steps - 1 - t].T @ d_in[1]
            d_x[t] += d_in[0] @ self.dense["wx"][0].T
            d_x[steps - 1 - t] += d_in[1] @ self.dense["wx"][1].T
            d_h = np.where(live, d_new * z, d_h) + d_g @ np.swapaxes(wh, 1, 2)
        return grad, d_x


def window_starts(n: int) -> range:
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


class Scorer:
    """Scores texts; words keep their projections in a cache of bounded size."""

    def __init__(self, network: Network):
        self.network = network
        self.reset()

    def reset(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.projected = np.zeros((1, 2, 3 * UNITS), np.float32)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Row of each word; row 0 is padding."""
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if len(self.rows) + len(new) > CACHE:
            self.reset()
            new = list(dict.fromkeys(words))
        if new:
            for i, w in enumerate(new, len(self.projected)):
                self.rows[w] = i
            self.projected = np.concatenate([self.projected, self.network.project(self.network.inputs(new)[0])])
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        group: list[list[bytes]] = []
        held = 0
        for text in texts:
            words = words_of(text)
            if held and held + len(words) > GROUP_WORDS:
                out += self._group(group)
                group, held = [], 0
            group.append(words)
            held += len(words)
        return out + self._group(group)

    def _group(self, group: list[list[bytes]]) -> list[float]:
        rows = self.look_up([w for words in group for w in words])
        rows = np.concatenate([rows, np.zeros(WINDOW, np.int64)])
        starts, ends, owner, base = [], [], [], 0
        for i, words in enumerate(group):
            if words:
                at = np.arange(0, max(1, len(words) - WINDOW + STRIDE), STRIDE)
                starts.append(base + at)
                ends.append(np.full(len(at), base + len(words)))
                owner.append(np.full(len(at), i))
            base += len(words)
        best = np.zeros(len(group))
        if starts:
            start, end, owner = np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)
            for k in range(0, len(start), SCORED):
                at = start[None, k : k + SCORED] + np.arange(WINDOW)[:, None]
                mask = at < end[None, k : k + SCORED]
                ids = np.where(mask, rows[np.minimum(at, len(rows) - 1)], 0)
                np.maximum.at(best, owner[k : k + SCORED], self.network.run(self.projected[ids], mask))
        return best.tolist()


def train(texts: list[str], labels: list[int]) -> Network:
    """A network fitted to whole labelled texts."""
    network = Network()
    docs = [(words_of(t), y) for t, y in zip(texts, labels, strict=True)]
    docs = [(w, y) for w, y in docs if w]
    names = list(dict.fromkeys(w for words, _ in docs for w in words))
    index = {w: i for i, w in enumerate(names)}
    word, gram, begin = features(names)
    counts = np.diff(begin, append=len(gram))
    ids = [np.array([index[w] for w in words]) for words, _ in docs]
    y_of = np.array([y for _, y in docs])
    # the start: log odds of documents that hold a word or an n-gram
    for rows, into in ((word, network.word), (gram, network.gram)):
        held = np.zeros((2, len(into)))
        for i, y in zip(ids, y_of, strict=True):
            own = np.unique(i)
            if rows is gram:
                own = np.repeat(begin[own], counts[own]) + np.arange(counts[own].sum()) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])
            held[y, np.unique(rows[own])] += 1
        n = np.bincount(y_of, minlength=2)
        odds = np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1))
        into[:, 0] = np.where(held.sum(axis=0) >= 3, np.clip(odds, -3, 3), 0)
    start_weight = np.concatenate([network.word[word, :1], np.add.reduceat(network.gram[gram, 0], begin)[:, None] / counts[:, None]], axis=1).sum(axis=1)
    windows = [(k, s) for k, i in enumerate(ids) for s in window_starts(len(i))]
    first = np.cumsum([0, *[len(window_starts(len(i))) for i in ids]])

    def laid(some) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((WINDOW, len(some)), -1)
        for j, w in enumerate(some):
            k, s = windows[w]
            part = ids[k][s : s + WINDOW]
            at[: len(part), j] = part
        return np.maximum(at, 0), at >= 0

    rng = np.random.default_rng(11)
    value = np.array([max(start_weight[ids[k][s : s + WINDOW]]) for k, s in windows])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.dense.items()}
    squares = {"word": np.full(WORD_ROWS, 1e-8, np.float32), "gram": np.full(GRAM_ROWS, 1e-8, np.float32)}
    step = 0
    for round_ in range(ROUNDS):
        if round_:
            x = network.project(np.concatenate([network.word[word], np.add.reduceat(network.gram[gram], begin, axis=0) / counts[:, None]], axis=1).astype(np.float32))
            for k in range(0, len(windows), SCORED):
                at, mask = laid(range(k, min(len(windows), k + SCORED)))
                value[k : k + SCORED] = network.run(x[at], mask)
        top = [a + int(np.argmax(value[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]
        chosen = np.array(top + [int(rng.integers(a, b)) for a, b, y in zip(first[:-1], first[1:], y_of, strict=True) if not y])
        y = np.concatenate([y_of, np.zeros(len(chosen) - len(y_of), int)])
        for _ in range(EPOCHS):
            order = rng.permutation(len(chosen))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                at, mask = laid(chosen[some])
                used, inverse = np.unique(at, return_inverse=True)
                inverse = inverse.reshape(at.shape)
                grams = np.repeat(begin[used], counts[used]) + np.arange(counts[used].sum()) - np.repeat(np.cumsum(counts[used]) - counts[used], counts[used])
                edges = np.cumsum(counts[used]) - counts[used]
                mean = np.add.reduceat(network.gram[gram[grams]], edges, axis=0) / counts[used][:, None]
                table_ = np.concatenate([network.word[word[used]], mean], axis=1).astype(np.float32)
                x = table_[inverse]
                p, kept = network.run(network.project(table_)[inverse], mask, keep=True)
                grad, d_x = network.backward(x, mask, p, y[some], kept)
                step += 1
                for name, g in grad.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    network.dense[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                d_word = np.zeros_like(table_)
                np.add.at(d_word, inverse[mask], d_x[mask])
                for name, into, rows, d in (
                    ("word", network.word, word[used], d_word[:, :SIZE]),
                    ("gram", network.gram, gram[grams], np.repeat(d_word[:, SIZE:] / counts[used][:, None], counts[used], axis=0)),
                ):
                    own, back = np.unique(rows, return_inverse=True)
                    g = np.zeros((len(own), SIZE), np.float32)
                    np.add.at(g, back, d)
                    squares[name][own] += (g * g).mean(axis=1)
                    into[own] -= 0.05 * g / np.sqrt(squares[name][own])[:, None]
    return network


def sample(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> tuple[list[str], list[int]]:
    """Whole texts and labels of a bounded sample of the rows that may be learnt from, the same for the same rows."""
    allowed = labels.where((remainder(id_column, FOLDS) != HELD) & F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    one = allowed.groupBy(F.col(id_column).alias("__id")).agg(F.max(label_column).cast("int").alias("__label"))
    texts, found = [], []
    for label, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        # twice the rows that are wanted: some may have no or too long a text. At most 2 * most small rows, so the broadcast is bounded.
        some = one.where(F.col("__label") == label).orderBy(F.xxhash64("__id"), "__id").limit(2 * most)
        rows = docs.where(F.col(text_column).isNotNull() & (F.length(text_column) <= TRAIN_CHARS)).select(F.col(id_column).alias("__doc"), F.col(text_column).alias("__text"))
        rows = rows.join(F.broadcast(some), F.col("__doc") == F.col("__id")).orderBy(F.xxhash64("__id"), "__id", "__text").limit(most)
        texts += (got := [r["__text"] for r in rows.select("__text").collect()])
        found += [label] * len(got)
    return texts, found


def scored_by(network: Network | None, spark: SparkSession, text: Column) -> Column:
    """The score of each whole text."""
    if network is None:
        return F.lit(0.0)
    ship(spark)
    shared, name = spark.sparkContext.broadcast((network.word, network.gram, network.dense)), uuid.uuid4().hex

    def score(texts: pa.Array) -> pa.Array:
        def build() -> Scorer:
            fitted = Network.__new__(Network)
            fitted.word, fitted.gram, fitted.dense = shared.value
            return Scorer(fitted)

        return pa.array(resident(("toxicity", name), build).scores(texts.to_pylist()), pa.float64())

    return F.arrow_udf(score, T.DoubleType())(text)


def fit(docs: DataFrame, labels: DataFrame, **columns: str) -> Network | None:
    texts, found = sample(docs, labels, **columns)
    return train(texts, found) if len(set(found)) == 2 else None


def without_toxic(docs: DataFrame, labels: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of docs that score below REJECT, with the columns of docs."""
    score = scored_by(fit(docs, labels, text_column=text_column), docs.sparkSession, F.col(text_column))
    scored = docs.select(packed_row(docs).alias("__doc"), score.alias("__score"))
    return scored.where(F.col("__score") < REJECT).select(*unpacked_row(docs, "__doc"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (remainder("doc_id", FOLDS) == HELD).alias("held_out"), scored_by(network, spark, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))
