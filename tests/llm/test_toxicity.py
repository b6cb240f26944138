import math
import random
import re
import zlib

import numpy as np

from bracketry.llm import toxicity as t


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["ta", "ri", "mo", "len", "sko", "va", "ne", "du"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), "grubz" + rng.choice(syllables))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = t.Network(5)
    net.dense = {k: v.astype(np.float64) for k, v in net.dense.items()}
    x = rng.standard_normal((6, 4, 2 * t.SIZE))
    mask = np.arange(6)[:, None] < np.array([6, 3, 1, 5])
    y = np.array([1, 0, 1, 0])

    def loss():
        p, kept = net.run(np.stack([x @ net.dense["wx"][d] + net.dense["b"][d] for d in (0, 1)], axis=2), mask, keep=True)
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p))), p, kept

    _, p, kept = loss()
    grad, d_x = net.backward(x, mask, p, y, kept)
    for name, value in [*net.dense.items(), ("x", x)]:
        g = d_x if name == "x" else grad[name]
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(6)]:
            old = value[at]
            value[at] = old + 1e-3
            up = loss()[0]
            value[at] = old - 1e-3
            down = loss()[0]
            value[at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3 + 0.05 * abs(g[at]), name


def test_held_out_accuracy_and_stage(spark):
    rows = corpus(500, 1)
    docs = spark.createDataFrame([(i, x, 1) for i, x, _ in rows] + [(1000, None, 1), (1001, "", 2), (1002, " !? ", 3), (4, rows[4][1], 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    net = t.fit(docs, labels)
    got = docs.select("doc_id", t.scored_by(net, spark, docs["text"]).alias("s")).collect()
    label = {i: y for i, _, y in rows}
    held = [(r.s, label[r.doc_id]) for r in got if r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(s >= t.REJECT) == bool(y) for s, y in held]) > 0.9
    assert all(r.s == 0 for r in got if r.doc_id >= 1000) and all(0 <= r.s <= 1 for r in got)
    kept = t.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_every_window_is_scored():
    net = t.Network(1)
    scorer = t.Scorer(net)
    rng = random.Random(1)
    words = ["w%d" % rng.randrange(50) for _ in range(333)]
    whole = scorer.scores([" ".join(words), "x"])[0]
    parts = [" ".join(words[s : s + t.WINDOW]) for s in t.window_starts(len(words))]
    assert t.window_starts(len(words))[-1] + t.WINDOW >= len(words)
    assert abs(whole - max(scorer.scores(parts))) < 1e-6


def test_without_both_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "a b", 0)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.without_toxic(docs, labels).count() == 1
    assert t.without_toxic(docs.limit(0), labels).count() == 0


def plain_score(net, text):
    """The highest window's score, word by word and unit by unit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", low)
    vectors = {}
    for w in set(words):
        marked, grams = b"\x01" + w + b"\x01", []
        for n in t.GRAMS:
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = h * 0x100000001B3 % 2**64 ^ c
                h = (h ^ h >> 31) * 0x9E3779B97F4A7C15 % 2**64
                grams.append((h >> 40) % t.GRAM_ROWS)
        mean = [sum(float(net.gram[g, k]) for g in grams) / len(grams) for k in range(t.SIZE)]
        vectors[w] = [float(x) for x in net.word[zlib.crc32(w) % t.WORD_ROWS]] + mean
    dense = {k: v.astype(float).tolist() for k, v in net.dense.items()}
    squash = lambda x: 1 / (1 + math.exp(-x))
    best = 0.0
    start = 0
    while words:
        window = [vectors[w] for w in words[start : start + t.WINDOW]]
        states = [[0.0] * (2 * t.UNITS) for _ in window]
        for d in (0, 1):
            h = [0.0] * t.UNITS
            for at in range(len(window)) if d == 0 else range(len(window) - 1, -1, -1):
                x = [sum(a * dense["wx"][d][i][k] for i, a in enumerate(window[at])) + dense["b"][d][0][k] for k in range(3 * t.UNITS)]
                g = [sum(a * dense["wh"][d][i][k] for i, a in enumerate(h)) for k in range(3 * t.UNITS)]
                z = [squash(x[k] + g[k]) for k in range(t.UNITS)]
                r = [squash(x[k + t.UNITS] + g[k + t.UNITS]) for k in range(t.UNITS)]
                c = [math.tanh(x[k + 2 * t.UNITS] + r[k] * g[k + 2 * t.UNITS]) for k in range(t.UNITS)]
                h = [c[k] + z[k] * (h[k] - c[k]) for k in range(t.UNITS)]
                states[at][d * t.UNITS : (d + 1) * t.UNITS] = h
        e = [4 * sum(a * b for a, b in zip(s, dense["attention"], strict=True)) for s in states]
        share = [math.exp(x - max(e)) for x in e]
        pooled = [sum(a / sum(share) * s[k] for a, s in zip(share, states, strict=True)) for k in range(2 * t.UNITS)]
        best = max(best, squash(4 * sum(a * b for a, b in zip(pooled, dense["out"], strict=True)) + dense["bias"][0]))
        if start + t.WINDOW >= len(words):
            return best
        start += t.STRIDE
    return best


def test_query_equals_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    net = t.fit(docs.select("doc_id", "text"), labels)
    rows = {r.doc_id: r for r in t.op2_toxicity(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(rows) == sorted(texts)
    some = sorted(texts, key=lambda d: len(texts[d] or ""))[::4][:30]
    for d in some:
        want = plain_score(net, texts[d])
        assert abs(rows[d].score - want) < 1e-4
        assert rows[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and rows[d].predicted == int(rows[d].score >= 0.3)


def test_input_columns_of_inner_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "d")], "doc_id long, text string, __score string, __doc string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r) for r in t.without_toxic(docs, labels).collect()] == [(1, "a b", "s", "d")]
