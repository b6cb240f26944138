import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from bracketry.llm import lm, substring


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


A, B = (np.concatenate([[0], np.linspace(low, high, lm.LEVELS)]) for low, high in ((0.2, 0.8), (0.4, 0.9)))


def counted(rows, held):
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            w = split(t)
            one.update(w)
            two.update(zip(["<s>", *w[:-1]], w, strict=True))
            three.update(zip(["<s>", "<s>", *w[:-2]][: len(w)], ["<s>", *w[:-1]], w, strict=True))
    return one, two, three


def level(c):
    return 1 + int(math.log2(c)) if c else 0


def token_parts(w, counts):
    """Of each token the counts that the model joins: its own, pair, context of the pair, triple, context of the triple."""
    one, two, three = counts
    for k, x in enumerate(w):
        v = w[k - 1] if k else "<s>"
        u = w[k - 2] if k > 1 else "<s>"
        yield one[x], two[v, x], one[v] if k else one[None], three[u, v, x], two[u, v] if k else 0


def check(spark, rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = counted(rows, held)
    n, v = sum(counts[0].values()), len(counts[0])
    got = collections.defaultdict(list)
    frame = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, block string, score int")
    for r in lm.score(frame, weights=(A, B)).collect():
        got[r.doc_id].append(r)
    off = tokens = 0
    for i, t in rows:
        w = split(t)
        base = sum(math.log10((counts[0][x] + 1) / (n + v + 1)) for x in w)
        want = 0.0
        for c, c2, cv, c3, cuv in token_parts(w, counts):
            q2, q3 = (1 << level(x) >> 1 for x in (c2, c3))
            p = (c + 1) / (n + v + 1)
            p = A[level(cv)] * q2 / cv + (1 - A[level(cv)]) * p if cv else p
            p = B[level(cuv)] * q3 / ((1 << level(cuv)) - 1) + (1 - B[level(cuv)]) * p if cuv else p
            want += math.log10(p)
        r = min(got[i], key=lambda r: abs(r.base_score - base))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(counts[0][x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        # a false positive raises a count, and a context's count lowers what it gives
        off += abs(r.score - want)
        tokens += len(w)
    assert off / tokens < 0.02


@pytest.mark.parametrize("block_bytes", [2000, 8 << 20])
def test_scores_match_brute_force(spark, sf, monkeypatch, block_bytes):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block_bytes)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    check(spark, [*rows, (None, "the of"), (7001, None), (7002, ""), (7003, " \n"), *rows[:5]])


def test_filter_gives_the_lower_bound_of_counts():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) << np.uint64(1))
    counts = rng.integers(1, 5000, len(hashes))
    data = b"".join(lm.segment(hashes[hashes >> np.uint64(63) == b], lm.level_of(counts)[hashes >> np.uint64(63) == b], 1 << 16) for b in (0, 1))
    found = lm.LogFrequencyFilter(data, 1).counts(hashes)
    true = 1 << (lm.level_of(counts) - 1)
    assert (found >= true).all() and (found == true).mean() > 0.9
    assert (lm.LogFrequencyFilter(data, 1).counts(mixed_others(rng)) == 0).mean() > 0.9


def mixed_others(rng):
    return rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def test_a_small_filter_holds_the_frequent_pairs(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "FILTER_BYTES", 256)
    rows = lm.score(spark.read.parquet(f"{sf}/documents.parquet").limit(50)).collect()
    assert len(rows) == 50 and all(r.score <= 0 for r in rows)


def test_rare_pairs_count_however_small_the_filter(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "FILTER_BYTES", 256)
    monkeypatch.setattr(substring, "BLOCK_BYTES", 20000)
    monkeypatch.setattr(substring, "BUCKET_HASHES", 2000)
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()])


def test_every_pair_is_found_and_held_out_ones_are_not():
    rng = np.random.default_rng(2)
    hashes = np.unique(rng.integers(0, 1 << 63, 200000, dtype=np.uint64) << np.uint64(1))
    counts = np.arange(len(hashes)) % 3
    found = lm.found_levels(hashes, counts)
    assert (found[counts > 0] >= counts[counts > 0]).all()
    assert (found[counts == 0] == 0).mean() > 0.9


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_held_out_rows_are_likelier_than_by_words_alone(spark, sf):
    rows = [r for r in lm.score(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in rows)
    model, base = (10 ** (-sum(r[c] for r in rows) / tokens) for c in ("score", "base_score"))
    assert len(rows) > 10 and model < 0.8 * base


def test_every_context_gives_out_one_at_most(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))) for i in range(60)]
    one, two, three = counts = counted(rows, lambda i: False)
    n, v = sum(one.values()), len(one)
    for u, x in list(two)[:12]:
        total = 0.0
        for w in one:
            c, c2, cv, c3, cuv = one[w], two[x, w], one[x], three[u, x, w], two[u, x]
            q2, q3 = (1 << level(k) >> 1 for k in (c2, c3))
            total += float(lm.smoothed(*(np.array([k]) for k in ((c + 1) / (n + v + 1), min(q2, cv), cv, q3, level(cuv))), A, B)[0])
        assert total <= 1 + 1e-9


def test_the_fit_takes_each_token_out_of_its_counts():
    rng = np.random.default_rng(6)
    level_, low = rng.integers(0, 4, 5000), rng.uniform(0.001, 0.1, 5000)
    high = np.where(rng.random(5000) < 0.3, rng.uniform(0.2, 1, 5000), 0.0)
    weight, n = lm.mixture(high, low, level_)
    for k in (1, 2, 3):
        own = level_ == k
        gain = lambda w: np.log(w * high[own] + (1 - w) * low[own]).sum()  # noqa: B023, E731
        grid = np.linspace(0.01, 0.99, 99)
        assert abs(weight[k] - grid[np.argmax([gain(w) for w in grid])]) < 0.03 and n[k] == own.sum()
    assert n[0] == 0 and lm.filled(weight, n)[5] == weight[3]


def test_the_fit_covers_every_training_row(spark, sf, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 2000)
    seen, filled = [], lm.filled
    monkeypatch.setattr(lm, "filled", lambda weight, n: (seen.append(n.sum()), filled(weight, n))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).select("doc_id", "text")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    lm.score(docs).collect()
    counts = counted(rows, held)
    parts = [p for i, t in rows if not held(i) for p in token_parts(split(t), counts)]
    # without its own occurrence a context must be left; those of two or three stand for one, too; the filter may raise counts
    assert seen[0] == sum(cv > 1 for _, _, cv, _, _ in parts)
    assert seen[1] == pytest.approx(sum(cuv > 1 for *_, cuv in parts) + sum(level(cuv) == 2 for *_, cuv in parts), rel=0.1)


def test_string_ids_and_rows_that_are_alike(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 100)
    docs = spark.createDataFrame([("a", "one two three one two three")] * 40 + [(None, "")] * 40 + [("b", "one two")], "doc_id string, text string").repartition(3)
    rows = lm.score(docs).collect()
    assert len(rows) == 81 and {r.n_tokens for r in rows if r.doc_id is None} == {1}
    assert len({(r.doc_id, r.score) for r in rows}) == 3
