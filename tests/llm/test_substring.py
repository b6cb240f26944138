import random
import re

import numpy as np
import pytest

from bracketry.llm import substring as s


def plain(docs, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1]))


@pytest.mark.parametrize("block_bytes", [300, 8 << 20])
@pytest.mark.parametrize("window", [1, 2, 3, 4, 13])
def test_small_documents_match_brute_force(spark, monkeypatch, block_bytes, window):
    monkeypatch.setattr(s, "BLOCK_BYTES", block_bytes)
    rng = random.Random(window)
    shared = [" ".join(rng.choice(["a", "b", "ç", "dd"]) for _ in range(rng.randint(10, 30))) for _ in range(4)]
    docs = [(i, " \n".join(rng.choice([*shared, "x y", "b"]) for _ in range(rng.randint(0, 4)))) for i in range(40)]
    docs += [(None, shared[0]), (3, shared[1]), (3, shared[1]), (50, None), (51, ""), (52, " \t "), (-4, shared[2])]
    frame = spark.createDataFrame([(i, t, "k", 0) for i, t in docs], "doc_id long, text string, block string, id int")
    got = [tuple(r) for r in s.without_repeats(frame, window=window).collect()]
    assert order(got) == order(plain(docs, window))


def test_whole_table_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in s.without_repeats(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    assert order(got) == order(plain(docs, 13))


def test_empty_table(spark):
    assert s.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_levels_double_up_to_the_window():
    assert [s.ladder(w) for w in (1, 2, 3, 4, 13, 16)] == [[1], [2], [2, 3], [2, 4], [2, 4, 8, 13], [2, 4, 8, 16]]


def test_word_hashes_tell_words_apart_wherever_they_stand(monkeypatch):
    rng = random.Random(3)
    words = [bytes(rng.choice(b"ab\x00\xff\xc3") for _ in range(rng.randint(1, 9))) for _ in range(3000)] + [b"a" * 300, b"a" * 301]
    data = b"".join(w + rng.choice([b" ", b"\n", b"\t \x0b", b"\x0c\r"]) for w in words)
    for piece in (64, 1 << 20):
        monkeypatch.setattr(s, "PIECE", piece)
        s._POWERS.clear()
        hashes, starts = s.hashed_words(data)
        assert [data[a:].split()[0] for a in starts.tolist()] == words
        assert len(set(zip(hashes.tolist(), words, strict=True))) == len(set(words)) == len(set(hashes.tolist()))
    s._POWERS.clear()


def test_every_level_carries_only_what_the_one_before_left(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_BYTES", 4000)
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randrange(500)}" for _ in range(40))
    docs = [(i, " ".join([f"w{rng.randrange(60)}" for _ in range(100)]) + " " + (passage if i % 7 == 0 else "")) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.length: (r.candidates, r.repeated) for r in s.survivors(frame).collect()}
    assert sorted(rows) == [2, 4, 8]
    assert rows[2][0] > rows[4][0] > rows[8][0] and rows[4][1] > rows[8][1] > 0
    # eight words of the passage, and nothing else, are left
    assert rows[8][1] <= 33 * 9
    assert order([tuple(r) for r in s.without_repeats(frame).collect()]) == order(plain(docs, 13))


def test_other_ids_and_rows_that_are_alike(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_BYTES", 500)
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [("b", passage), ("a", "x " + passage), ("é", passage + " y"), (None, passage), ("10", passage), ("9", "z " + passage), *[("a", "x " + passage)] * 30]
    got = [tuple(r) for r in s.without_repeats(spark.createDataFrame(docs, "doc_id string, text string").repartition(4)).collect()]
    assert order_by_text(got) == order_by_text(plain(docs, 13))
    small = spark.createDataFrame([(2, passage), (1, passage)], "doc_id int, text string")
    assert s.without_repeats(small).schema["doc_id"].dataType.simpleString() == "int"
    assert sorted((r.doc_id, r.n_removed) for r in s.without_repeats(small).collect()) == [(1, 0), (2, 20)]


def order_by_text(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[3], r[1]))


def test_pairs_of_hashes_are_told_apart():
    rng = random.Random(8)
    pairs = [(rng.randrange(6), rng.randrange(4), rng.randrange(9)) for _ in range(200)]
    h, c, owner = (np.array(x, t) for x, t in zip(zip(*pairs, strict=True), (np.uint64, np.uint64, np.int64), strict=True))
    least, number, first = s.least_of(h, c, owner)
    assert least.tolist() == [min(o for a, b, o in pairs if (a, b) == p[:2]) for p in pairs]
    assert sorted((int(h[i]), int(c[i])) for i in first) == sorted({p[:2] for p in pairs}) and h[first].tolist() == sorted(h[first].tolist())
    assert all(pairs[first[k]][:2] == p[:2] for k, p in zip(number, pairs, strict=True))


def test_packed_numbers_come_back():
    rng = np.random.default_rng(7)
    for size, most in ((0, 9), (1, 1 << 63), (5, 10), (3000, 1 << 40), (3000, 4000), (70000, 1 << 63)):
        values = np.sort(rng.integers(0, most, size, dtype=np.uint64))
        assert (s.unpacked(s.packed(values)) == values).all() and len(s.unpacked(s.packed(values))) == size
        assert (s.distinct(values) == np.unique(values)).all()
    assert s.unpacked(s.packed(np.array([7, 7, (1 << 64) - 1], np.uint64))).tolist() == [7, 7, (1 << 64) - 1]
    spread = np.sort(rng.integers(0, 1 << 41, 1 << 19, dtype=np.uint64))
    assert len(s.packed(spread)) * 8 / len(spread) < 25
    counts = rng.geometric(0.8, 5000) - 1
    assert (s.unsparse(s.sparse(counts)) == counts).all()
    some = values[::9]
    assert s.maybe_known(some, values).all() and s.maybe_known(rng.integers(0, 1 << 62, 9999, dtype=np.uint64), some).mean() < 0.1
