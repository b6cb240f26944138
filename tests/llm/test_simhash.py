import itertools
import random
import re

import numpy as np
import xxhash

from bracketry.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{fingerprint: smallest id reachable} by comparing all pairs."""
    fps = sorted(set(prints.values()))
    label = {f: min(d for d, x in prints.items() if x == f) for f in fps}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(fps, 2):
            if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_golay_is_perfect():
    decoder = simhash.golay_decoder()
    assert len(np.unique(decoder)) == 2048
    assert max(int(x).bit_count() for x in decoder) == 3


def test_words_two_bits_apart_share_a_key():
    keys = simhash.segment_keys()
    rng = random.Random(5)
    for _ in range(3000):
        word = rng.randrange(1 << 16)
        other = word
        for bit in rng.sample(range(16), rng.randrange(3)):
            other ^= 1 << bit
        assert set(keys[word]) & set(keys[other])


def test_fingerprints_and_components_match_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(900001, None), (900002, ""), (900003, " \t\n"), (900004, "one"), (900005, "One"), (900006, "a b c d"), (900006, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {d: plain_fingerprint(t) for d, t in rows}
    label = plain_components(prints)
    for r in got:
        assert int(r.fingerprint, 16) == prints[r.doc_id]
        assert r.component_id == label[prints[r.doc_id]]


def test_chains_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rng = random.Random(3)
    fps, at = {}, 0
    base = rng.getrandbits(63)
    for i in range(120):
        at ^= 1 << rng.randrange(60)
        fps[i + 1] = base ^ at
    for i in range(60):
        fps[1000 + i] = rng.getrandbits(63)
    prints = {d: f for d, f in fps.items()}
    nodes = spark.createDataFrame([(f, d) for d, f in prints.items()], "fp long, node long").groupBy("fp").agg({"node": "min"}).toDF("fp", "node")
    found = {r.node: r.component for r in simhash.components(simhash.near_links(nodes)).collect()}
    label = plain_components(prints)
    for r in nodes.collect():
        assert found.get(r.node, r.node) == label[r.fp]


def test_links_of_the_highest_bit(spark):
    rng = random.Random(15)
    prints, n = {}, 0
    for _ in range(40):
        base = rng.getrandbits(64)
        for other in (base, base ^ 1 << 63 ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(3)))):
            prints[n] = other
            n += 1
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f), d) for d, f in prints.items()], "fp long, node long")
    found = {r.node: r.component for r in simhash.components(simhash.near_links(nodes)).collect()}
    assert {d: found.get(d, d) for d in prints} == {d: d - d % 2 for d in prints}


def test_dedup_keeps_one_of_each_group(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame(
        [(3, text, "x", 1), (1, text, "y", 2), (2, "something else entirely is written in here", "z", 3), (2, "something else entirely is written in here", "z", 3), (None, text, "w", 4)],
        "doc_id long, text string, fp string, component_id long",
    )
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (True, 0)]


def test_rows_without_id_link_and_rows_of_one_id_go_apart(spark, monkeypatch):
    texts = {"a": 0b0, "n": 0b111, "b": 0b111111, "m": 0x7FFF << 40}
    monkeypatch.setattr(simhash, "fingerprint_column", lambda text: simhash.F.element_at(simhash.F.create_map(*[simhash.F.lit(x) for kv in texts.items() for x in kv]).cast("map<string,long>"), text))
    docs = spark.createDataFrame([(5, "a"), (None, "n"), (4, "b"), (None, "m"), (None, "m"), (5, "m")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 4), (0, 5), (0, 5), (4, 4), (5, 4), (5, 5)]
    # of the rows of 5 one is a near copy of 4; of the rows without id one of each component stays
    assert sorted((r.doc_id or 0, r.text) for r in simhash.dedup(docs).collect()) == [(0, "m"), (0, "n"), (4, "b"), (5, "m")]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return tuple(words), {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_pairs(texts):
    """Pairs of row numbers whose words are equal or whose shingles have a similarity of 0.8 or more."""
    cut, held, counts = [plain_shingles(t) for t in texts], {}, {}
    equal = {}
    for i, (words, own) in enumerate(cut):
        for j in equal.setdefault(words, []):
            counts[j, i] = len(own)
        equal[words].append(i)
        for s in own:
            held.setdefault(s, []).append(i)
    common = {}
    for rows in held.values():
        for p in itertools.combinations(rows, 2):
            common[p] = common.get(p, 0) + 1
    return {p for p, c in common.items() if 5 * c >= 4 * (len(cut[p[0]][1]) + len(cut[p[1]][1]) - c)} | set(counts)


def plain_groups(n, pairs):
    group = list(range(n))

    def top(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        group[y] = x
    return [top(i) for i in range(n)]


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, round(share * len(out)))):
        out[i] = f"e{rng.randrange(10**6)}"
    return out


def check_similar(spark, rows):
    docs = spark.createDataFrame([(i, t, f"n{k}", 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node string, component int").repartition(3)
    kept = simhash.dedup_similar(docs)
    assert kept.columns == docs.columns
    got = {int(r.node[1:]) for r in kept.collect()}
    pairs = similar_pairs([t for _, t in rows])
    groups = plain_groups(len(rows), pairs)
    members = {}
    for k, g in enumerate(groups):
        members.setdefault(g, []).append(k)
    # of each group at least its first row stays, and what has no similar text
    for own in members.values():
        assert min(own, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)) in got or any(k in got for k in own)
        if len(own) == 1:
            assert own[0] in got
    should_go = len(rows) - len(members)
    went = len(rows) - len(got)
    return went, should_go


def test_similar_texts_match_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(12)
    for i in range(150):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 300))]
        rows.append((10_000 + 2 * i, " ".join(base)))
        rows.append((10_001 + 2 * i, " ".join(edited(rng, base, rng.uniform(0.002, 0.03)))))
    rows += [(90_001, None), (90_002, ""), (90_003, " \n"), (90_004, "one two"), (90_005, "One  two"), (90_006, "one two three")]
    went, should = check_similar(spark, rows)
    assert 0.9 * should <= went <= should


def test_similar_texts_of_large_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_BYTES", 4000)
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rng = random.Random(13)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, 0.02))) for i in range(60)] + [(100, " ".join(base)), (101, " ".join(base))] + [(200 + i, " ".join(f"v{rng.randrange(3000)}" for _ in range(80))) for i in range(40)]
    went, should = check_similar(spark, rows)
    assert should >= 55 and 0.9 * should <= went <= should


def test_similar_forest_equals_all_pairs():
    rng = random.Random(14)
    for _ in range(60):
        sets = [np.array(sorted(rng.sample(range(12), rng.randint(1, 10))), np.uint64) for _ in range(rng.randint(2, 12))]
        pairs = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))]
        found = list(zip(*simhash.similar_forest(sets, list(range(len(sets)))), strict=True))
        assert plain_groups(len(sets), found) == plain_groups(len(sets), pairs)


def test_string_ids(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([("b", text), ("a", text), ("c", "something else entirely is written in here"), (None, text)], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.component_id or "") for r in simhash.near_duplicates(docs).collect()) == [("", "a"), ("a", "a"), ("b", "a"), ("c", "c")]
    for kept in (simhash.dedup(docs), simhash.dedup_similar(docs)):
        assert sorted(r.doc_id or "" for r in kept.collect()) == ["", "a", "c"]


def test_empty_table_has_no_near_copies(spark):
    assert simhash.dedup_similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []
