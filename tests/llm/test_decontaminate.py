import random
import re

from pyspark.sql import functions as F

from bracketry.llm import decontaminate as d


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    doc, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        m = min(13, len(w))
        for i in range(len(w) - m + 1) if w else ():
            for at in range(len(doc) - m + 1):
                if doc[at : at + m] == w[i : i + m]:
                    hit |= set(range(at, at + m))
                    if item is not None:
                        found.add(str(item))
    return len(doc), len(hit), sorted(found)


def check(spark, docs, items):
    frame = d.find_benchmark(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id string, text string"))
    got = {r.doc_id: (r["__found"].n_words, r.hits, list(r["__found"]["items"])) for r in frame.withColumn("hits", d.hit_words(F.col("__found.spans"))).collect()}
    for i, t, _ in docs:
        assert got[i] == plain(t, items), i


ITEMS = [("b", "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), ("a", "short item"), ("c", "é"), (None, "nameless thing here"), ("e", ""), ("n", None), ("a", "short item"), ("r", "x " * 20)]
DOCS = [
    (1, "zero one, two three four five six seven eight nine ten eleven TWELVE thirteen; fourteen", "k"),
    (2, "a short-item é, É nameless thing here", "k"),
    (3, None, "k"),
    (4, "", "k"),
    (5, "x " * 30 + "y " + "x " * 13, None),
    (6, "one two three four five six seven eight nine ten eleven twelve", "k"),
    (7, "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen short item", "k"),
]


def test_matches_brute_force(spark):
    check(spark, DOCS, ITEMS)


def test_slices_of_the_benchmark_are_united(spark, monkeypatch):
    monkeypatch.setattr(d, "SLICE_BYTES", 20)
    check(spark, DOCS, ITEMS)


def test_whole_tables(spark, sf):
    docs = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    check(spark, docs, items)


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, item_id string")
    kept = d.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id string, text string"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string, item_id string"), spark.createDataFrame([], "item_id string, text string")
    assert d.decontaminate(docs, items).count() == len(DOCS)
    assert d.decontaminate(docs.limit(0), items).count() == 0


def test_items_longer_than_a_slice_lose_no_window(spark, monkeypatch):
    monkeypatch.setattr(d, "SLICE_WORDS", 20)
    item = " ".join(f"w{i % 90}" for i in range(200))
    docs = [(i, " ".join(item.split()[i * 9 : i * 9 + 13 + i % 3]), "k") for i in range(20)] + [(99, item, "k"), (98, "w1 w2 w3", "k")]
    check(spark, docs, [("long", item), ("s", "w1 w2 w3")])


def test_searches_match_brute_force_on_few_words():
    rng = random.Random(6)
    items = [(str(k) if k % 5 else None, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))) for k in range(40)]
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    found = d.Patterns([(i, b" ".join(d.words_of(t))) for i, t in items]).search([*texts, None])
    for (n, spans, names), text in zip(found, [*texts, None], strict=True):
        assert (n, sum(b - a for a, b in zip(spans[::2], spans[1::2], strict=True)), sorted(names)) == plain(text, items)


def test_input_columns_of_inner_names_stay(spark):
    docs = spark.createDataFrame([(1, DOCS[0][1], "a", "b", "c", "d"), (2, "clean", "a", "b", "c", "d")], "doc_id long, text string, __row string, __found string, __spans string, __doc string")
    kept = d.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id string, text string")).collect()
    assert [tuple(r) for r in kept] == [(2, "clean", "a", "b", "c", "d")]
