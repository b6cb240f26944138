import random
import re

from bracketry.llm import quality as q
from sqlcheck import same


def plain_repeated(words):
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)})


def test_sql_gives_the_same(spark, sf):
    same(spark, sf, q.op5_quality, q.sql())


def test_repeated_words_match_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", " \n\t", "a " * 500]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").drop("n_words")
    for r in q.measured(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        assert (r.n_words, r.n_repeat_words) == (len(words), plain_repeated(words))


def test_filter_keeps_columns_that_clash(spark):
    good = "The boats that were in the harbour for the winter are to be painted by the men of the village and it is not yet done."
    docs = spark.createDataFrame([(1, good, "x"), (2, "### $$$ " * 30, "y"), (3, None, "z"), (1, good, "x")], "doc_id long, text string, n_words string")
    kept = q.quality_filter(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [1, 1]


def test_no_python_in_the_plan(spark, sf):
    plan = q.op5_quality(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_columns_of_measures(spark):
    docs = spark.createDataFrame([(1, "one two", "x", "y", "z")], "doc_id long, text string, n_words string, __words string, __doc string")
    out = q.measured(docs)
    assert out.columns == ["doc_id", "text", "__words", "__doc", *q.MEASURES]
    assert [(r.n_words, r["__words"], r["__doc"]) for r in out.collect()] == [(2, "y", "z")]
    assert q.quality_filter(docs).columns == docs.columns
    assert q.measured(docs.limit(0)).collect() == [] and q.quality_filter(docs.limit(0)).collect() == []
