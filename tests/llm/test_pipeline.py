import os

import corpus_pipeline
from bracketry.llm.common import table
from test_decontaminate import plain as contaminated
from test_secrets import plain_redacted
from test_simhash import plain_groups, similar_pairs


def test_each_stage_matches_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "bpe"]
    items = [(str(r.item_id), r.text) for r in table(spark, sf, "benchmark").collect()]
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in held.collect()}
        out = stage(spark, held, sf)
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "near_dedup":
            # five words, similarity 0.8: of every group of the brute force its smallest id stays, and at least nine of ten others go
            ids = sorted(before)
            group = plain_groups(len(ids), similar_pairs([before[d].text for d in ids]))
            firsts = {ids[g] for g in group}
            assert firsts <= set(after)
            assert len(after) - len(firsts) <= 0.1 * (len(before) - len(firsts))
        elif name == "decontamination":
            judged = {d: contaminated(r.text, items) for d, r in before.items()}
            assert set(after) == {d for d, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
        elif name == "secrets":
            assert set(after) == set(before)
            assert {d: r.text for d, r in after.items()} == {d: plain_redacted(r.text) for d, r in before.items()}
        elif name == "bpe":
            assert set(after) == set(before) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in after.values())
        held = spark.createDataFrame(list(after.values()), out.schema) if after else out


def test_run_gives_the_rows_of_the_last_stage(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "text", "token_ids", "n_tokens", "round_trip"} <= set(rows.columns)
    assert rows.count() == rows.select("doc_id").distinct().count() > 0


def test_clashing_columns_and_repeated_rows_pass_every_stage(spark, sf):
    docs = table(spark, sf, "documents").limit(40)
    names = ("token_ids", "n_tokens", "round_trip", "__score", "__row", "__doc", "__found", "__text", "__spans", "node", "component", "keys")
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(2).withColumn("doc_id", docs.doc_id * 0 + None)).select("*", *[docs.source.alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == docs.columns
        else:
            assert sorted(out.columns) == sorted(docs.columns)
        rows = out.collect()
        assert rows and all(r["__row"] == r.source for r in rows)
        docs = spark.createDataFrame(rows, out.schema)


def test_stage_folders_go(spark, sf, tmp_path):
    from bracketry.llm import common

    before = len(common._MADE)
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = [p for p in common._MADE[before:] if os.path.exists(p)]
    assert [p.split("/")[-1].rsplit("-", 1)[0] for p in left] == ["stage-bpe"]

