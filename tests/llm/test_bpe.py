import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bracketry.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "a  b", "a \t  b\n\n c  ", "x<|endoftext|>y <|endoftext|> z", "it's we'll\x1c \x85 a\xa0\xa0b　c", "日本語テスト 🙂🙂 é", "ab" * 1500, "\x1c\x1d x", "१२३ ½ Ⅷ", "x\n" * 50]


@pytest.fixture(scope="module")
def both():
    with open(PATH) as f:
        return bpe.ByteBpe(f.read()), Tokenizer.from_file(PATH)


def test_ids_and_texts_equal_the_library(both):
    own, library = both
    rng = random.Random(1)
    alphabet = "ab 's\t\n\r\x0b\x1c\x85\xa0　é1½!?<|endoftext|>漢"
    for text in [*TEXTS, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400))]:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_one_tree_and_many_trees_agree(both):
    own, _ = both
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"thering ") for _ in range(rng.randint(1, 90))) for _ in range(500)]
    assert own.merge_many(pieces) == [own.merge(p) for p in pieces]


def test_tree_root_is_the_leftmost_least():
    rng = random.Random(3)
    leaves = [rng.randrange(100) << 10 | i for i in range(400)]
    tree = bpe.PairTree(list(leaves))
    for _ in range(300):
        i = rng.randrange(400)
        leaves[i] = rng.randrange(100) << 10 | i
        tree.put(i, leaves[i])
        assert tree.levels[-1][0] == min(leaves)


def test_caches_turn_over(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 10)
    assert [bpe.array("i", x).tolist() for x in own.encode_many(TEXTS)] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_columns(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*TEXTS, None, TEXTS[2]])], "doc_id long, text string, decoded string").withColumnRenamed("decoded", "note")
    rows = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    assert all(r.decoded == (r.text or "") for r in rows) and len(rows) == len(TEXTS) + 2
    assert [(list(r.token_ids), r.decoded) for r in bpe.code_documents(docs, PATH).orderBy("doc_id").collect()] == [(list(r.token_ids), r.decoded) for r in sorted(rows, key=lambda r: r.doc_id)]
    nothing = docs.limit(0)
    assert bpe.encode_documents(nothing, PATH).collect() == []
    assert spark.range(1).select(bpe.Bpe(spark, PATH).decode(F.lit(None).cast("array<int>")).alias("t")).first().t == ""


def test_columns_of_the_same_names_give_way(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", "z")], "doc_id long, text string, token_ids string, decoded string, __coded string")
    out = bpe.code_documents(docs, PATH)
    assert out.columns == ["doc_id", "text", "__coded", "token_ids", "decoded"]
    assert [(r["__coded"], r.decoded, len(r.token_ids)) for r in out.collect()] == [("z", "a b", 2)]
