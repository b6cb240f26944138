"""The corpus pipeline: five operators, each on what its predecessor kept.

Toxic documents go; of each group of near copies (five words, similarity 0.8) one document stays; contaminated
documents go; secrets are replaced by marks in the texts that stay; every text is
encoded, with a check that its ids decode to it. A stage's output is written as
Parquet in the shared folder and read again by the next, which also cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm import bpe, decontaminate, secrets, simhash, toxicity
from bracketry.llm.common import discard, passing, scratch, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids, n_tokens and round_trip (the ids decode to the text; null counts as empty). Input columns of these names give way."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("token_ids", "n_tokens", "round_trip")]
    coded = bpe.code_documents(docs.select(F.struct(*own).alias("doc"), F.coalesce("text", F.lit("")).alias("text")), path)
    return coded.select("doc.*", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: The first stage is a trained network, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's input folder is removed once its output is written."""
    ship(spark)
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            discard(spark, last)
        last = path
    return docs
