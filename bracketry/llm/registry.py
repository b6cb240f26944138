"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bracketry.llm import bpe, decontaminate, html, lm, quality, secrets, shard, simhash, substring, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": bpe.op1_bpe, "op2_toxicity": toxicity.op2_toxicity, "op3_lm": lm.op3_lm, "op4_substring": substring.op4_substring, "op5_quality": quality.op5_quality, "op6_secrets": secrets.op6_secrets, "op7_shard": shard.op7_shard, "op8_html": html.op8_html, "op9_decontaminate": decontaminate.op9_decontaminate, "op10_simhash": simhash.op10_simhash}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality": quality.sql(), "op6_secrets": secrets.sql()}
