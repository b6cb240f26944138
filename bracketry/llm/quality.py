"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Measures are plain expressions over the whole text, its words and its lines; RULES
bounds ratios of them, and `verdict` folds the table into a single boolean column.
Words in repeated windows are found by sorting the hashes of a text's windows, so
the cost stays n log n for a text of any length. No user function runs.

Defined results: a null text is an empty one (no words, no lines, fails); rows are
judged each for itself, so repeated rows get equal results; an empty table gives an
empty table. Ratios whose denominator is zero are zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm.common import SPACE, packed_row, table, unpacked_row

#: Words of a window; least words; most repeated words of a hundred.
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with they at be this from have or by not but what all were when an which there will about "
    "le la les des une est que qui dans pour pas par sur de et en un il au avec son ce "
    "der die das und den von zu mit ist im dem nicht ein eine auf sich als auch es "
    "el los las y del por con para se una su al lo como"
).split()

#: name, numerator, denominator, least, most (None: no bound).
RULES = (
    ("mean_word_length", "word_chars", "n_words", 2.5, 12.0),
    ("symbol_ratio", "n_symbols", "n_words", None, 0.3),
    ("stop_word_ratio", "n_stop_words", "n_words", 0.04, None),
    ("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    ("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 0.9),
    ("upper_case_ratio", "n_upper", "word_chars", None, 0.4),
)
#: Every measure, in the order of the columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_upper", "n_lines", "n_dup_lines", "n_bullet_lines", "n_repeat_words")


def ratio(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def verdict(rules=RULES) -> Column:
    """True where every rule of the table holds."""
    held = F.lit(True)
    for _, top, bottom, least, most in rules:
        value = ratio(top, bottom)
        if least is not None:
            held = held & (value >= least)
        if most is not None:
            held = held & (value <= most)
    return held


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash stands twice or more in the array of a text's window hashes."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # a one-element array binds the sorted array once, so that the lambda reads neighbours in place
    twice = F.transform(
        F.array(ordered),
        lambda s: F.array_sort(
            F.transform(
                F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))),
                lambda x: x["i"],
            )
        ),
    )
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        F.get(twice, 0),
        start,
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered).cast("long")


def measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with the measures that RULES names; each is a column of its own, and an input column of a measure's name gives way."""
    text = F.col("__text")
    held = docs.select(packed_row(docs, *MEASURES).alias("__doc"), F.coalesce(F.col(text_column), F.lit("")).alias("__text"))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    cut = held.withColumns({"__words": words, "__lines": lines})
    starts = F.when(F.size("__words") >= WINDOW, F.sequence(F.lit(0), F.size("__words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("__words"), i + k) for k in range(WINDOW)]))
    counted = cut.withColumns(
        {
            "__hashes": hashes,
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
            "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_bullet_lines": F.size(F.filter("__lines", lambda line: line.rlike("^[ \t]*[-*•]"))).cast("long"),
        }
    )
    counted = counted.withColumn("n_repeat_words", repeated_words(F.col("__hashes")))
    return counted.select(*unpacked_row(docs, "__doc", *MEASURES), *MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def quality_filter(docs: DataFrame, text_column: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    held = docs.select(F.struct("*").alias("__row"), F.col(text_column).alias("__text"))
    held = measured(held, "__text").where(~base_failed() & verdict(rules))
    return held.select("__row.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every document."""
    found = measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict()).alias("kept")
    )


def sql() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    rules = " AND ".join(
        f"(CASE WHEN {bottom} > 0 THEN {top}::DOUBLE / {bottom} ELSE 0 END) {sign} {bound}"
        for _, top, bottom, least, most in RULES
        for sign, bound in ((">=", least), ("<=", most))
        if bound is not None
    )
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)"
    word, line = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{line}')) AS ls
  FROM d
), g AS (
  SELECT r, i, ws[i : i + {WINDOW - 1}] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
    (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
    len(ls)::BIGINT AS n_lines,
    len(list_filter(ls, lambda l: regexp_matches(l, '^[ \t]*[-*•]')))::BIGINT AS n_bullet_lines
  FROM w LEFT JOIN covered c ON c.r = w.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed,
       (NOT {failed} AND {rules}) AS kept
FROM m"""
