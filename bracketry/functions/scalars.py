"""Scalar functions as pure Column expressions. A missing or unreadable input gives NULL unless stated."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight limits in pounds by division, in ladder order.
DIVISION_LBS = {
    "Strawweight": 115, "Flyweight": 125, "Bantamweight": 135, "Featherweight": 145, "Lightweight": 155,
    "Welterweight": 170, "Middleweight": 185, "Light Heavyweight": 205, "Heavyweight": 265,
}
# Words of bouts without a standard limit.
NONSTANDARD = "catch weight|catchweight|open weight|openweight|tournament"
# Result vocabulary; the first pattern found wins.
METHODS = (
    ("doctor", "TKO - Doctor's Stoppage"), ("decision.*unanimous", "Decision - Unanimous"), ("decision.*split", "Decision - Split"), ("decision.*majority", "Decision - Majority"),
    ("submission", "Submission"), (r"\btko\b", "KO/TKO"), (r"\bko\b", "KO/TKO"), (r"disqualification|\bdq\b", "DQ"), (r"no contest|\bnc\b", "NC"),
    ("could not continue", "Could Not Continue"), ("overturned", "Overturned"),
)
# Event tiers by name; the first pattern found wins.
TIERS = ((r"^ufc\s+\d+", "numbered"), ("fight night", "fight_night"), ("ufc on |ufc live", "broadcast"), ("ultimate fighter", "tuf_finale"))
# Feet above sea level of high venues.
ALTITUDE_FT = {
    "denver": 5280, "mexico city": 7350, "salt lake city": 4226, "calgary": 3438, "albuquerque": 5312, "monterrey": 1768, "johannesburg": 5751, "bogota": 8660, "quito": 9350,
}
# Date layouts, tried in turn.
DATE_LAYOUTS = ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy-MM-dd")
# Fixed value: pseudo-observations of a prior.
SHRINK_ALPHA = 5.0


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def height_inches(text: Column) -> Column:
    """5' 11" -> 71."""
    pattern = r"^\s*(\d+)'\s*(\d+(?:\.\d+)?)"
    return _number(text, pattern, 1) * 12 + _number(text, pattern, 2)


def leading_number(text: Column) -> Column:
    """Reach and weight: the number that the text starts with."""
    return _number(text, r"^\s*(\d+(?:\.\d+)?)")


def percent(text: Column) -> Column:
    """38% -> 0.38; the sign is required."""
    # Fixed value: the layout of a percentage.
    return _number(text, r"^\s*(\d+(?:\.\d+)?)\s*%") / 100


def is_title_bout(name: Column) -> Column:
    return F.coalesce(F.contains(F.lower(name), F.lit("title")), F.lit(False))


def is_womens_bout(name: Column) -> Column:
    return F.coalesce(F.contains(F.lower(name), F.lit("women")), F.lit(False))


def is_nonstandard_weight(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike(NONSTANDARD), F.lit(False))


def scheduled_rounds(layout: Column) -> Column:
    return _number(layout, r"^\s*(\d+)\s*Rnd")


def class_lbs(name: Column) -> Column:
    """The limit of the first division named, longer names first."""
    out = F.lit(None).cast("double")
    for word, lbs in sorted(DIVISION_LBS.items(), key=lambda x: len(x[0])):
        out = F.when(F.contains(name, F.lit(word)), F.lit(float(lbs))).otherwise(out)
    return out


def cut_burden_diff(weight_a: Column, weight_b: Column, limit: Column) -> Column:
    return F.abs(weight_a - limit) - F.abs(weight_b - limit)


def stance_matchup(a: Column, b: Column) -> Column:
    blank = F.coalesce(F.trim(a) == "", F.lit(True)) | F.coalesce(F.trim(b) == "", F.lit(True))
    return F.when(blank, "Unknown").when(a == b, "Same").otherwise("Opposite")


def age_years(on: Column, born: Column) -> Column:
    return F.datediff(on, born) / F.lit(365.25)


def division_of(weight: Column) -> Column:
    """The division whose limit is nearest; of equals the earlier."""
    ladder = F.array_min(F.array(*[F.struct(F.abs(weight - float(lbs)).alias("d"), F.lit(i).alias("i"), F.lit(word).alias("w")) for i, (word, lbs) in enumerate(DIVISION_LBS.items())]))
    return F.when(weight.isNull(), "weight unknown").otherwise(ladder["w"])


def shrink(successes: Column, n: Column, prior: Column, alpha: float = SHRINK_ALPHA) -> Column:
    return (successes + alpha * prior) / (n + alpha)


def normalise_method(raw: Column) -> Column:
    low, out = F.lower(F.coalesce(raw, F.lit(""))), F.trim(raw)
    for pattern, name in reversed(METHODS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def clean_name(raw: Column) -> Column:
    """Without champion marks and footnotes, white space collapsed."""
    # The marks.
    out = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\(c\)|\(ic\)", "")
    out = F.regexp_replace(out, r"\[[a-z0-9]+\]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _folded(names: pa.Array) -> pa.Array:
    out = []
    for name in names.to_pylist():
        letters = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c))
        out.append(re.sub(r"[^a-z ]", "", letters.lower()).strip())
    return pa.array(out, pa.string())


def fold(name: Column) -> Column:
    """Key without case and accents: letters a to z and spaces. Decomposition is no built-in function, so batches go through Arrow."""
    return F.arrow_udf(_folded, "string")(name)


def weight_class_string(raw: Column, title: Column) -> Column:
    div = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    return F.when(div == "", "").when(title, F.concat(F.lit("UFC "), div, F.lit(" Title Bout"))).otherwise(F.concat(div, F.lit(" Bout")))


def clock_seconds(end_round: Column, clock: Column) -> Column:
    """Seconds fought at a clock like 3:21 of a round of five minutes; unreadable: 0."""
    parts = F.split(clock, ":")
    total = (end_round.cast("int") - 1) * 300 + F.get(parts, 0).try_cast("int") * 60 + F.get(parts, 1).try_cast("int")
    return F.coalesce(F.when(F.size(parts) == 2, total), F.lit(0))


def bout_key(day: Column, a: Column, b: Column) -> Column:
    """The same key whichever side is named first."""
    x, y = (F.replace(fold(n), F.lit(" "), F.lit("_")) for n in (a, b))
    return F.concat_ws(":", F.lit("wiki"), F.date_format(day, "yyyy-MM-dd"), F.concat_ws("-", F.least(x, y), F.greatest(x, y)))


def article_slug(name: Column) -> Column:
    numbered = F.regexp_extract(F.trim(name), r"^(UFC\s+\d+)\s*:", 1)
    return F.replace(F.when(numbered != "", numbered).otherwise(name), F.lit(" "), F.lit("_"))


def references(text: Column) -> Column:
    """The text with the common character references read."""
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def strip_tags(cell: Column) -> Column:
    """Text of a table cell: no tags, the common character references read, cut at style residue, white space collapsed."""
    text = references(F.regexp_replace(cell, r"(?s)<[^>]+>", ""))
    # What marks the residue of a style.
    text = F.get(F.split(text, r"\.mw-parser-output|\{|\bN/?a\b"), 0)
    text = F.regexp_replace(text, "[\\s ]+", " ")
    return F.regexp_replace(text, "^[ —– -]+|[ —– -]+$", "")


def card_tier(name: Column) -> Column:
    low, out = F.lower(name), F.lit("other")
    for pattern, tier in reversed(TIERS):
        out = F.when(low.rlike(pattern), tier).otherwise(out)
    return out


def attendance(raw: Column) -> Column:
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"[^\d]", "").try_cast("int")


def parse_day(raw: Column) -> Column:
    """The first layout that reads the text."""
    return F.coalesce(*[F.try_to_date(F.trim(raw), layout) for layout in DATE_LAYOUTS])


def city_of(place: Column) -> Column:
    return F.trim(F.get(F.split(place, ","), 0))


def country_of(place: Column) -> Column:
    return F.trim(F.element_at(F.split(place, ","), -1))


def altitude_ft(city: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ALTITUDE_FT.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(city)), F.lit(0))


def support_label(n_a: Column, n_b: Column, thin: int = 3) -> Column:
    fewest = F.least(n_a, n_b)
    return F.when(fewest == 0, "none").when(fewest < thin, "thin").otherwise("ok")


def binary_entropy(p: Column) -> Column:
    """Bits; a pure share has none."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def half_width(low: Column, high: Column) -> Column:
    return (high - low) / 2


def verdict(delta: Column, low: Column, high: Column, lower_is_better: Column) -> Column:
    """What an interval of a paired difference says."""
    # The three verdicts.
    return F.when((low <= 0) & (high >= 0), "inside noise").when((delta < 0) == lower_is_better, "REAL improvement").otherwise("REAL regression")


def overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return (low_a <= high_b) & (low_b <= high_a)


def describe(name: Column, wins: Column, losses: Column, draws: Column, division: Column) -> Column:
    record = F.concat_ws("-", wins.cast("string"), losses.cast("string"), draws.cast("string"))
    return F.concat(name, F.lit("  ("), F.concat_ws(", ", F.nullif(record, F.lit("")), division), F.lit(")"))


def draw(seed: str, *keys: Column) -> Column:
    """A number below 2^32 fixed by seed and keys: the portable random draw."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


#: The lowest 32 bits, and the factor of the scrambling.
LOW_BITS, FACTOR = (1 << 32) - 1, 73244475


def folded_down(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftright(x, 16))


def scrambling(x: Column) -> Column:
    """A step that spreads a number below 2^32 over all of them; products stay below 2^63, so every engine computes the same."""
    return (folded_down(x) * F.lit(FACTOR)).bitwiseAND(F.lit(LOW_BITS))
