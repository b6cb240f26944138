"""Secret scans with multipart credential linking, in DataFrame operations alone.

Strong patterns (BASE) are secrets by themselves. Weak patterns (identifier, key,
endpoint) are only reported where complementary parts stand within SCOPE code
points of them: an identifier or a key needs the other, an endpoint needs both.
Parts are rows with intervals; the interval join is an equi-join on (row, bin of
SCOPE) against the least and greatest start of each role in a bin, sent to the
three bins it can reach. It is exact, linear, and free of pairs.

Positions come from the text between matches: the pieces that `split` leaves and
the matches, summed in order.

Defined results: a null text is the empty text; rows are scanned each for itself,
repeated ones too; an empty table gives an empty table. A span's end is exclusive;
positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from bracketry.llm.common import checkpointed, packed_row, scratch, table, unpacked_row

#: Code points within which the parts of one credential stand.
SCOPE = 200


def either(word: str) -> str:
    """A pattern of the word's ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
_IDS = "|".join([either("client") + "_?" + either("id"), either("account") + "_?" + either("id"), either("user") + "_?" + either("name"), either("login")])
_GIVES = r"""["']?\x20*[:=]\x20*["']?"""

#: kind, pattern, group that must have `least` characters, least, role, words of which a matching text has one in lower case.
BASE = (
    ("assign", rf"({_NAMES}){_GIVES}([A-Za-z0-9+/_.=-]+)", 2, 8, "secret", ("password", "passwd", "secret", "token", "api")),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, "identifier", ("akia",)),
    ("hex", r"[0-9a-f]+", 0, 32, "secret", ()),
)
WEAK = (
    ("identifier", rf"({_IDS}){_GIVES}([A-Za-z0-9_.@-]+)", 2, 3, "identifier", ("client", "account", "user", "login")),
    ("key", r"[A-Za-z0-9/+]+", 0, 40, "secret", ()),
    ("endpoint", r"https?://[A-Za-z0-9.-]+", 0, 10, "endpoint", ("http",)),
)
KINDS = tuple(k[0] for k in (*BASE, *WEAK))
#: The roles that must stand near a weak part of each kind.
NEEDS = {"identifier": ("secret",), "key": ("identifier",), "endpoint": ("identifier", "secret")}


def found(text: Column, rank: int) -> Column:
    """array<struct<rank, at, gap, n, value_n, value>>: all matches of one pattern with the length of the text before each."""
    kind, pattern, group, least, _, words = (*BASE, *WEAK)[rank]
    # where every match is one run of a class, asking for the least length at once skips only failing matches
    search = pattern[:-1] + f"{{{least},}}" if pattern.endswith("]+") and pattern.startswith("[") else pattern
    if kind == "access":
        search = r"AKIA[A-Z0-9]{12,}"
    may = F.lit(True)
    if words:
        low = F.lower(text)
        may = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            may = may | F.contains(low, F.lit(w))
    whole = F.regexp_extract_all(text, F.lit(search), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(search), F.lit(group)) if group else whole
    rows = F.transform(
        F.arrays_zip(F.split(text, search, -1).alias("gap"), whole.alias("whole"), value.alias("value")),
        lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("at"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("n"), F.length(x["value"]).alias("value_n"), x["whole"].alias("value")),
    )
    rows = F.filter(rows, lambda x: x["n"].isNotNull())
    nothing = F.array().cast("array<struct<rank:int,at:int,gap:int,n:int,value_n:int,value:string>>")
    return F.when(may & text.rlike(search), rows).otherwise(nothing)


def candidates(text: Column) -> Column:
    """All matches of all patterns, in the form of `found`."""
    return F.concat(*[found(text, rank) for rank in range(len(KINDS))])


def placed(rows: DataFrame, *keep: str) -> DataFrame:
    """rows (__row, m) of one match each, with its place: __row, keep, rank, start, end, ok."""
    before = W.Window.partitionBy("__row", "m.rank").orderBy("m.at").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.n")).over(before)
    least = F.element_at(F.array(*[F.lit(k[3]) for k in (*BASE, *WEAK)]), F.col("m.rank") + 1)
    # a key has digits and letters of both cases; the other kinds need nothing more
    mixed = F.col("m.value").rlike("[0-9]") & F.col("m.value").rlike("[A-Z]") & F.col("m.value").rlike("[a-z]") & (F.col("m.n") == 40)
    ok = (F.col("m.value_n") >= least) & ((F.col("m.rank") != KINDS.index("key")) | mixed)
    return rows.withColumn("end", end).select("__row", *keep, F.col("m.rank").alias("rank"), (F.col("end") - F.col("m.n")).alias("start"), "end", ok.alias("ok"))


def parts(docs: DataFrame, text_column: str) -> DataFrame:
    """docs with a row number and a row for each match of each pattern (one row without a match where there is none): __row, __keep, rank, start, end, ok."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    # numbered below the generator: one number for a document, not for a match
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), packed_row(docs, text_column).alias("__keep"), candidates(text).alias("__found"))
    return placed(rows.select("__row", "__keep", F.explode_outer("__found").alias("m")), "__keep")


def linked(rows: DataFrame) -> DataFrame:
    """The weak parts that complementary parts stand near: __row, rank, start, end."""
    roles = F.array(*[F.lit(k[4]) for k in (*BASE, *WEAK)])
    good = rows.where("ok").select("__row", "rank", "start", "end", F.element_at(roles, F.col("rank") + 1).alias("role"), F.floor(F.col("start") / SCOPE).alias("bin"))
    weak = good.where(F.col("rank") >= len(BASE))
    reach = good.groupBy("__row", "bin", "role").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    reach = reach.select("__row", "role", "low", "high", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    reach = reach.withColumnRenamed("role", "near")
    near = weak.join(reach, ["__row", "bin"]).where((F.abs(F.col("low") - F.col("start")) <= SCOPE) | (F.abs(F.col("high") - F.col("start")) <= SCOPE) | ((F.col("low") <= F.col("start")) & (F.col("start") <= F.col("high"))))
    seen = near.groupBy("__row", "rank", "start", "end").agg(F.collect_set("near").alias("near"))
    held = F.lit(False)
    for kind, needs in NEEDS.items():
        all_near = F.lit(True)
        for role in needs:
            all_near = all_near & F.array_contains("near", role)
        held = held | ((F.col("rank") == KINDS.index(kind)) & all_near)
    return seen.where(held).select("__row", "rank", "start", "end")


def spans_of(rows: DataFrame, spans: str) -> DataFrame:
    """(__row, spans): of each row that has any, its spans (start, rank, end), sorted."""
    base = rows.where(F.col("ok") & (F.col("rank") < len(BASE))).select("__row", "rank", "start", "end")
    return base.unionByName(linked(rows)).groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias(spans))


def scan(docs: DataFrame, text_column: str = "text", spans: str = "__spans") -> DataFrame:
    """docs without the text, with __row and array column `spans` of (start, rank, end), sorted; rank counts KINDS. Input columns of these two names give way."""
    rows = checkpointed(parts(docs, text_column))
    # each document once: the row without a match, or the first match of the first pattern that has one
    first = F.row_number().over(W.Window.partitionBy("__row").orderBy("rank", "start"))
    once = rows.withColumn("__first", first).where(F.col("__first") == 1).select("__row", "__keep")
    kept = F.coalesce("__found", F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"))
    out = once.join(spans_of(rows, "__found"), "__row", "left")
    return out.select("__row", *unpacked_row(docs, "__keep", text_column, "__row", spans), kept.alias(spans))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """docs with each span's text replaced by [KIND]; overlapping spans are replaced as one. Rows, order of columns and clean texts are kept.

    Documents are numbered once and written with their matches to the shared folder;
    all that follows reads those numbers, so a mark can't come to another document
    however the input is partitioned or recomputed. Texts without a match pass by the join.
    """
    path = scratch(docs.sparkSession, "redact")
    matches = candidates(F.coalesce(F.col(text_column), F.lit("")))
    numbered = docs.select(F.monotonically_increasing_id().alias("__row"), packed_row(docs).alias("__doc"), matches.alias("__found"))
    numbered.withColumn("__n", F.size("__found")).write.parquet(path)
    held = docs.sparkSession.read.parquet(path)
    touched = held.where("__n > 0")
    hits = spans_of(checkpointed(placed(touched.select("__row", F.explode("__found").alias("m")))), "__spans")
    bare = held.where("__n = 0").select("__doc", F.lit(None).cast("array<struct<start:bigint,rank:int,end:bigint>>").alias("__spans"))
    both = bare.unionByName(touched.select("__row", "__doc").join(hits, "__row", "left").select("__doc", "__spans"))
    text = F.col("__doc").getField(text_column)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        mark = F.concat(F.lit("["), F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece, mark))).otherwise(acc["out"]).alias("out"))

    rest = F.aggregate("__spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    clean = both.withColumn("__text", F.when(F.col("__spans").isNull(), text).otherwise(rest))
    out = []
    for c in docs.columns:
        value = F.col("__text") if c == text_column else F.col("__doc").getField(c)
        if c == length_column:
            value = F.when(F.col("__spans").isNull(), value).otherwise(F.length("__text")).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    return clean.select(*out)


def counted(rank: int) -> Column:
    return F.size(F.filter("__spans", lambda s: s["rank"] == rank)).cast("long")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document."""
    hits = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("__spans", lambda s: s["rank"] < len(BASE))
    counts = [counted(r).alias(f"n_{kind[0]}") for r, kind in enumerate(BASE)]
    return hits.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("__spans")).alias("spans"))


def sql() -> str:
    """The same in DuckDB: the parts by the pieces between matches, the links by comparing the parts of a document."""
    blocks = []
    for rank, (kind, pattern, group, least, role, _) in enumerate((*BASE, *WEAK)):
        p = pattern.replace("'", "''")
        more = "AND n = 40 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')" if kind == "key" else ""
        blocks.append(
            f"SELECT r, {rank} AS rank, '{kind}' AS kind, '{role}' AS role, e - n AS s, e FROM ("
            f"SELECT r, i, n, v, sum(gap + n) OVER (PARTITION BY r ORDER BY i) AS e FROM ("
            f"SELECT r, i, length(gaps[i]) AS gap, length(ms[i]) AS n, vs[i] AS v FROM ("
            f"SELECT r, ms, vs, gaps, unnest(range(1, len(ms) + 1)) AS i FROM ("
            f"SELECT r, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, regexp_split_to_array(t, '{p}') AS gaps FROM d)))) "
            f"WHERE length(v) >= {least} {more}"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join(blocks)}),
near AS (
  SELECT w.r, w.rank, w.s, w.e, bool_or(c.role = 'secret') AS has_secret, bool_or(c.role = 'identifier') AS has_id
  FROM p w JOIN p c ON w.r = c.r AND abs(w.s - c.s) <= {SCOPE} WHERE w.rank >= {len(BASE)} GROUP BY ALL
),
spans AS (
  SELECT r, rank, kind, s, e FROM p WHERE rank < {len(BASE)}
  UNION ALL
  SELECT n.r, n.rank, p.kind, n.s, n.e FROM near n JOIN p ON p.r = n.r AND p.rank = n.rank AND p.s = n.s
  WHERE (p.kind = 'identifier' AND has_secret) OR (p.kind = 'key' AND has_id) OR (p.kind = 'endpoint' AND has_secret AND has_id)
),
g AS (
  SELECT r, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS h,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (WHERE rank < {len(BASE)}) AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.r = g.r"""
