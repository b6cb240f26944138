"""The catalogue's queries: each a DataFrame plan next to its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from bracketry.functions import scalars as S
from bracketry.operators import history, matchup, metrics, quality, rating, resolve, splits, tree
from bracketry.plans.adapters import bouts, cte, entities
from bracketry.session import table
from bracketry.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def rnd(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.event_log(bouts(spark, sf_dir))


# ---- scalars ---------------------------------------------------------------

@query("parse_units", """
WITH t AS (SELECT p_partkey AS id, p_size, p_retailprice AS price FROM part),
s AS (SELECT id, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE (p_size % 3 + 4)::VARCHAR || ''' ' || (p_size % 12)::VARCHAR || '"' END AS h,
  CASE id % 5 WHEN 0 THEN NULL ELSE p_size::VARCHAR || '.5"' END AS r, CASE id % 6 WHEN 0 THEN '--' ELSE p_size::VARCHAR || ' lbs.' END AS w,
  CASE id % 3 WHEN 0 THEN p_size::VARCHAR ELSE p_size::VARCHAR || '%' END AS p FROM t)
SELECT id, try_cast(regexp_extract(h, '^\\s*(\\d+)''\\s*(\\d+)', 1) AS DOUBLE) * 12 + try_cast(regexp_extract(h, '^\\s*(\\d+)''\\s*(\\d+)', 2) AS DOUBLE) AS height_in,
  try_cast(nullif(regexp_extract(r, '^\\s*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS reach_in, try_cast(nullif(regexp_extract(w, '^\\s*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS weight_lbs,
  round(try_cast(nullif(regexp_extract(p, '^\\s*(\\d+(?:\\.\\d+)?)\\s*%', 1), '') AS DOUBLE) / 100, 6) AS share FROM s""")
def parse_units(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    text = size.cast("string")
    made = table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.when(key % 4 == 0, "").when(key % 4 == 1, "x").otherwise(F.concat((size % 3 + 4).cast("string"), F.lit("' "), (size % 12).cast("string"), F.lit('"'))).alias("h"),
        F.when(key % 5 != 0, F.concat(text, F.lit('.5"'))).alias("r"),
        F.when(key % 6 == 0, "--").otherwise(F.concat(text, F.lit(" lbs."))).alias("w"),
        F.when(key % 3 == 0, text).otherwise(F.concat(text, F.lit("%"))).alias("p"),
    )
    return made.select("id", S.height_inches(F.col("h")).alias("height_in"), S.leading_number(F.col("r")).alias("reach_in"), S.leading_number(F.col("w")).alias("weight_lbs"), rnd(S.percent(F.col("p"))).alias("share"))


NAMED = """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'UFC Lightweight Title Bout' WHEN 2 THEN 'Women''s Strawweight Bout' WHEN 3 THEN 'Catch Weight Bout'
  WHEN 4 THEN 'Light Heavyweight Bout' WHEN 5 THEN 'Heavyweight Bout' WHEN 6 THEN 'UFC Women''s Bantamweight Title Bout' ELSE 'Open Weight Tournament' END AS name FROM customer"""


def named(spark, sf_dir):
    values = ["UFC Lightweight Title Bout", "Women's Strawweight Bout", "Catch Weight Bout", "Light Heavyweight Bout", "Heavyweight Bout", "UFC Women's Bantamweight Title Bout", "Open Weight Tournament"]
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.get(F.array(F.lit(None).cast("string"), *[F.lit(v) for v in values]), (key % 8).cast("int")).alias("name"))


@query("bout_flags", f"""WITH n AS ({NAMED})
SELECT id, coalesce(contains(lower(name), 'title'), false) AS title, coalesce(contains(lower(name), 'women'), false) AS womens,
  coalesce(regexp_matches(lower(name), 'catch weight|catchweight|open weight|openweight|tournament'), false) AS nonstandard,
  CASE WHEN contains(name, 'Light Heavyweight') THEN 205 WHEN contains(name, 'Featherweight') THEN 145 WHEN contains(name, 'Strawweight') THEN 115 WHEN contains(name, 'Bantamweight') THEN 135
   WHEN contains(name, 'Lightweight') THEN 155 WHEN contains(name, 'Heavyweight') THEN 265 END::DOUBLE AS lbs FROM n""")
def bout_flags(spark, sf_dir):
    n = F.col("name")
    return named(spark, sf_dir).select("id", S.is_title_bout(n).alias("title"), S.is_womens_bout(n).alias("womens"), S.is_nonstandard_weight(n).alias("nonstandard"), S.class_lbs(n).alias("lbs"))


@query("scheduled_rounds_impute", cte("bout") + """
SELECT bout_id, coalesce(try_cast(nullif(regexp_extract(layout, '^\\s*(\\d+)\\s*Rnd', 1), '') AS DOUBLE), 3) AS rounds, try_cast(nullif(regexp_extract(layout, '^\\s*(\\d+)\\s*Rnd', 1), '') AS DOUBLE) IS NULL AS missing FROM bout""")
def scheduled_rounds_impute(spark, sf_dir):
    r = S.scheduled_rounds(F.col("layout"))
    return bouts(spark, sf_dir).select("bout_id", F.coalesce(r, F.lit(3.0)).alias("rounds"), r.isNull().alias("missing"))


@query("serve_default_agreement", cte("bout") + """
SELECT round(avg((coalesce(try_cast(nullif(regexp_extract(layout, '^\\s*(\\d+)\\s*Rnd', 1), '') AS DOUBLE), 3) = 3)::INTEGER), 6) AS agreement FROM bout""")
def serve_default_agreement(spark, sf_dir):
    r = F.coalesce(S.scheduled_rounds(F.col("layout")), F.lit(matchup.DEFAULT_ROUNDS))
    return bouts(spark, sf_dir).agg(rnd(F.avg((r == matchup.DEFAULT_ROUNDS).cast("double"))).alias("agreement"))


#: The limit of each class of the fixture, written out.
LIMIT = "CASE cls WHEN 'UFC Lightweight Title Bout' THEN 155 WHEN 'Women''s Strawweight Bout' THEN 115 WHEN 'Light Heavyweight Bout' THEN 205 WHEN 'Bantamweight Bout' THEN 135 END"


@query("cut_burden", cte("entity", "bout") + f"""
SELECT bout_id, abs(a.weight - {LIMIT}) - abs(b.weight - {LIMIT}) AS cut_burden, a.weight - b.weight AS weight_diff FROM bout JOIN entity a ON a.id = e1 JOIN entity b ON b.id = e2""")
def cut_burden(spark, sf_dir):
    both = matchup.with_bios(bouts(spark, sf_dir).withColumnsRenamed({"e1": "a", "e2": "b"}), entities(spark, sf_dir))
    a, b = F.col("a_weight"), F.col("b_weight")
    return both.select("bout_id", S.cut_burden_diff(a, b, S.class_lbs(F.col("cls"))).alias("cut_burden"), (a - b).alias("weight_diff"))


LADDER = ", ".join(f"({i}, '{w}', {lbs})" for i, (w, lbs) in enumerate(S.DIVISION_LBS.items()))


@query("nearest_division", cte("entity") + f""", ladder(i, w, lbs) AS (VALUES {LADDER})
SELECT id, CASE WHEN weight IS NULL THEN 'weight unknown' ELSE (SELECT w FROM ladder ORDER BY abs(weight - lbs), i LIMIT 1) END AS division FROM entity""")
def nearest_division(spark, sf_dir):
    return entities(spark, sf_dir).select("id", S.division_of(F.col("weight")).alias("division"))


@query("stance_matchup", cte("entity", "bout") + """
SELECT bout_id, CASE WHEN trim(a.stance) = '' OR trim(b.stance) = '' THEN 'Unknown' WHEN a.stance = b.stance THEN 'Same' ELSE 'Opposite' END AS stance FROM bout JOIN entity a ON a.id = e1 JOIN entity b ON b.id = e2""")
def stance_matchup(spark, sf_dir):
    both = matchup.with_bios(bouts(spark, sf_dir).withColumnsRenamed({"e1": "a", "e2": "b"}), entities(spark, sf_dir))
    return both.select("bout_id", S.stance_matchup(F.col("a_stance"), F.col("b_stance")).alias("stance"))


@query("age_years", cte("entity", "bout") + " SELECT bout_id, round(date_diff('day', born, dt) / 365.25::DOUBLE, 6) AS age FROM bout JOIN entity ON id = e1")
def age_years(spark, sf_dir):
    return bouts(spark, sf_dir).join(entities(spark, sf_dir), F.col("id") == F.col("e1")).select("bout_id", rnd(S.age_years(F.col("dt"), F.col("born"))).alias("age"))


RAW_METHODS = ["TKO (doctor stoppage)", "Decision (unanimous)", " Decision - split", "decision: majority", "Submission (rear-naked choke)", "TKO (punches)", "KO (kick)", "DQ (knee)", "No Contest", "Could not continue", "Overturned by commission", " Draw "]
METHOD_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(raw, '')), '{p}') THEN '{v.replace(chr(39), chr(39) * 2)}'" for p, v in S.METHODS) + " ELSE trim(raw) END"


def picked(spark, sf_dir, values, name="raw"):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int")).alias(name))


def picked_sql(values, name="raw"):
    items = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"SELECT c_custkey AS id, [{items}][c_custkey % {len(values)} + 1] AS {name} FROM customer"


@query("normalise_method", f"WITH r AS ({picked_sql(RAW_METHODS)}) SELECT id, {METHOD_SQL} AS method FROM r")
def normalise_method(spark, sf_dir):
    return picked(spark, sf_dir, RAW_METHODS).select("id", S.normalise_method(F.col("raw")).alias("method"))


EVENTS = ["UFC 300: Pereira vs. Hill", "UFC Fight Night: A vs. B", "UFC on ESPN: C vs. D", "UFC Live 3", "The Ultimate Fighter 9 Finale", "Pride 5"]
TIER_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(raw), '{p}') THEN '{v}'" for p, v in S.TIERS) + " ELSE 'other' END"


@query("card_tier", f"WITH r AS ({picked_sql(EVENTS)}) SELECT {TIER_SQL} AS tier, count(*)::BIGINT AS n FROM r GROUP BY 1")
def card_tier(spark, sf_dir):
    return picked(spark, sf_dir, EVENTS).groupBy(S.card_tier(F.col("raw")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("article_slug", f"WITH r AS ({picked_sql(EVENTS)}) SELECT id, replace(CASE WHEN regexp_matches(raw, '^UFC\\s+\\d+\\s*:') THEN regexp_extract(raw, '^(UFC\\s+\\d+)\\s*:', 1) ELSE raw END, ' ', '_') AS slug FROM r")
def article_slug(spark, sf_dir):
    return picked(spark, sf_dir, EVENTS).select("id", S.article_slug(F.col("raw")).alias("slug"))


NAMES = ["José  Aldo (c)", "Jan Błachowicz[a]", " Jiří Procházka (ic) ", "Anna Lee", None, "Ørsted Ñandú [12]"]


@query("clean_name", f"WITH r AS ({picked_sql(NAMES)}) SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(raw, ''), '\\(c\\)|\\(ic\\)', '', 'g'), '\\[[a-z0-9]+\\]', '', 'g'), '\\s+', ' ', 'g')) AS name FROM r")
def clean_name(spark, sf_dir):
    return picked(spark, sf_dir, NAMES).select("id", S.clean_name(F.col("raw")).alias("name"))


FOLDED = ["José Aldo", "Jiří Procházka", "ANNA Lee-3", None, "Ñandú é"]


@query("fight_key", f"WITH r AS ({picked_sql(FOLDED)}), k AS (SELECT id, replace(trim(regexp_replace(lower(strip_accents(coalesce(raw, ''))), '[^a-z ]', '', 'g')), ' ', '_') AS x FROM r) SELECT id, 'wiki:2024-03-02:' || least(x, 'bo_lee') || '-' || greatest(x, 'bo_lee') AS key FROM k")
def fight_key(spark, sf_dir):
    return picked(spark, sf_dir, FOLDED).select("id", S.bout_key(F.lit("2024-03-02").cast("date"), F.col("raw"), F.lit("Bo Lee")).alias("key"))


DIVISIONS = ["Lightweight", " Women's  Flyweight ", "", None]


@query("weight_class_string", f"WITH r AS ({picked_sql(DIVISIONS)}), d AS (SELECT id, trim(regexp_replace(coalesce(raw, ''), '\\s+', ' ', 'g')) AS d FROM r) SELECT id, CASE WHEN d = '' THEN '' WHEN id % 3 = 0 THEN 'UFC ' || d || ' Title Bout' ELSE d || ' Bout' END AS cls FROM d")
def weight_class_string(spark, sf_dir):
    return picked(spark, sf_dir, DIVISIONS).select("id", S.weight_class_string(F.col("raw"), F.col("id") % 3 == 0).alias("cls"))


CLOCKS = ["4:32", "0:09", "x", None, "5:00", "1:2:3"]


@query("clock_seconds", f"WITH r AS ({picked_sql(CLOCKS)}) SELECT id, coalesce(CASE WHEN len(string_split(raw, ':')) = 2 THEN (id % 5)::INTEGER * 300 + try_cast(string_split(raw, ':')[1] AS INTEGER) * 60 + try_cast(string_split(raw, ':')[2] AS INTEGER) END, 0)::INTEGER AS secs FROM r")
def clock_seconds(spark, sf_dir):
    return picked(spark, sf_dir, CLOCKS).select("id", S.clock_seconds(F.col("id") % 5 + 1, F.col("raw")).alias("secs"))


DAYS = ["Mar 5, 2024", "March 15, 2023", "7 Jan 2022", "2021-12-31", "soon", None, " Feb 29, 2023"]


@query("multi_format_date", f"WITH r AS ({picked_sql(DAYS)}) SELECT id, coalesce(try_strptime(trim(raw), '%b %d, %Y'), try_strptime(trim(raw), '%B %d, %Y'), try_strptime(trim(raw), '%d %b %Y'), try_strptime(trim(raw), '%Y-%m-%d'))::DATE AS day FROM r")
def multi_format_date(spark, sf_dir):
    return picked(spark, sf_dir, DAYS).select("id", S.parse_day(F.col("raw")).alias("day"))


CROWDS = ["18,201", "about 9 000", "N/A", None, ""]


@query("attendance", f"WITH r AS ({picked_sql(CROWDS)}) SELECT id, try_cast(nullif(regexp_replace(coalesce(raw, ''), '[^0-9]', '', 'g'), '') AS INTEGER) AS crowd FROM r")
def attendance(spark, sf_dir):
    return picked(spark, sf_dir, CROWDS).select("id", S.attendance(F.col("raw")).alias("crowd"))


PLACES = ["Denver, Colorado, U.S.", "Las Vegas, Nevada, U.S.", "Mexico City, Mexico", "London"]
ALTITUDE_SQL = "CASE lower(trim(string_split(raw, ',')[1])) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.ALTITUDE_FT.items()) + " ELSE 0 END"


@query("city_altitude", f"WITH r AS ({picked_sql(PLACES)}) SELECT id, trim(string_split(raw, ',')[1]) AS city, trim(string_split(raw, ',')[-1]) AS country, {ALTITUDE_SQL}::INTEGER AS feet FROM r")
def city_altitude(spark, sf_dir):
    city = S.city_of(F.col("raw"))
    return picked(spark, sf_dir, PLACES).select("id", city.alias("city"), S.country_of(F.col("raw")).alias("country"), S.altitude_ft(city).alias("feet"))


CELLS = ["<a href='x'>Tom &amp; Co</a>", "<b> One </b> <i>two</i>.mw-parser-output x", "12 N/A rest", "&nbsp;— dash –", None]


@query("strip_tags", f"""WITH r AS ({picked_sql(CELLS)}),
s AS (SELECT id, replace(replace(regexp_replace(raw, '<[^>]+>', '', 'g'), '&nbsp;', chr(160)), '&amp;', '&') AS t FROM r)
SELECT id, regexp_replace(regexp_replace(regexp_split_to_array(t, '\\.mw-parser-output|\\{{|\\bN/?a\\b')[1], '[\\s' || chr(160) || ']+', ' ', 'g'), '^[ —–-]+|[ —–-]+$', '', 'g') AS text FROM s""")
def strip_tags(spark, sf_dir):
    return picked(spark, sf_dir, CELLS).select("id", S.strip_tags(F.col("raw")).alias("text"))


@query("describe_entity", cte("entity") + f""", ladder(i, w, lbs) AS (VALUES {LADDER})
SELECT id, name || '  (' || (id % 30)::VARCHAR || '-' || (id % 7)::VARCHAR || CASE WHEN id % 5 = 0 THEN '' ELSE '-1' END || ', ' || CASE WHEN weight IS NULL THEN 'weight unknown' ELSE (SELECT w FROM ladder ORDER BY abs(weight - lbs), i LIMIT 1) END || ')' AS text FROM entity""")
def describe_entity(spark, sf_dir):
    key = F.col("id")
    return entities(spark, sf_dir).select("id", S.describe(F.col("name"), key % 30, key % 7, F.when(key % 5 != 0, F.lit(1)), S.division_of(F.col("weight"))).alias("text"))


# ---- joins and resolution ---------------------------------------------------

PROFILES = "profile AS (SELECT p_partkey AS id, p_name || ' ' || (p_partkey % 200)::VARCHAR AS name, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size::DOUBLE + 110 END AS weight FROM part)"
ASKED = "asked AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 50 = 0 THEN 'nobody' ELSE name END AS name, (115 + o_orderkey % 5 * 10)::DOUBLE AS lim FROM orders JOIN profile ON id = o_orderkey % (SELECT max(id) + 1 FROM profile))"


def profiles(spark, sf_dir):
    return entities(spark, sf_dir).withColumn("name", F.concat_ws(" ", "name", (F.col("id") % 200).cast("string")))


def asked(spark, sf_dir):
    known = profiles(spark, sf_dir)
    top = known.agg((F.max("id") + 1).alias("top"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")).crossJoin(F.broadcast(top))
    named_ = orders.join(known.select("id", "name"), F.col("id") == F.col("key") % F.col("top"))
    return named_.select("key", F.when(F.col("key") % 50 == 0, "nobody").otherwise(F.col("name")).alias("name"), (115 + F.col("key") % 5 * 10).cast("double").alias("limit"))


@query("nearest_profile_resolve", f"""WITH {PROFILES}, {ASKED},
c AS (SELECT name, count(*) AS n FROM profile GROUP BY 1),
r AS (SELECT a.key, a.name, c.n, p.id, p.weight, row_number() OVER (PARTITION BY a.key ORDER BY CASE WHEN c.n = 1 THEN 0 ELSE abs(p.weight - a.lim) END NULLS LAST, p.id) AS rn FROM asked a LEFT JOIN c ON c.name = a.name LEFT JOIN profile p ON p.name = a.name)
SELECT key, name, CASE WHEN n = 1 OR weight IS NOT NULL THEN id END AS id, CASE WHEN n IS NULL THEN 'unknown name' WHEN n = 1 THEN 'unique' WHEN weight IS NULL THEN 'ambiguous' ELSE 'nearest weight' END AS note FROM r WHERE rn = 1""")
def nearest_profile_resolve(spark, sf_dir):
    return resolve.resolve(asked(spark, sf_dir), profiles(spark, sf_dir)).select("key", "name", "id", "note")


@query("resolution_counts", f"""WITH {PROFILES}, {ASKED}, c AS (SELECT name, count(*) AS n, count(weight) AS w FROM profile GROUP BY 1)
SELECT count(*)::BIGINT AS raw, count(*) FILTER (WHERE n = 1 OR w > 0)::BIGINT AS resolved, count(*) FILTER (WHERE n IS NULL OR (n > 1 AND w = 0))::BIGINT AS dropped FROM asked LEFT JOIN c USING (name)""")
def resolution_counts(spark, sf_dir):
    found = resolve.resolve(asked(spark, sf_dir), profiles(spark, sf_dir))
    return found.agg(F.count(F.lit(1)).alias("raw"), F.count("id").alias("resolved"), F.count_if(F.col("id").isNull()).alias("dropped"))


@query("naive_name_join", f"WITH {PROFILES}, s AS (SELECT s_suppkey AS k, p.name AS n1, q.name AS n2 FROM supplier JOIN profile p ON p.id = s_suppkey LEFT JOIN profile q ON q.id = s_suppkey + 1) SELECT k, a.id AS id1, a.weight AS weight1, b.id AS id2, b.weight AS weight2 FROM s LEFT JOIN profile a ON a.name = n1 LEFT JOIN profile b ON b.name = n2")
def naive_name_join(spark, sf_dir):
    known = profiles(spark, sf_dir).select("id", "name", "weight")
    named_ = lambda shift, name: table(spark, sf_dir, "supplier").join(known, F.col("id") == F.col("s_suppkey") + shift).select(F.col("s_suppkey").alias("k"), F.col("name").alias(name))
    both = named_(0, "n1").join(named_(1, "n2"), "k", "left")
    return resolve.join_by_name(both, known, {"n1": "one_", "n2": "two_"}).select("k", F.col("one_id").alias("id1"), F.col("one_weight").alias("weight1"), F.col("two_id").alias("id2"), F.col("two_weight").alias("weight2"))


@query("entity_lookup", f"WITH {PROFILES}, q AS (SELECT s_suppkey AS k, p.name FROM supplier JOIN profile p ON p.id = s_suppkey) SELECT DISTINCT p.name, p.id, p.weight FROM q JOIN profile p USING (name)")
def entity_lookup(spark, sf_dir):
    """Names to all their ids, and those ids to their profiles."""
    known = profiles(spark, sf_dir).select("id", "name", "weight")
    some = table(spark, sf_dir, "supplier").join(known, F.col("id") == F.col("s_suppkey")).select("name")
    return resolve.lookup(resolve.candidates(some, known).select("id"), known).select("name", "id", "weight")


@query("stats_join", "SELECT o_orderkey AS bout_id, o_totalprice AS price, n::BIGINT AS n, round(q, 6) AS q FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 30 GROUP BY 1) ON l_orderkey = o_orderkey")
def stats_join(spark, sf_dir):
    """Bouts and their statistics, one row of each; a repeated key would raise."""
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bout_id"), F.col("o_totalprice").alias("price"))
    right = table(spark, sf_dir, "lineitem").where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("bout_id")).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("l_quantity")).alias("q"))
    return history.with_stats(left, right)


@query("null_safe_equality", cte("bout") + " SELECT 'q' AS stat, count(*) FILTER (WHERE q1 IS NOT DISTINCT FROM q2)::BIGINT AS same, count(*)::BIGINT AS n FROM bout UNION ALL SELECT 'td', count(*) FILTER (WHERE td1 IS NOT DISTINCT FROM td2), count(*) FROM bout")
def null_safe_equality(spark, sf_dir):
    counts = bouts(spark, sf_dir).agg(*[F.count_if(quality.same(F.col(f"{s}1"), F.col(f"{s}2"))).alias(s) for s in ("q", "td")], F.count(F.lit(1)).alias("n"))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("same"), "n") for s in ("q", "td")])))


@query("join_inflation", f"WITH {PROFILES}, s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'nobody' ELSE p.name END AS name FROM supplier JOIN profile p ON p.id = s_suppkey), j AS (SELECT k, id FROM s LEFT JOIN profile USING (name)) SELECT count(*)::BIGINT AS n_out, count(DISTINCT k)::BIGINT AS n_in, count(*) FILTER (WHERE id IS NULL)::BIGINT AS unmatched FROM j")
def join_inflation(spark, sf_dir):
    known = profiles(spark, sf_dir)
    some = table(spark, sf_dir, "supplier").join(known, F.col("id") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 4 == 0, "nobody").otherwise(F.col("name")).alias("name"))
    # counts alone need no fanned-out rows: a name's profiles are counted first
    per_name = known.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return some.join(per_name, "name", "left").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n_out"), F.count_distinct("k").alias("n_in"), F.count_if(F.col("n").isNull()).alias("unmatched"))


@query("bio_join", cte("entity", "bout") + " SELECT bout_id, a.weight AS a_weight, b.weight AS b_weight, a.reach AS a_reach, b.reach AS b_reach FROM bout LEFT JOIN entity a ON a.id = e1 LEFT JOIN entity b ON b.id = e2")
def bio_join(spark, sf_dir):
    return matchup.with_bios(bouts(spark, sf_dir).withColumnsRenamed({"e1": "a", "e2": "b"}), entities(spark, sf_dir)).select("bout_id", "a_weight", "b_weight", "a_reach", "b_reach")


@query("anti_unknown", "WITH k AS (SELECT DISTINCT n_name AS name FROM nation WHERE n_nationkey % 2 = 0), q AS (SELECT DISTINCT n_name AS name FROM nation) SELECT name FROM q WHERE regexp_replace(lower(name), '[^a-z ]', '', 'g') NOT IN (SELECT regexp_replace(lower(name), '[^a-z ]', '', 'g') FROM k) UNION ALL SELECT 'zz top'")
def anti_unknown(spark, sf_dir):
    every = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    names = every.select("name").distinct().union(spark.sql("SELECT 'zz top'"))
    return resolve.unknown(names, every.where("n_nationkey % 2 = 0")).select("name")


@query("semi_overlap", "SELECT count(*)::BIGINT AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def semi_overlap(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("canonical_name", "WITH k AS (SELECT regexp_replace(lower(r_name), '[^a-z ]', '', 'g') AS key, min_by(r_name, r_regionkey) AS c FROM region GROUP BY 1), q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Asia' WHEN c_custkey % 3 = 1 THEN 'europe' ELSE 'Atlantis' END AS name FROM customer) SELECT id, coalesce(c, name) AS canonical FROM q LEFT JOIN k ON key = regexp_replace(lower(name), '[^a-z ]', '', 'g')")
def canonical_name(spark, sf_dir):
    known = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("ord"))
    return resolve.canonical(picked(spark, sf_dir, ["Asia", "europe", "Atlantis"], "name"), known).select("id", "canonical")


@query("event_context_join", cte("bout") + ", ev AS (SELECT ts::DATE AS d, event_id, value, row_number() OVER (PARTITION BY (ts::DATE) ORDER BY event_id) AS rn FROM events) SELECT bout_id, event_id, value FROM bout LEFT JOIN ev ON d = dt + INTERVAL 9000 DAY AND rn = 1")
def event_context_join(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("e"))
    return bouts(spark, sf_dir).join(first, F.col("d") == F.date_add("dt", 9000), "left").select("bout_id", "e.event_id", "e.value")


@query("suggest_names", "WITH n AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY 1), h AS (SELECT name, row_number() OVER (ORDER BY ord) AS rank FROM n WHERE contains(lower(name), 'red') AND contains(lower(name), 'w')) SELECT 'red w' AS query, name, rank::INTEGER AS rank FROM h WHERE rank <= 6")
def suggest_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    found = names.where(resolve.contains_words(F.col("name"), F.lit("red w"))).groupBy("name").agg(F.min("ord").alias("ord"))
    return found.orderBy("ord").limit(6).select(F.lit("red w").alias("query"), "name", F.row_number().over(W.Window.orderBy("ord")).alias("rank"))


@query("suggest_spellings", None)
def suggest_spellings(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return resolve.suggest(spark.createDataFrame([("smal rng",), ("red widgit",)], "query string"), names)


# ---- filters, features ------------------------------------------------------

@query("label_clean", cte("bout") + " SELECT bout_id FROM bout WHERE winner = e1 OR winner = e2")
def label_clean(spark, sf_dir):
    return matchup.decisive(bouts(spark, sf_dir)).select("bout_id")


@query("position_bias", cte("bout") + " SELECT round(avg((winner = e1)::INTEGER), 6) AS first_wins, count(*)::BIGINT AS n FROM bout WHERE winner IS NOT NULL")
def position_bias(spark, sf_dir):
    return matchup.decisive(bouts(spark, sf_dir)).agg(rnd(F.avg((F.col("winner") == F.col("e1")).cast("double"))).alias("first_wins"), F.count(F.lit(1)).alias("n"))


DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
COIN = DRAW.format("'42:' || bout_id") + " < 2147483648"
ROUNDS = "try_cast(nullif(regexp_extract(layout, '^\\s*(\\d+)\\s*Rnd', 1), '') AS DOUBLE)"
FEATURES = f""", side AS (SELECT *, {COIN} AS a_is_first, CASE WHEN {COIN} THEN e1 ELSE e2 END AS a, CASE WHEN {COIN} THEN e2 ELSE e1 END AS b FROM bout WHERE winner IS NOT NULL),
feat AS (SELECT bout_id, dt, cls, s.a, s.b, a_is_first, method, end_round, x.weight - y.weight AS wd, abs(x.weight - {LIMIT}) - abs(y.weight - {LIMIT}) AS cb, x.reach - y.reach AS rd, x.height - y.height AS hd,
  date_diff('day', x.born, dt) / 365.25::DOUBLE - date_diff('day', y.born, dt) / 365.25::DOUBLE AS ad,
  CASE WHEN trim(x.stance) = '' OR trim(y.stance) = '' THEN 'Unknown' WHEN x.stance = y.stance THEN 'Same' ELSE 'Opposite' END AS stance_matchup,
  cls LIKE '%Title%' AS is_title_bout, cls LIKE 'Women%' AS is_womens_bout, cls = 'Catch Weight Bout' AS is_nonstandard_weight, {ROUNDS} AS rounds, (winner = s.a)::INTEGER AS label
  FROM side s LEFT JOIN entity x ON x.id = s.a LEFT JOIN entity y ON y.id = s.b)"""


def feature_table(spark, sf_dir):
    return matchup.feature_table(bouts(spark, sf_dir), entities(spark, sf_dir))


@query("coin_flip_sides", cte("entity", "bout") + FEATURES + " SELECT bout_id, a, b, a_is_first, label FROM feat")
def coin_flip_sides(spark, sf_dir):
    return feature_table(spark, sf_dir).select("bout_id", "a", "b", "a_is_first", "label")


@query("feature_table", cte("entity", "bout") + FEATURES + """ SELECT bout_id, dt, cls, a, b, a_is_first, method, end_round, coalesce(wd, 0) AS weight_diff, wd IS NULL AS weight_diff_missing, coalesce(cb, 0) AS cut_burden_diff, cb IS NULL AS cut_burden_diff_missing,
  round(coalesce(rd, 0), 6) AS reach_diff, rd IS NULL AS reach_diff_missing, coalesce(hd, 0) AS height_diff, hd IS NULL AS height_diff_missing, round(coalesce(ad, 0), 6) AS age_diff, ad IS NULL AS age_diff_missing,
  stance_matchup, is_title_bout, is_womens_bout, is_nonstandard_weight, coalesce(rounds, 3) AS scheduled_rounds, rounds IS NULL AS scheduled_rounds_missing, label FROM feat""")
def feature_table_query(spark, sf_dir):
    return feature_table(spark, sf_dir).withColumns({c: rnd(F.col(c)) for c in ("reach_diff", "age_diff")})


MATRIX = ["round(coalesce(rd, 0), 6)", "coalesce(hd, 0)", "round(coalesce(ad, 0), 6)", "rd IS NULL", "hd IS NULL", "ad IS NULL", "stance_matchup = 'Same'", "stance_matchup = 'Unknown'", "is_title_bout", "is_womens_bout", "is_nonstandard_weight", "coalesce(rounds, 3)", "rounds IS NULL", "coalesce(wd, 0)", "wd IS NULL", "coalesce(cb, 0)", "cb IS NULL"]


@query("model_matrix", cte("entity", "bout") + FEATURES + " SELECT bout_id, " + ", ".join(f"({e})::DOUBLE AS x{i}" for i, e in enumerate(MATRIX)) + ", label AS y FROM feat")
def model_matrix(spark, sf_dir):
    names = matchup.feature_names(context=True, weight=True)
    x = matchup.matrix(feature_table(spark, sf_dir), tuple(names))
    return x.select("bout_id", *[(rnd(F.get("x", i)) if n in ("reach_diff", "age_diff") else F.get("x", i)).alias(f"x{i}") for i, n in enumerate(names)], "y")


NAMED_BOUTS = f"""{cte("entity", "bout")}, profile AS (SELECT id, name || ' ' || (id % 200)::VARCHAR AS name, weight, reach, stance, born, height FROM entity),
named AS (SELECT b.*, {LIMIT}::DOUBLE AS lim, x.name AS n1, y.name AS n2, w.name AS wn FROM bout b JOIN profile x ON x.id = e1 JOIN profile y ON y.id = e2 LEFT JOIN profile w ON w.id = winner),
c AS (SELECT name, count(*) AS n FROM profile GROUP BY 1), ask AS (SELECT DISTINCT n1 AS name, lim FROM named UNION SELECT DISTINCT n2, lim FROM named),
r AS (SELECT a.name, a.lim, c.n, p.id, abs(p.weight - a.lim) AS d, row_number() OVER (PARTITION BY a.name, a.lim ORDER BY CASE WHEN c.n = 1 THEN 0 ELSE abs(p.weight - a.lim) END NULLS LAST, p.id) AS rn FROM ask a JOIN c USING (name) JOIN profile p USING (name)),
found AS (SELECT name, lim, CASE WHEN n = 1 OR d IS NOT NULL THEN id END AS id FROM r WHERE rn = 1),
both_ AS (SELECT named.*, f.id AS i1, g.id AS i2 FROM named JOIN found f ON f.name = n1 AND f.lim IS NOT DISTINCT FROM named.lim JOIN found g ON g.name = n2 AND g.lim IS NOT DISTINCT FROM named.lim)"""


def named_bouts(spark, sf_dir):
    """The bouts with names for ids, the winner's too."""
    named_ = profiles(spark, sf_dir).select("id", "name")
    out = bouts(spark, sf_dir)
    for column, name in (("e1", "n1"), ("e2", "n2"), ("winner", "wn")):
        out = out.join(named_.select(F.col("id").alias(column), F.col("name").alias(name)), column, "left")
    return out.select("bout_id", "dt", "cls", "n1", "n2", "wn", "method", "end_round", "layout")


@query("feature_table_from_names", NAMED_BOUTS + """ SELECT bout_id, CASE WHEN coin THEN i1 ELSE i2 END AS a, CASE WHEN coin THEN i2 ELSE i1 END AS b, (wn = CASE WHEN coin THEN n1 ELSE n2 END)::INTEGER AS label,
  coalesce(CASE WHEN coin THEN x.weight - y.weight ELSE y.weight - x.weight END, 0) AS weight_diff, coalesce(CASE WHEN coin THEN x.height - y.height ELSE y.height - x.height END, 0) AS height_diff
  FROM (SELECT *, """ + COIN + """ AS coin FROM both_ WHERE i1 IS NOT NULL AND i2 IS NOT NULL AND wn IN (n1, n2)) JOIN profile x ON x.id = i1 JOIN profile y ON y.id = i2""")
def feature_table_from_names(spark, sf_dir):
    """Names resolved by weight, unresolved and undecided bouts dropped, then the feature table: one chain."""
    rows = matchup.build(named_bouts(spark, sf_dir), profiles(spark, sf_dir))[0]
    return rows.select("bout_id", "a", "b", "label", "weight_diff", "height_diff")


@query("build_counters", NAMED_BOUTS + " SELECT count(*)::BIGINT AS raw, count(*) FILTER (WHERE i1 IS NOT NULL AND i2 IS NOT NULL)::BIGINT AS resolved, count(*) FILTER (WHERE i1 IS NOT NULL AND i2 IS NOT NULL AND wn IN (n1, n2))::BIGINT AS final FROM both_")
def build_counters(spark, sf_dir):
    return matchup.build(named_bouts(spark, sf_dir), profiles(spark, sf_dir))[1]


# ---- quality ----------------------------------------------------------------

@query("null_profile", cte("entity") + " SELECT * FROM (SELECT 'weight' AS \"column\", count(*) FILTER (WHERE weight IS NULL)::BIGINT AS missing, round(count(*) FILTER (WHERE weight IS NULL) / count(*)::DOUBLE, 6) AS share FROM entity UNION ALL SELECT 'reach', count(*) FILTER (WHERE reach IS NULL), round(count(*) FILTER (WHERE reach IS NULL) / count(*)::DOUBLE, 6) FROM entity) WHERE missing > 0")
def null_profile(spark, sf_dir):
    return quality.missing(entities(spark, sf_dir), ["id", "name", "weight", "reach", "stance"]).withColumn("share", rnd(F.col("share")))


@query("dup_profile", "SELECT (count(*) - count(DISTINCT p_name))::BIGINT AS duplicates, (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1))::BIGINT AS repeated FROM part")
def dup_profile(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "part"), "p_name")


@query("pipeline_counts", cte("bout") + " SELECT (SELECT count(*) FROM orders)::BIGINT AS raw, count(*)::BIGINT AS joined, count(*) FILTER (WHERE winner IS NULL)::BIGINT AS dropped, count(winner)::BIGINT AS final FROM bout")
def pipeline_counts(spark, sf_dir):
    counted = bouts(spark, sf_dir).agg(F.count(F.lit(1)).alias("joined"), F.count_if(F.col("winner").isNull()).alias("dropped"), F.count("winner").alias("final"))
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("raw")).crossJoin(counted)


@query("value_distribution", cte("bout") + " SELECT method, count(*)::BIGINT AS n FROM bout GROUP BY 1")
def value_distribution(spark, sf_dir):
    return bouts(spark, sf_dir).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_entities", cte("bout", "elog") + " SELECT count(DISTINCT ent)::BIGINT AS entities, count(DISTINCT bout_id)::BIGINT AS bouts FROM elog")
def distinct_entities(spark, sf_dir):
    log = log_of(spark, sf_dir)
    # two plain distinct counts share no expansion of the rows
    return log.select("ent").distinct().agg(F.count(F.lit(1)).alias("entities")).crossJoin(log.select("bout_id").distinct().agg(F.count(F.lit(1)).alias("bouts")))


VALID = ", n AS (SELECT * FROM bout WHERE dt >= DATE '1998-01-01' UNION ALL SELECT * FROM bout WHERE bout_id % 97 = 0), o AS (SELECT * FROM bout WHERE dt < DATE '1998-06-01')"


@query("validate_append", cte("bout") + VALID + """ SELECT 'duplicate key' AS rule, (count(*) - count(DISTINCT bout_id))::BIGINT AS n FROM n UNION ALL SELECT 'already present', count(*) FROM n WHERE bout_id IN (SELECT bout_id FROM o)
 UNION ALL SELECT 'not after the last date', count(*) FROM n WHERE dt <= (SELECT max(dt) FROM o) UNION ALL SELECT 'winner is no side', count(*) FROM n WHERE winner <> e1 AND winner <> e2 UNION ALL SELECT 'missing field', count(*) FROM n WHERE dt IS NULL OR e1 IS NULL OR e2 IS NULL""")
def validate_append(spark, sf_dir):
    b = bouts(spark, sf_dir)
    return quality.violations(b.where("dt >= DATE '1998-01-01'").unionByName(b.where("bout_id % 97 = 0")), b.where("dt < DATE '1998-06-01'"))


@query("append_rows", "SELECT r_regionkey::BIGINT AS id, r_name AS name, NULL::DOUBLE AS weight FROM region UNION ALL SELECT p_partkey, p_name, p_size::DOUBLE FROM part")
def append_rows(spark, sf_dir):
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("weight"))
    new = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), "r_regionkey")
    return old.unionByName(files.build_rows(new, old.schema))


@query("bio_stubs", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT NULL, r_name FROM region")
def bio_stubs(spark, sf_dir):
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.regexp_replace("n_name", "_.*", "x").alias("name"), "n_name")
    known = known.select("id", F.col("n_name").alias("name"))
    return files.stubs(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), known)


def event_pages(spark, sf_dir):
    """A page for each month of the events, with a table of its days: number, event and day as text."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("dt"), F.col("event_type").alias("name")).distinct()
    cells = F.concat(F.lit("<tr><td>"), F.dayofmonth("dt"), F.lit("</td><td><a href='x'>"), F.col("name"), F.lit("</a></td><td>"), F.date_format("dt", "MMM d, yyyy"), F.lit("</td></tr><tr><td>no date</td></tr>"))
    rows = events.groupBy(F.trunc("dt", "month").alias("key")).agg(F.array_join(F.sort_array(F.collect_list(cells)), "").alias("rows"))
    return rows.select("key", F.concat(F.lit('<p>x</p><table class="wikitable sortable"><tr><th>#</th><th>Event</th><th>Date</th></tr>'), "rows", F.lit("</table>")).alias("html"))


@query("new_events", "SELECT DISTINCT ts::DATE AS dt, event_type AS name FROM events WHERE ts::DATE > DATE '2024-01-10' ORDER BY 1, 2 LIMIT 20")
def new_events(spark, sf_dir):
    """The first twenty events after a day, found in the tables of pages. The limit is the feature."""
    return files.new_events(files.table_cells(event_pages(spark, sf_dir), "key", "html"), "2024-01-10", 20)


@query("html_tables", """WITH s AS (SELECT s_nationkey AS key, s_name, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)
SELECT key, i::INTEGER AS row_no, 0::INTEGER AS cell_no, i::VARCHAR AS cell FROM s UNION ALL SELECT key, i, 1, s_name || ' & Co <x>' FROM s UNION ALL SELECT key, i, 2, CASE WHEN s_acctbal < 0 THEN 'owes' ELSE 'has' END FROM s
UNION ALL SELECT DISTINCT key, 0, 0, 'No.' FROM s UNION ALL SELECT DISTINCT key, 0, 1, 'Name of it' FROM s""")
def html_tables(spark, sf_dir):
    place = F.row_number().over(W.Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    rows = table(spark, sf_dir, "supplier").withColumn("i", place)
    row = F.concat(F.lit("\n<tr class='r'><td>"), "i", F.lit("</td><td><a href=\"/x\">"), "s_name", F.lit("</a> &amp;\n Co &lt;x&gt;</td><td><b>"), F.when(F.col("s_acctbal") < 0, "owes").otherwise("has"), F.lit("</b></td></tr>"))
    made = rows.groupBy(F.col("s_nationkey").alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    pages = made.select("key", F.concat(F.lit("<table><tr><td>other</td></tr></table><table class='x' id=y class=\"wikitable\"><tr><th>No.</th><th>Name <i>of</i> it</th></tr>"), F.array_join("rows", ""), F.lit("</table>")).alias("html"))
    return files.table_cells(pages, "key", "html").select("key", "row_no", "cell_no", "cell")


@query("html_cells", "WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS c, generate_subscripts(regexp_extract_all(html, '<li>(.*?)</li>', 1), 1) AS i FROM pages) SELECT page_id, (i - 1)::INTEGER AS cell_no, replace(replace(replace(regexp_replace(c, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS cell FROM r")
def html_cells(spark, sf_dir):
    cells = table(spark, sf_dir, "pages").select("page_id", F.posexplode(files.elements(F.col("html"), "li")).alias("cell_no", "c"))
    return cells.select("page_id", "cell_no", S.references(F.regexp_replace("c", "<[^>]+>", "")).alias("cell"))


@query("set_ops", "(SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size > 25) EXCEPT SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'")
def set_ops(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return lines.intersect(part.where("p_size > 25").select("p_partkey")).subtract(part.where("p_type = 'ECONOMY'").select("p_partkey"))
