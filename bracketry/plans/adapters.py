"""The driver's tables seen as entities, bouts and an event log.

`entity` is `part`; a bout is an order's first two lines where parts and prices
differ. Missing values are injected by fixed rules, so gaps are exercised. SQL
holds the same views as common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from bracketry.session import table

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag"]

#: The class of each priority, by its first character.
CLASSES = {"1": "UFC Lightweight Title Bout", "2": "Women's Strawweight Bout", "3": "Catch Weight Bout", "4": "Light Heavyweight Bout", "5": "Bantamweight Bout"}


def _side(me: int, other: int) -> str:
    stats = ", ".join(f"{s}{me} AS own_{s}, {s}{other} AS opp_{s}" for s in STATS)
    return f"SELECT e{me} AS ent, e{other} AS opp, bout_id, dt, cls, (winner = e{me})::INTEGER AS won, method IN ({FINISH_SQL}) AS is_finish, secs, {stats} FROM bout WHERE winner IS NOT NULL"


#: Written out, not taken from the operator: the results that count as finishes.
FINISH_SQL = "'KO/TKO', 'Submission', 'TKO - Doctor''s Stoppage'"
STATS = ("q", "td", "sub", "ctrl")
SQL = {
    "entity": """entity AS (
  SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size::DOUBLE + 110 END AS weight,
         CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS reach, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (60 + p_partkey % 20)::DOUBLE END AS height, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand END AS stance,
         DATE '1960-01-01' + ((p_partkey * 37) % 12000)::INTEGER AS born
  FROM part)""",
    "bout": """line AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS rn FROM lineitem
), bout AS (
  SELECT o.o_orderkey AS bout_id, o.o_orderdate::DATE AS dt, CASE left(o.o_orderpriority, 1) {classes} END AS cls, a.l_partkey AS e1, b.l_partkey AS e2,
         nullif(a.l_quantity, 7) AS q1, nullif(b.l_quantity, 7) AS q2,
         nullif(round(a.l_discount * 100)::BIGINT, 9)::DOUBLE AS td1, nullif(round(b.l_discount * 100)::BIGINT, 9)::DOUBLE AS td2,
         nullif(round(a.l_tax * 100)::BIGINT % 4, 3)::DOUBLE AS sub1, nullif(round(b.l_tax * 100)::BIGINT % 4, 3)::DOUBLE AS sub2,
         4 * nullif(a.l_quantity, 11) AS ctrl1, 4 * nullif(b.l_quantity, 11) AS ctrl2,
         CASE WHEN o.o_orderkey % 17 = 0 THEN NULL WHEN a.l_extendedprice > b.l_extendedprice THEN a.l_partkey ELSE b.l_partkey END AS winner,
         CASE WHEN a.l_returnflag = 'R' THEN 'KO/TKO' WHEN a.l_returnflag = 'A' THEN 'Submission' WHEN o.o_orderkey % 5 = 0 THEN 'TKO - Doctor''s Stoppage' ELSE 'Decision - Unanimous' END AS method,
         1 + round(a.l_discount * 100)::INTEGER % 3 AS end_round,
         CASE WHEN round(a.l_tax * 100)::BIGINT = 4 THEN NULL ELSE 300.0::DOUBLE + 60 * round(a.l_tax * 100)::BIGINT END AS secs,
         CASE round(a.l_discount * 100)::BIGINT % 4 WHEN 0 THEN NULL WHEN 1 THEN '5 Rnd (5-5-5-5-5)' WHEN 2 THEN 'No Time Limit' ELSE '3 Rnd (5-5-5)' END AS layout
  FROM orders o JOIN line a ON a.l_orderkey = o.o_orderkey AND a.rn = 1 JOIN line b ON b.l_orderkey = o.o_orderkey AND b.rn = 2
  WHERE a.l_partkey <> b.l_partkey AND a.l_extendedprice <> b.l_extendedprice
)""",
    "elog": "elog AS (\n  {one}\n  UNION ALL\n  {two}\n)",
}

SQL["bout"] = SQL["bout"].replace("{classes}", " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in CLASSES.items()))
SQL["elog"] = SQL["elog"].replace("{one}", _side(1, 2)).replace("{two}", _side(2, 1))


def cte(*names: str) -> str:
    """A WITH clause of the named views and what they stand on."""
    wanted = [n for n in SQL if n in names or (n == "bout" and "elog" in names)]
    return "WITH " + ",\n".join(SQL[n] for n in wanted)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_name").alias("name"),
        F.when(key % 11 != 0, F.col("p_size").cast("double") + 110).alias("weight"),
        F.when(key % 7 != 0, F.col("p_retailprice")).alias("reach"),
        F.when(key % 17 != 0, (60 + key % 20).cast("double")).alias("height"),
        F.when(key % 13 == 0, "").otherwise(F.col("p_brand")).alias("stance"),
        F.date_add(F.lit("1960-01-01").cast("date"), ((key * 37) % 12000).cast("int")).alias("born"),
    )


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shuffle by order key brings a bout's two lines together."""
    place = F.row_number().over(W.Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER).withColumn("rn", place).where("rn <= 2")
    side = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c)))
    two = lines.groupBy("l_orderkey").agg(
        *[side(n, c).alias(f"{name}{n}") for n in (1, 2) for name, c in (("e", "l_partkey"), ("q", "l_quantity"), ("x", "l_extendedprice"), ("tax", "l_tax"), ("disc", "l_discount"))],
        side(1, "l_returnflag").alias("flag"),
    )
    two = two.where("e1 != e2 AND x1 != x2")
    hundredths = lambda c: F.round(F.col(c) * 100).cast("long")
    tax, disc = hundredths("tax1"), hundredths("disc1")
    priority = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    stats = [c for n in (1, 2) for c in (F.nullif(F.col(f"q{n}"), F.lit(7.0)).alias(f"q{n}"), F.nullif(hundredths(f"disc{n}"), F.lit(9)).cast("double").alias(f"td{n}"), F.nullif(hundredths(f"tax{n}") % 4, F.lit(3)).cast("double").alias(f"sub{n}"), (4 * F.nullif(F.col(f"q{n}"), F.lit(11.0))).alias(f"ctrl{n}"))]
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_orderdate", "o_orderpriority")
        .join(two, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.col("o_orderkey").alias("bout_id"),
            F.to_date("o_orderdate").alias("dt"),
            F.try_element_at(priority, F.substring("o_orderpriority", 1, 1)).alias("cls"),
            "e1", "e2", *stats,
            F.when(F.col("o_orderkey") % 17 == 0, None).when(F.col("x1") > F.col("x2"), F.col("e1")).otherwise(F.col("e2")).alias("winner"),
            F.when(F.col("flag") == "R", "KO/TKO").when(F.col("flag") == "A", "Submission").when(F.col("o_orderkey") % 5 == 0, "TKO - Doctor's Stoppage").otherwise("Decision - Unanimous").alias("method"),
            (1 + disc % 3).cast("int").alias("end_round"),
            F.when(tax != 4, 300.0 + 60 * tax).alias("secs"),
            F.when(disc % 4 == 0, None).when(disc % 4 == 1, "5 Rnd (5-5-5-5-5)").when(disc % 4 == 2, "No Time Limit").otherwise("3 Rnd (5-5-5)").alias("layout"),
        )
    )
