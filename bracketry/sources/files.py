"""CSV and HTML sources, row building and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bracketry.functions import scalars as S
from bracketry.operators import resolve

# Tokens of a CSV that mean missing.
MISSING = ("", "NA", "N/A", "NULL", "None", "nan", "NaN", "null", "n/a", "<NA>", "#N/A", "-nan", "-NaN")
PERCENTS = ("Str_Acc", "Str_Def", "TD_Acc", "TD_Def")


def read_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Every column as text; a line starting with # is a comment. With columns, only those, in that order; absent ones are missing."""
    raw = spark.read.option("header", True).option("comment", "#").option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.select(*[F.when(F.col(f"`{c}`").isin(*MISSING), None).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if columns is None:
        return raw
    return raw.select(*[F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns])


def available(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """Which of the wanted columns are there, and which are missing."""
    return [c for c in wanted if c in df.columns], [c for c in wanted if c not in df.columns]


def read_bouts(spark: SparkSession, path: str, numeric: tuple[str, ...] = ("Total_Fight_Time_Sec",)) -> DataFrame:
    raw = read_strings(spark, path)
    out = raw.withColumn("Event_Date", S.parse_day(F.col("Event_Date")))
    return out.withColumns({c: F.nanvl(F.col(c).try_cast("double"), F.lit(None)) for c in raw.columns if c in numeric or c.startswith(("F1_", "F2_"))})


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    raw = read_strings(spark, path)
    out = raw.withColumns({"Height_in": S.height_inches(F.col("Height")), "Reach_in": S.leading_number(F.col("Reach")), "Weight_lbs": S.leading_number(F.col("Weight")), "DOB": S.parse_day(F.col("DOB"))})
    return out.withColumns({c: S.percent(F.col(c)) for c in PERCENTS if c in raw.columns})


def build_rows(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows as a table of the schema: absent columns missing, others dropped."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def stubs(names: DataFrame, known: DataFrame) -> DataFrame:
    """Known profiles and, for unknown names, profiles without biometrics."""
    new = resolve.unknown(names.distinct(), known).groupBy("key").agg(F.min("name").alias("name")).drop("key")
    return known.unionByName(new, allowMissingColumns=True)


def load_joined(spark: SparkSession, bouts_path: str, entities_path: str) -> DataFrame:
    """Both files, joined by name on either side; rows repeat where names do."""
    entities = read_entities(spark, entities_path).withColumnRenamed("Fighter_Name", "name")
    return resolve.join_by_name(read_bouts(spark, bouts_path), entities, {"Fighter_1": "F1_bio_", "Fighter_2": "F2_bio_"})


def check_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """df, if it has the wanted columns and no others; else an error that names both kinds."""
    if set(df.columns) != set(wanted):
        raise ValueError(f"missing columns: {sorted(set(wanted) - set(df.columns))}; unexpected: {sorted(set(df.columns) - set(wanted))}")
    return df


def elements(html: Column, tag: str, inner: bool = True) -> Column:
    """The contents of all elements of a tag that don't nest."""
    return F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1 if inner else 0))


def table_cells(pages: DataFrame, key: str, html: str, kind: str = "wikitable") -> DataFrame:
    """(key, table_no, row_no, cell_no, cell): the cells of all tables of a class, as text."""
    tables = F.regexp_extract_all(F.col(html), F.lit(rf'(?s)<table[^>]*class="[^"]*{kind}[^"]*"[^>]*>.*?</table>'), F.lit(0))
    rows = pages.select(key, F.posexplode(tables).alias("table_no", "t")).select(key, "table_no", F.posexplode(elements(F.col("t"), "tr")).alias("row_no", "r"))
    cells = rows.select(key, "table_no", "row_no", F.posexplode(F.regexp_extract_all("r", F.lit("(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("cell_no", "c"))
    return cells.withColumn("cell", S.strip_tags(F.col("c"))).drop("c")


def new_events(cells: DataFrame, after: str, limit: int | None = None) -> DataFrame:
    """(dt, name): events of rows of three cells or more dated after a day, in order, each once. A row is told by its page, table and number."""
    rows = cells.groupBy(*[c for c in cells.columns if c not in ("cell_no", "cell")]).agg(F.max(F.when(F.col("cell_no") == 1, F.col("cell"))).alias("name"), F.max(F.when(F.col("cell_no") == 2, F.col("cell"))).alias("raw"))
    found = rows.select(S.parse_day(F.col("raw")).alias("dt"), "name").where((F.col("dt") > F.lit(after).cast("date")) & (F.col("name") != "")).distinct().orderBy("dt", "name")
    return found.limit(limit) if limit else found


def write_csv(rows: DataFrame, path: str, header: list[str], order: list[str]) -> None:
    """Sorted CSV parts under path, and the comment lines in a part of their own that sorts first."""
    rows.orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)
    if header:
        rows.sparkSession.createDataFrame([(f"# {x}",) for x in header], "line string").coalesce(1).write.mode("append").text(path)
