"""Problem 3: records that differ only in the format of a name, by progressive partition refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkroll.session import materialise
from inkroll.sources.tables import table


def _fold(name: Column) -> Column:
    return F.lower(F.upper(name))


def letters(name: Column) -> Column:
    """Letters and digits only, case folded."""
    return F.regexp_replace(_fold(name), "[^\\p{L}\\p{N}]", "")


#: Letters counted by the first, cheap key.
COUNTED = "aeinorl"


def _cheap(name: Column) -> list[Column]:
    """Invariants of the format: stripped length and the counts of a few letters."""
    text = letters(name)
    return [F.length(text), *(F.length(F.translate(text, c, "")) for c in COUNTED)]


def word_key(name: Column) -> Column:
    """The words in sorted order, as often each, case folded; a name without words is its own key."""
    words = F.array_sort(F.filter(F.split(_fold(name), "[^\\p{L}\\p{N}]+"), lambda x: x != ""))
    return F.when(F.size(words) > 0, F.concat_ws(" ", words)).otherwise(F.concat(F.lit("\u0000"), name))


def copy_classes(df: DataFrame, row_id: str, keys: list[str], name: str) -> DataFrame:
    """Every row that belongs to a record with copies: ``keys``, ``name``, ``row_id`` and ``first_id``.

    A record is a set of rows equal in all ``keys`` whose names have the same words; ``first_id`` is its
    smallest ``row_id``. Null keys are equal to each other; rows with a null name are no records.

    Refinement: (1) rows are counted by a hash of the keys and cheap invariants of the name, its stripped
    length and how often a few letters occur, combined before the shuffle, and the rows of singleton classes
    leave; (2) exact repeats are aggregated to one row each, again with map-side combining, so a record that
    holds a third of all rows becomes a few rows; (3) classes are split by their full letter histogram; (4)
    only classes that still have several spellings get the sorted-word key. The windows run over distinct
    spellings of one record, never over its rows; the last join's large side can be split by adaptive execution.
    """
    plain = {k: f"_k{i}" for i, k in enumerate(keys)}
    rows = df.where(F.col(name).isNotNull()).select(
        F.col(row_id).alias("_id"), F.col(name).alias("_name"), *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(c) for k, c in plain.items()]
    )
    by = list(plain.values())
    rows = rows.withColumn("_h", F.xxhash64(*by, *_cheap(F.col("_name"))))
    several = rows.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
    rows = materialise(rows.join(several, "_h", "left_semi").drop("_h"))  # a few per cent of the rows, read twice below
    names = rows.groupBy(*by, "_name").agg(F.min("_id").alias("_mid"), F.count("*").alias("_n"))
    names = names.withColumn("_hist", F.xxhash64(F.array_sort(F.split(letters(F.col("_name")), ""))))
    group = Window.partitionBy(*by, "_hist")
    names = names.withColumn("_names", F.count("*").over(group)).withColumn("_rows", F.sum("_n").over(group)).where("_rows > 1")
    names = names.withColumn("_key", F.when(F.col("_names") > 1, word_key(F.col("_name"))).otherwise(""))
    record = Window.partitionBy(*by, "_hist", "_key")
    classes = names.withColumn("first_id", F.min("_mid").over(record)).withColumn("_rows", F.sum("_n").over(record)).where("_rows > 1")
    classes = classes.select(*by, "_name", "first_id")
    return rows.join(classes, [*by, "_name"]).select(F.col("_id").alias(row_id), F.col("_name").alias(name), "first_id", *by)


def collapse(df: DataFrame, row_id: str, keys: list[str], name: str) -> DataFrame:
    """One row per record that has copies: ``first_id`` and how many rows it had."""
    return copy_classes(df, row_id, keys, name).groupBy("first_id").agg(F.count("*").alias("copies"))


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    scored = table(spark, folder, "scored_candidates").where("arxiv_id is not null and arxiv_id <> ''")
    counts = table(spark, folder, "author_counts")
    return scored.select(
        F.lit("scored_candidates").alias("table_name"), F.col("cand_id").alias("id"), F.col("arxiv_id").alias("part"), F.col("position").cast("long").alias("number"), F.col("candidate").alias("name")
    ).unionByName(counts.select(F.lit("author_counts").alias("table_name"), F.col("author_id").alias("id"), F.col("batch").alias("part"), F.col("count").alias("number"), F.col("author").alias("name")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of a record with the id of its first row."""
    found = copy_classes(_sources(spark, folder), "id", ["table_name", "part", "number"], "name")
    return found.where("id <> first_id").select(F.col("_k0").alias("table_name"), "first_id", F.col("id").alias("copy_id"))


def p3_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Records with copies and the number of their rows."""
    found = copy_classes(_sources(spark, folder), "id", ["table_name", "part", "number"], "name")
    return found.groupBy(F.col("_k0").alias("table_name"), "first_id").agg(F.count("*").alias("copies"))


_ROWS = """
with rows as (
  select 'scored_candidates' table_name, cand_id id, arxiv_id part, cast(position as bigint) number, candidate name
  from scored_candidates where arxiv_id is not null and arxiv_id <> '' and candidate is not null
  union all
  select 'author_counts', author_id, batch, "count", author from author_counts where author is not null),
keyed as (
  select *, case when regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g') = '' then name
    else array_to_string(list_sort(list_filter(regexp_split_to_array(lower(upper(name)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')), ' ') end k
  from rows),
firsts as (select *, min(id) over (partition by table_name, part, number, k) first_id, count(*) over (partition by table_name, part, number, k) copies from keyed)
"""

QUERIES = {"p3_found": p3_found, "p3_collapsed": p3_collapsed}
SQL = {
    "p3_found": _ROWS + "select table_name, first_id, id copy_id from firsts where id <> first_id",
    "p3_collapsed": _ROWS + "select distinct table_name, first_id, copies from firsts where copies > 1",
}
