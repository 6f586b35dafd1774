"""Readers of raw records (JSON lines) and labelled tables (CSV)."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkroll.session import materialise

# CSV fields read as missing, quoted or not.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


_FIELDS = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("id", T.StringType()), T.StructField("authors", T.StringType())])


@F.pandas_udf(_FIELDS)
def _strict(lines: pd.Series) -> pd.DataFrame:
    """Strict JSON: whether a line is an object, and its two fields."""

    def one(line: str | None) -> tuple[bool, str | None, str | None]:
        try:
            got = json.loads(line or "")
        except ValueError:
            return False, None, None
        if not isinstance(got, dict):
            return False, None, None
        return True, *(x if isinstance(x, str) else None for x in (got.get("id", ""), got.get("authors", "")))

    out = pd.DataFrame({"valid": False, "id": None, "authors": None}, index=lines.index, dtype=object)
    for k in lines.index[lines.notna()]:  # next to none: the others were read inside the JVM and come as nulls
        out.loc[k] = one(lines[k])
    return out.astype({"valid": bool})


#: Splits of which the starts are broadcast, 16 bytes each; the starts of more splits are joined by a shuffle.
MOST_SPLITS = 1_000_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` (0-based, over the files in order of name, each in order of its splits) and ``line``; two passes.

    Each split (a file and an offset) is counted, the starts are running sums over one row per split, and every line
    adds its place within the split. Where a task reads splits of several files, each is counted for itself.
    The lines are not shuffled; blank lines count.
    """
    split = ["file_path", "file_block_start"]
    text = spark.read.text(path).select("value", *[f"_metadata.{x}" for x in split]).withColumn("_id", F.monotonically_increasing_id())
    sizes = text.groupBy(*split).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1))  # one row per split
    starts = sizes.select(F.xxhash64(*split).alias("_split"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    starts = materialise(starts)
    small = starts.count() <= MOST_SPLITS
    lines = text.select(F.xxhash64(*split).alias("_split"), "_id", F.col("value").alias("line"))
    return lines.join(F.broadcast(starts) if small else starts, "_split").select((F.col("_shift") + F.col("_id")).alias("line_no"), "line")


# Fixed value: the key of an element that is put behind every line; it tells whether the line was one value and read to its end.
_END = "~end of line~"


def parse_lines(lines: DataFrame) -> DataFrame:
    """``line_no, id, authors`` of the lines that are JSON objects; blank and malformed lines are skipped.

    A missing key gives an empty string; values of other types give null. Lines are parsed inside the JVM as the first of two elements
    of an array, as its parser by itself accepts text behind an object. Lines it rejects, and the few that it may
    read otherwise than the standard says (escaped surrogates, a repeated key), go to a strict parser in Python.
    """
    body = F.trim(F.col("line"))
    element = f"struct<id:variant,authors:variant,`{_END}`:int>"
    wrapped = F.concat(F.lit("["), body, F.lit(f',{{"{_END}":1}}]'))
    read = lines.where(body != "").withColumn("_a", F.from_json(wrapped, f"array<{element}>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}))
    plain = (F.size("_a") == 2) & (F.col("_a")[1][_END] == 1) & F.col("_a")[0].isNotNull()
    odd = body.rlike(r'\\u[dD][89a-fA-F]') | F.contains(body, F.lit(_END)) | (F.regexp_count(body, F.lit(r'"id"\s*:')) > 1) | (F.regexp_count(body, F.lit(r'"authors"\s*:')) > 1)
    read = read.withColumn("_sure", F.coalesce(plain & ~odd, F.lit(False)))

    def field(name: str) -> Column:
        value = F.col("_a")[0][name]
        return F.when(value.isNull(), F.lit("")).when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))

    # One pass: the rows that are sure travel with an empty text.
    read = read.withColumn("_r", _strict(F.when(~F.col("_sure"), body))).where("_sure or _r.valid")
    return read.select("line_no", *[F.when(F.col("_sure"), field(x)).otherwise(F.col(f"_r.{x}")).alias(x) for x in ("id", "authors")])


def records(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """Valid records among the first ``max_lines`` physical lines (blank and malformed ones count)."""
    lines = read_lines(spark, path)
    return parse_lines(lines if max_lines is None else lines.where(F.col("line_no") < max_lines))


def record_slice(spark: SparkSession, path: str, start_line: int = 0, max_records: int | None = None) -> DataFrame:
    """The first ``max_records`` valid records from physical line ``start_line`` on."""
    valid = parse_lines(read_lines(spark, path).where(F.col("line_no") >= start_line))
    return valid if max_records is None else valid.orderBy("line_no").limit(max_records)


def _missing(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, missing-value tokens as nulls."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', enforceSchema=False)
    return raw.select(*[_missing(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_csv_if_exists(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The table, or None (with a note) if there is no path or no file."""
    if not path:
        return None
    if "://" not in path and not os.path.exists(path):
        print(f"Not found: {path}")
        return None
    return read_csv(spark, path)


def labelled_for_training(df: DataFrame) -> DataFrame:
    """Rows with a candidate and an integer label; an error if a column is missing."""
    lost = {"candidate", "label"} - set(df.columns)
    if lost:
        raise ValueError(f"missing columns: {sorted(lost)}")
    label = F.col("label").cast("string").try_cast("double").cast("int")
    return df.withColumn("label", label).where("candidate is not null and label is not null")


def labelled_for_evaluation(df: DataFrame) -> DataFrame:
    """As for training, labels 0 and 1 only; an error if no rows or only one class are left."""
    some = labelled_for_training(df).where("label in (0, 1)")
    classes = some.agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).first()
    if not classes.n:
        raise ValueError("no labelled rows")
    if classes.k < 2:
        raise ValueError("both classes are needed")
    return some
