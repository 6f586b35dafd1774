"""Writers of result tables. A header is always written, also for empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# White space at the ends of a value is part of it; quotes are doubled; nulls and empty texts are empty fields.
_CSV = {"header": True, "emptyValue": "", "nullValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with header; ``single`` for small tables that one reader wants as one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, **_CSV)


def write_author_counts(counts: DataFrame, path: str, single: bool = False) -> None:
    write_csv(counts.select("author", "count"), path, single)


# The columns of the table of uncertain occurrences.
UNCERTAIN_COLUMNS = ("arxiv_id", "candidate", "position", "ner_label", "score", "reason")


def write_uncertain(decided: DataFrame, path: str, single: bool = False) -> None:
    """Uncertain occurrences in order of arrival."""
    rows = decided.where(F.col("label") == "UNCERTAIN").orderBy("line_no", "position")
    write_csv(rows.select(*[c for c in UNCERTAIN_COLUMNS if c in decided.columns]), path, single)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """One folder per value of ``by`` (the tag if none are named) in a single job."""
    df.write.mode("overwrite").partitionBy(*(by or ("tag",))).csv(path, **_CSV)


def write_scored(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").parquet(path) if form == "parquet" else write_csv(df, path)
