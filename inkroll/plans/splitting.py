"""Queries of the multi-value splitter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkroll.operators.multivalue import split_values
from inkroll.session import spread
from inkroll.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per name packed in ``raw_records.authors``."""
    rows = spread(table(spark, folder, "raw_records").select("line_no", "authors"))
    return split_values(rows, "authors").select("line_no", "position", "item")


def p4_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Values by error flag: how many quotes and brackets had to be read as plain characters."""
    rows = spread(table(spark, folder, "raw_records").select("line_no", "authors"))
    return split_values(rows, "authors").groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("values"))


QUERIES = {"p4_found": p4_found, "p4_errors": p4_errors}
