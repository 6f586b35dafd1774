"""The rule path on a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkroll.operators.candidates import explode_candidates
from inkroll.operators.rules import classify_by_rules
from inkroll.sources.records import parse_lines


def stream_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of JSON-lines files as they arrive in a folder; line numbers are not known on a stream."""
    return parse_lines(spark.readStream.text(folder).select(F.lit(None).cast("bigint").alias("line_no"), F.col("value").alias("line"))).drop("line_no")


def stream_decisions(records: DataFrame, nfkc: bool = True) -> DataFrame:
    """Candidates with their decision: stateless, append mode."""
    return classify_by_rules(explode_candidates(records, "authors", nfkc))


def stream_author_counts(decisions: DataFrame, window: str | None = None, time: str | None = None, late: str = "1 day") -> DataFrame:
    """Running counts of accepted authors (update mode), per event-time window with a watermark if ``window`` is given."""
    accepted = decisions.where(F.col("label") == "PERSON")
    if window:
        return accepted.withWatermark(time, late).groupBy(F.window(time, window), F.col("candidate").alias("author")).agg(F.count("*").alias("count"))
    return accepted.groupBy(F.col("candidate").alias("author")).agg(F.count("*").alias("count"))
