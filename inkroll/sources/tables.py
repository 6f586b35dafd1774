"""Readers of the engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as stored; columns are pruned and filters pushed down by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
