"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkroll.plans import queries as core
from inkroll.plans import splitting, sql

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**core.QUERIES, **splitting.QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
