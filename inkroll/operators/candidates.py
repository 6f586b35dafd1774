"""From raw fields to candidate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkroll.functions.text import split_candidates


def explode_candidates(df: DataFrame, authors: str = "authors", nfkc: bool = True) -> DataFrame:
    """One row per candidate with its 0-based ``position``; all other columns are kept.

    Null and empty fields, and fields of separators only, give no rows. ``nfkc`` off leaves characters as they are.
    """
    keep = [c for c in df.columns if c not in (authors, "position", "candidate")]
    filled = df.where(F.col(authors).isNotNull() & (F.col(authors) != ""))
    return filled.select(*keep, F.posexplode(split_candidates(F.col(authors), nfkc)).alias("position", "candidate"))
