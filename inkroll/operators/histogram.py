"""Equal-width histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkroll.session import materialise


#: Groups of which the ranges are broadcast, a few dozen bytes each; those of more are joined by a shuffle.
MOST_GROUPS = 100_000


def equal_width(df: DataFrame, column: str, bins: int, groups: list[str] | None = None) -> DataFrame:
    """Counts in ``bins`` equal bins from the least to the largest value of each group, empty bins included.

    Bins are closed on the left, the last one on both sides; a single value gets a range one wide around it.
    Nulls are left out; an empty table gives no bins. Returns the groups, ``bin``, ``bin_left``, ``bin_right``, ``count``.
    Two aggregates combine before their shuffles; what is joined is one row per group, broadcast if there are at most `MOST_GROUPS`.
    """
    groups = groups or []
    x = F.col(column).cast("double")
    some = df.where(x.isNotNull()).select(*groups, x.alias("_x"))
    ranges = some.groupBy(*groups).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where("_lo is not null")
    flat = F.col("_lo") == F.col("_hi")
    ranges = ranges.select(*groups, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    if groups:
        ranges = materialise(ranges)
        joined = some.join(F.broadcast(ranges) if ranges.count() <= MOST_GROUPS else ranges, groups)
    else:
        joined = some.join(F.broadcast(ranges))  # one row
    k = F.least(F.floor((F.col("_x") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1)).cast("int")
    counted = joined.groupBy(*groups, k.alias("bin")).agg(F.count("*").alias("count"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    frame = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(counted, [*groups, "bin"], "left").select(
        *groups, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_left"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_right"), F.coalesce("count", F.lit(0)).alias("count")
    )
