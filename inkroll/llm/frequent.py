"""Problem 5: the most frequent items of a column, by mergeable Space-Saving summaries and an exact second pass."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkroll.sources.tables import table

#: Summaries merged by one task of the merge tree.
FAN_IN = 64
#: Counters kept per summary, as a multiple of 1 / share: errors stay below share / OVERSIZE of the total.
OVERSIZE = 8


class Summary:
    """A Space-Saving summary that takes weighted batches: lower bound and error per item."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.low, self.slack, self.floor, self.total = capacity, {}, {}, 0, 0

    def add(self, items: list[str], low: list[int], slack: list[int], floor: int, total: int) -> None:
        """Merge with another summary, or with exact counts (``slack`` and ``floor`` 0)."""
        mine = self.floor
        new = dict(zip(items, zip(low, slack, strict=True), strict=True))
        for x in self.low.keys() - new.keys():
            self.slack[x] += floor
        for x, (count, error) in new.items():
            if x in self.low:
                self.low[x] += count
                self.slack[x] += error
            else:
                self.low[x], self.slack[x] = count, error + mine
        self.floor += floor
        self.total += total
        if len(self.low) > self.capacity:
            order = sorted(self.low, key=lambda x: (-self.low[x] - self.slack[x], x))
            self.floor = max([self.floor, *(self.low[x] + self.slack[x] for x in order[self.capacity :])])
            self.low = {x: self.low[x] for x in order[: self.capacity]}
            self.slack = {x: self.slack[x] for x in self.low}


_SCHEMA = "node long, item string, low long, slack long, floor long, total long"


def _frame(node: int, s: Summary) -> pd.DataFrame:
    items = list(s.low) or [None]
    return pd.DataFrame({"node": node, "item": items, "low": [s.low.get(x, 0) for x in items], "slack": [s.slack.get(x, 0) for x in items], "floor": s.floor, "total": s.total})


def _weight(column: str) -> Column:
    return F.greatest(F.coalesce(F.col(column).cast("long"), F.lit(0)), F.lit(0))


def summaries(df: DataFrame, item: str, weight: str | None, capacity: int) -> DataFrame:
    """One summary per partition; memory is bounded by ``capacity`` and one Arrow batch, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity)
        for batch in batches:
            if weight:
                grouped = pa.Table.from_batches([batch]).group_by(item).aggregate([(weight, "sum")])
                items, counts = grouped[item].to_pylist(), [x or 0 for x in grouped[f"{weight}_sum"].to_pylist()]
            else:
                found = pc.value_counts(batch.column(0))
                items, counts = found.field(0).to_pylist(), found.field(1).to_pylist()
            pairs = [(x, c) for x, c in zip(items, counts, strict=True) if x is not None and c > 0]
            summary.add([x for x, _ in pairs], [c for _, c in pairs], [0] * len(pairs), 0, sum(c for c in counts if c > 0))
        yield pa.RecordBatch.from_pandas(_frame(TaskContext.get().partitionId(), summary), preserve_index=False)

    return df.select(item, *([_weight(weight).alias(weight)] if weight else [])).mapInArrow(run, _SCHEMA)


def merge_tree(parts: DataFrame, partitions: int, capacity: int) -> DataFrame:
    """Merge the summaries level by level, ``FAN_IN`` of them per task, so no task reads more than that many."""

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        summary = Summary(capacity)
        for _, one in frame.groupby("node"):
            floor, total = int(one["floor"].iloc[0]), int(one["total"].iloc[0])
            one = one[one["item"].notna()]
            summary.add(one["item"].tolist(), one["low"].tolist(), one["slack"].tolist(), floor, total)
        return _frame(int(key[0]), summary)

    for _ in range(max(1, math.ceil(math.log(max(2, partitions), FAN_IN)))):
        parts = parts.withColumn("_up", F.floor(F.col("node") / FAN_IN)).groupBy("_up").applyInPandas(merge, _SCHEMA)
    return parts


def candidates(df: DataFrame, item: str, share: float, weight: str | None = None) -> DataFrame:
    """All items that can reach ``share`` of the total: item, lower and upper bound of the count, total.

    At most ``OVERSIZE / share`` rows. No item that reaches the share can be missing: the summary of n items
    with k counters errs by at most n / k.
    """
    capacity = math.ceil(OVERSIZE / share)
    parts = df.rdd.getNumPartitions()
    top = merge_tree(summaries(df, item, weight, capacity), parts, capacity)
    return top.where(F.col("item").isNotNull() & (F.col("low") + F.col("slack") >= F.col("total") * share)).select("item", F.col("low").alias("at_least"), (F.col("low") + F.col("slack")).alias("at_most"), "total")


def frequent(df: DataFrame, item: str, share: float, weight: str | None = None) -> DataFrame:
    """Items that make up at least ``share`` of all rows (or of the sum of ``weight``), with exact counts.

    Strings are compared exactly; the total counts all rows, also those with a null item, which itself is
    never reported; null and non-positive weights count nothing; an empty table gives no rows. The second pass joins the rows with
    the candidates, at most ``OVERSIZE / share`` of them (1,600 at 0.5 %), a bound that does not depend
    on the data, hence the broadcast; the counts combine before the only shuffle.
    """
    found = candidates(df, item, share, weight)
    rows = df.select(F.col(item).alias("item"), (_weight(weight) if weight else F.lit(1)).alias("_w"))
    exact = rows.join(F.broadcast(found), "item").groupBy("item", "at_least", "at_most", "total").agg(F.sum("_w").cast("long").alias("frequency"))
    return exact.where(F.col("frequency") >= F.col("total") * share)


SHARE = 0.005


def _both(spark: SparkSession, folder: str) -> DataFrame:
    scored = frequent(table(spark, folder, "scored_candidates").select("candidate"), "candidate", SHARE)
    counts = frequent(table(spark, folder, "author_counts").select("author", "count"), "author", SHARE, "count")
    return scored.withColumn("field_name", F.lit("scored_candidates.candidate")).unionByName(counts.withColumn("field_name", F.lit("author_counts.author")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Names with at least 0.5 % of the rows or of the counts."""
    return _both(spark, folder).select("field_name", "item")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The same names with their frequency and the bounds the summaries gave."""
    return _both(spark, folder).select("field_name", "item", "frequency", F.expr("at_least <= frequency and frequency <= at_most").alias("within_bounds"))


_SQL = """
with a as (select 'scored_candidates.candidate' field_name, candidate item, count(*) frequency, (select count(*) from scored_candidates) total
           from scored_candidates where candidate is not null group by candidate
           union all
           select 'author_counts.author', author, cast(sum("count") as bigint), (select cast(sum("count") as bigint) from author_counts)
           from author_counts where author is not null group by author)
"""
QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
SQL = {
    "p5_found": _SQL + "select field_name, item from a where frequency >= 0.005 * total",
    "p5_counts": _SQL + "select field_name, item, frequency, true within_bounds from a where frequency >= 0.005 * total",
}
