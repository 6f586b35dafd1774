"""Problem 8: mixing sources to target shares of all tokens, as a time-varying curriculum.

Source s has a weight schedule w_s(t) over training time t in [0, 1], straight between knots, whose integral is its
target share. Integrated, it gives the tokens source s must have delivered by time t. The texts of a source
are laid end to end in hashed order, again and again; inverted, the integral gives the time at which the middle of each of them
is due. A text is used as often as that time comes before the end, and sorting by it gives the training order.

The total is the largest one that all shares allow without using a text more often than its source permits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkroll.llm.tokens import VOCABULARY, with_copies, with_tokens
from inkroll.session import materialise, spread
from inkroll.sources.tables import table

#: Texts per bucket, about: running sums are taken within a bucket and over the sums of buckets, so no task reads a whole source.
BUCKET = 64
#: Buckets per source, at most; beyond that they hold more texts.
BUCKETS = 1 << 20
#: How much the weight of the source with the most repeats rises from the start to the end, relative to its mean, at most 1.
RAMP = 0.5


def plan_mix(totals: dict[str, int], targets: list[tuple[str, float, int]], ramp: float = RAMP, schedules: dict[str, list[float]] | None = None) -> list[dict]:
    """Demand, passes and the knots of the schedule per listed source.

    Sources without tokens, target or permitted repeats get no demand, and the others their shares in
    proportion; the same holds for repeated listings, of which the first counts. ``schedules`` gives weights of a source
    at two or more evenly spaced times, in any unit; by default the weights rise or fall evenly such that, weighted by the
    shares, they add up to the same at any time.
    """
    listed: dict[str, dict] = {}
    for source, share, repeats in targets:
        if source is not None and source not in listed:
            listed[source] = {"source": source, "target_share": float(share or 0), "max_repeats": int(1 if repeats is None else repeats), "available": int(totals.get(source, 0))}
    able = [x for x in listed.values() if x["target_share"] > 0 and x["max_repeats"] > 0 and x["available"] > 0]
    whole = sum(x["target_share"] for x in able)
    total = min((x["max_repeats"] * x["available"] * whole / x["target_share"] for x in able), default=0.0)
    mean = sum(x["max_repeats"] * x["target_share"] for x in able) / whole if able else 0.0
    reach = max((abs(x["max_repeats"] - mean) for x in able), default=0.0)
    for x in listed.values():
        on = x in able
        x["share"] = x["target_share"] / whole if on else 0.0
        x["demand"] = x["share"] * total
        slope = ramp * (x["max_repeats"] - mean) / reach if on and reach > 0 else 0.0
        knots = [float(w) for w in (schedules or {}).get(x["source"], [1 - slope, 1 + slope])]
        if len(knots) < 2 or min(knots) < 0 or max(knots) <= 0:
            raise ValueError(f"a schedule needs two or more weights, none negative and one positive: {x['source']}")
        steps = [(a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)]
        x["knots"] = [w / sum(steps) for w in knots]  # the integral over steps of length 1 is 1
        x["integral"] = [0.0, *np.cumsum([w / sum(steps) for w in steps])[:-1].tolist(), 1.0]
        x["passes"] = min(int(x["demand"] / x["available"] + 1e-9), x["max_repeats"]) if on else 0
        x["rest"] = max(0.0, x["demand"] - x["passes"] * x["available"]) if on and x["passes"] < x["max_repeats"] else 0.0
        x["total"] = total
    return list(listed.values())


def due(fraction: Column, knots: Column, integral: Column) -> Column:
    """The time at which a source has delivered this fraction: the inverse of the integral of its schedule."""
    steps = F.array_size(knots) - 1
    k = F.least(F.array_size(F.filter(integral, lambda x: x <= fraction)), steps)  # the step, from 1 on
    a, slope = F.element_at(knots, k), F.element_at(knots, k + 1) - F.element_at(knots, k)
    left = fraction - F.element_at(integral, k)
    inside = F.when(F.abs(slope) < 1e-12, left / a).otherwise((F.sqrt(F.greatest(a * a + 2 * slope * left, F.lit(0.0))) - a) / slope)
    return (k - 1 + F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0))) / steps


def _fill(gap: float, tokens: np.ndarray) -> np.ndarray:
    """An order of texts in which one ends as near to ``gap`` as largest-first allows: those that fit, then the others, the smallest first."""
    taken, left = [], gap
    order = np.argsort(-tokens, kind="stable")
    for k in order:
        if tokens[k] <= left:
            taken.append(k)
            left -= tokens[k]
    kept = set(taken)
    return np.array([*taken, *(k for k in order[::-1] if k not in kept)], np.int64)


def mix(sized: DataFrame, key: str, source: str, tokens: str, targets: DataFrame, schedules: dict[str, list[float]] | None = None) -> DataFrame:
    """How often every text is used: ``<key>, source, tokens, uses`` and what `schedule` needs.

    ``targets`` is the small configuration table (source, target_share, max_repeats); ``schedules`` as in `plan_mix`. Texts of sources
    that are not listed, or without a source, are used 0 times; a text without tokens is used when its place is due. Repeated rows
    are texts of their own. In the one bucket of a source in which its demand ends, texts are laid such that one ends as near to
    the demand as can be: the order within a bucket is free. So a source misses its share by less than half of its smallest
    texts, whatever their sizes. What reaches the driver is one row per listed source.
    """
    docs = with_copies(sized.select(F.col(key).alias("_id"), F.col(source).alias("source"), F.col(tokens).cast("long").alias("tokens")), "_id")
    wanted = [(r[0], r[1], r[2]) for r in targets.select("source", "target_share", "max_repeats").collect()]
    names = [w[0] for w in wanted if w[0] is not None]
    placed = materialise(docs.withColumn("_h", F.xxhash64(F.lit(8), F.col("_id"), F.col("_copy"))).drop("_copy"))
    sums = {r["source"]: r for r in placed.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("texts")).collect()}
    plan = plan_mix({k: r["n"] or 0 for k, r in sums.items()}, wanted, schedules=schedules)
    spark = sized.sparkSession
    plans = spark.createDataFrame(
        [(x["source"], max(1, min(BUCKETS, sums[x["source"]]["texts"] // BUCKET)) if x["source"] in sums else 1, x["rest"], float(x["available"]), x["demand"], x["knots"], x["integral"], x["max_repeats"], x["total"]) for x in plan],
        "source string, _buckets int, _rest double, _available double, _demand double, _knots array<double>, _integral array<double>, _most int, _total double",
    )
    known = placed.join(F.broadcast(plans.select("source", "_buckets", "_rest")), "source").withColumn("_b", F.pmod("_h", "_buckets").cast("int"))  # as many rows as the configuration lists
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = known.groupBy("source", "_b").agg(F.sum("tokens").alias("_t")).select("source", "_b", "_t", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_from"))
    lined = known.join(starts, ["source", "_b"])
    ends = (F.col("_rest") > F.col("_from")) & (F.col("_rest") < F.col("_from") + F.col("_t"))
    columns = ["_id", "source", "tokens", "_at"]
    inside = Window.partitionBy("source", "_b").orderBy("_h", "_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    whole = lined.where(~ends).withColumn("_at", F.col("_from") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).select(*columns)

    def lay(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_h", "_id", "tokens"], kind="stable")
        start = int(frame["_from"].iloc[0])
        frame = frame.iloc[_fill(float(frame["_rest"].iloc[0]) - start, frame["tokens"].to_numpy())]
        return frame.assign(_at=start + frame["tokens"].cumsum() - frame["tokens"])[columns]

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    last = lined.where(ends).select("_id", "source", "tokens", "_h", "_from", "_rest").groupBy("source").applyInPandas(lay, f"_id {kinds['_id']}, source string, tokens bigint, _at bigint")  # one bucket per source
    laid = materialise(whole.unionByName(last)).join(F.broadcast(plans.drop("_buckets", "_rest")), "source")
    middle = F.col("_at") + F.col("tokens") / 2
    due_before_end = F.when(middle <= F.col("_demand"), F.floor((F.col("_demand") - middle) / F.col("_available") + F.lit(1e-12)) + 1).otherwise(0)
    uses = F.when((F.col("_demand") > 0) & F.col("tokens").isNotNull(), F.least(due_before_end.cast("int"), F.col("_most"))).otherwise(0)
    extra = {"_at": "bigint", "_available": "double", "_demand": "double", "_knots": "array<double>", "_integral": "array<double>", "_total": "double"}
    used = laid.select(F.col("_id").alias(key), "source", "tokens", uses.alias("uses"), *extra)
    idle = placed.where(F.col("source").isNull() | ~F.col("source").isin(names))
    return used.unionByName(idle.select(F.col("_id").alias(key), "source", "tokens", F.lit(0).alias("uses"), *[F.lit(None).cast(t).alias(c) for c, t in extra.items()]))


def schedule(mixed: DataFrame, key: str) -> DataFrame:
    """One row per use of a text in training order: ``<key>, source, use, tokens, position`` (in tokens), range-sorted."""
    uses = mixed.where("uses > 0").withColumn("use", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    fraction = F.least((F.col("use") * F.col("_available") + F.col("_at") + F.col("tokens") / 2) / F.col("_demand"), F.lit(1.0))
    position = F.floor(due(fraction, F.col("_knots"), F.col("_integral")) * F.col("_total")).cast("long")
    return uses.select(key, "source", "use", "tokens", position.alias("position")).orderBy("position", key, "use")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and real share of every source, listed or not."""
    used = mixed.groupBy("source").agg(F.count("*").alias("texts"), F.sum("tokens").alias("available"), F.sum(F.col("tokens") * F.col("uses")).alias("used"), F.max("uses").alias("most_uses"))
    total = Window.partitionBy(F.lit(0))  # one row per source
    listed = targets.select("source", "target_share", "max_repeats")
    both = used.join(listed, used["source"].eqNullSafe(listed["source"]), "full").select(
        F.coalesce(used["source"], listed["source"]).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("texts", "available", "used", "most_uses")],
    )
    return both.withColumn("real_share", F.coalesce(F.col("used") / F.sum("used").over(total), F.lit(0.0)))


def _mixed(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "text"))
    sized = materialise(with_tokens(docs, "text", vocabulary=vocabulary))
    targets = table(spark, folder, "source_targets")
    return mix(sized, "doc_id", "source", "tokens", targets), targets


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often every text is used."""
    return _mixed(spark, folder)[0].select("doc_id", "source", "tokens", "uses")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share every source reaches."""
    return shares(*_mixed(spark, folder))


def p8_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """All uses in training order."""
    return schedule(_mixed(spark, folder)[0], "doc_id")


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_schedule": p8_schedule}
