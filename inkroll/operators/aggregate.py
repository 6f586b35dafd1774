"""Counts, rankings and summaries of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkroll.operators.rules import PERSON, UNCERTAIN


def first_seen(line: str = "line_no", position: str = "position") -> Column:
    """Order of first appearance within a group, as a struct that sorts by line and position."""
    return F.min(F.struct(F.col(line), F.col(position)))


def frequency(df: DataFrame, value: str, name: str = "count") -> DataFrame:
    """Rows per value; null values are no group."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias(name))


def author_counts(decided: DataFrame, by_appearance: bool = True) -> DataFrame:
    """``author, count`` of accepted candidates, most frequent first, ties by first appearance."""
    accepted = decided.where((F.col("label") == PERSON) & F.col("candidate").isNotNull())
    counted = accepted.groupBy(F.col("candidate").alias("author")).agg(F.count("*").alias("count"), *([first_seen().alias("_first")] if by_appearance else []))
    return counted.orderBy(F.desc("count"), *([F.asc("_first")] if by_appearance else []), F.asc("author")).select("author", "count")


def decision_counts(decided: DataFrame, label: str = "label") -> DataFrame:
    return decided.groupBy(label).agg(F.count("*").alias("count"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order; a heap per task, no full sort."""
    return df.orderBy(*order).limit(n)


def mode(column: str, empty: str | None = "") -> Column:
    """The most frequent non-null value, ties to the smallest; ``empty`` if all are null."""
    value = F.mode(F.col(column), True)
    return value if empty is None else F.coalesce(value, F.lit(empty))


def labelling_sheet(scored: DataFrame, n: int = 5000) -> DataFrame:
    """Candidates to label by hand: frequency, usual rule decision, blank label; uncertain ones weigh three times."""
    grouped = scored.where(F.col("candidate").isNotNull()).groupBy("candidate").agg(F.count("*").alias("frequency"), mode("rule_label").alias("rule_label"), F.avg("rule_score").alias("rule_score"), mode("rule_reason").alias("rule_reason"))
    weight = F.col("frequency") * F.when(F.col("rule_label") == UNCERTAIN, 3).otherwise(1)
    return grouped.withColumn("label", F.lit("")).orderBy(F.desc(weight), F.asc("candidate")).limit(n)


def candidate_summary(df: DataFrame, keys: list[str], score: str, ner_label: str | None = "ner_label", reason: str | None = None) -> DataFrame:
    """Per group: frequency, mean, least and largest score, usual NER label and reason (where the columns exist)."""
    some = df.where(F.col("candidate").isNotNull())
    extra = [mode(c).alias(f"most_common_{c}") for c in (reason, ner_label) if c and c in df.columns]
    scores = [F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score")] if score in df.columns else []
    return some.groupBy(*keys, "candidate").agg(F.count("*").alias("frequency"), *scores, *extra)


def reason_histogram(df: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent reasons; a missing reason counts as one."""
    return df.groupBy(F.coalesce("reason", F.lit("missing")).alias("reason")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc("reason")).limit(n)


def ner_distribution(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows per decision and NER label over several tables, missing labels as their own."""
    whole = None
    for decision, df in parts.items():
        one = df.select(F.lit(decision).alias("decision"), F.coalesce("ner_label", F.lit("NO_NER_LABEL")).alias("ner_label"))
        whole = one if whole is None else whole.unionByName(one)
    return whole.groupBy("decision", "ner_label").agg(F.count("*").alias("count"))


def overview(df: DataFrame, value: str) -> DataFrame:
    """Rows and different values of a column."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(value).alias("unique"))


#: Rank accuracy of the sketch that brackets a quantile: at most 4 / ACCURACY of the rows are looked at closely.
ACCURACY = 10_000


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Exact quantiles by linear interpolation, one row with columns ``q0, q1, ...``; nulls of an empty table.

    A mergeable sketch brackets each quantile, the rows below the bracket are counted, and only the
    different values inside it are sorted. So no task holds all values, as a plain exact percentile would.
    """
    x = F.col(column).cast("double")
    some = df.where(x.isNotNull()).select(x.alias("_x"))
    n = some.count()
    if not n:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(f"q{k}") for k in range(len(shares))])
    reach = 2 / ACCURACY + 2 / n  # the error of the sketch, and the neighbour needed to interpolate
    around = [min(1.0, max(0.0, p + side * reach)) for p in shares for side in (-1, 1)]
    bounds = some.agg(F.percentile_approx("_x", around, ACCURACY).alias("b")).first().b  # one small row
    brackets = [(k, p, bounds[2 * k], bounds[2 * k + 1]) for k, p in enumerate(shares)]
    below = some.agg(*[F.count_if(F.col("_x") < lo).alias(f"_b{k}") for k, _, lo, _ in brackets])
    inside = F.filter(F.array(*[F.when(F.col("_x").between(lo, hi), F.lit(k)) for k, _, lo, hi in brackets]), lambda k: k.isNotNull())
    near = some.withColumn("_k", F.explode(inside)).groupBy("_k", "_x").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_k").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    placed = near.withColumn("_to", upto).join(F.broadcast(below))  # one row

    def at(k: int, rank: int) -> Column:
        end = F.col(f"_b{k}") + F.col("_to")
        return F.max(F.when((F.col("_k") == k) & (end > rank) & (end - F.col("_n") <= rank), F.col("_x")))

    values = []
    for k, p, _, _ in brackets:
        place = (n - 1) * p
        low = int(place)
        values.append((at(k, low) + (at(k, min(low + 1, n - 1)) - at(k, low)) * (place - low)).alias(f"q{k}"))
    return placed.agg(*values)


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles by linear interpolation and largest value; nulls are left out."""
    c = F.col(column).cast("double")
    main = df.where(c.isNotNull()).agg(F.count("*").alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    q = quantiles(df, column, [0.25, 0.5, 0.75]).toDF("p25", "p50", "p75")
    return main.join(F.broadcast(q)).select("count", "mean", "std", "min", "p25", "p50", "p75", "max")  # one row each


def stratified_split(df: DataFrame, label: str, keys: list[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: of every label the rounded share of rows with the smallest seeded hashes; ties go by the keys.

    Rows are counted per label and start of the hash, running sums of these counts find the one bucket in which the share
    ends, and only the rows of that bucket are ranked: no task holds a label. Equal rows may change places.
    """
    order = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed))))
    rows = df.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, 4))
    per = rows.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    of = Window.partitionBy(label)  # at most 65,536 rows per label
    upto = F.sum("_n").over(of.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    bounds = per.select(F.col(label).alias("_l"), F.col("_b").alias("_k"), (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), F.floor(F.sum("_n").over(of) * share + 0.5).alias("_take"))
    placed = rows.join(bounds, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_k"))).drop("_l", "_k")
    split = (F.col("_before") < F.col("_take")) & (F.col("_upto") > F.col("_take"))
    inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_o", *keys))
    cut = placed.where(split).withColumn("is_test", F.col("_before") + inside <= F.col("_take"))
    whole = placed.where(~split).withColumn("is_test", F.col("_upto") <= F.col("_take"))
    return whole.unionByName(cut).select(*df.columns, "is_test")
