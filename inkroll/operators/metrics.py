"""Quality of a binary classifier: confusion, curves and calibration.

Curves need running counts over the scores in descending order. They are built without a global sort:
counts per different score, a running sum over score buckets, and one within each bucket.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for running counts, of about equally many rows each; each is summed by one task.
BUCKETS = 1024
#: Rank accuracy of the sketch that gives their bounds; it decides how even the buckets are, not the result.
ACCURACY = 10_000


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def binary(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rows with a 0/1 label and a score, as ``y`` and ``s``; all others are left out."""
    return df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s"))


def confusion(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``tn, fp, fn, tp`` of ``y`` against ``s >= threshold``."""
    p = F.col("s") >= threshold
    y = F.col("y") == 1
    return df.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def confusion_shares(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The confusion matrix with every true class adding up to 1 (0 if the class is absent)."""
    m = confusion(df, threshold)
    neg, pos = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    return m.select(_div(F.col("tn"), neg).alias("tn"), _div(F.col("fp"), neg).alias("fp"), _div(F.col("fn"), pos).alias("fn"), _div(F.col("tp"), pos).alias("tp"))


def class_report(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages; 0 where undefined."""
    m = confusion(df, threshold)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def f1(p: Column, r: Column) -> Column:
        return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))

    p0, r0, p1, r1 = _div(tn, tn + fn), _div(tn, tn + fp), _div(tp, tp + fp), _div(tp, tp + fn)
    s0, s1 = tn + fp, fn + tp
    acc = _div(tn + tp, n)
    rows = [("0", p0, r0, f1(p0, r0), s0), ("1", p1, r1, f1(p1, r1), s1), ("accuracy", acc, acc, acc, n)]
    for name, w0, w1 in (("macro avg", F.lit(0.5), F.lit(0.5)), ("weighted avg", _div(s0, n), _div(s1, n))):
        rows.append((name, w0 * p0 + w1 * p1, w0 * r0 + w1 * r1, w0 * f1(p0, r0) + w1 * f1(p1, r1), n))
    structs = [F.struct(F.lit(a).alias("class"), b.alias("precision"), c.alias("recall"), d.alias("f1"), e.alias("support")) for a, b, c, d, e in rows]
    return m.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def running(df: DataFrame) -> DataFrame:
    """Per different score ``s``: positives and negatives at it (``pos, neg``), from it up (``tp, fp``) and in all (``all_pos, all_neg``).

    The bounds of the buckets are quantiles of the different scores from a sketch, so scores that pile up near 0 and 1, as
    those of a model do, spread over all of them. What reaches the driver is one row of bounds.
    """
    points = df.groupBy("s").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    shares = [k / BUCKETS for k in range(1, BUCKETS)]
    bounds = sorted(set(points.agg(F.percentile_approx("s", shares, ACCURACY).alias("b")).first().b or []))
    found = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="s", outputCol="_b", handleInvalid="keep") if bounds else None  # binary search
    points = found.transform(points) if found else points.withColumn("_b", F.lit(0.0))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    whole = Window.partitionBy(F.lit(0))
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("_b"))
    buckets = points.groupBy("_b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"), F.max(F.struct("s", "pos", "neg")).alias("_head"))
    buckets = buckets.select(
        "_b", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("_tp"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("_fp"), F.sum("bp").over(whole).alias("all_pos"), F.sum("bn").over(whole).alias("all_neg"), F.lead("_head").over(after).alias("_next")
    )
    inside = Window.partitionBy("_b").orderBy(F.desc("s"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = points.withColumn("_in_p", F.sum("pos").over(upto)).withColumn("_in_n", F.sum("neg").over(upto)).withColumn("_follow", F.lead(F.struct("s", "pos", "neg")).over(inside))
    return out.join(buckets, "_b").select(
        "s", "pos", "neg", (F.col("_tp") + F.col("_in_p")).alias("tp"), (F.col("_fp") + F.col("_in_n")).alias("fp"), "all_pos", "all_neg", F.coalesce("_follow", "_next").alias("next")
    )


def baseline(df: DataFrame) -> DataFrame:
    """Share of positives, the precision of accepting everything; null for an empty table."""
    return df.agg(F.avg(F.col("y").cast("double")).alias("positive_rate"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties counted half; null with one class only."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return running(df).agg(area.alias("_a"), F.max(F.col("all_pos") * F.col("all_neg")).alias("_n")).select(F.when(F.col("_n") > 0, F.col("_a") / F.col("_n")).alias("roc_auc"))


def average_precision(df: DataFrame) -> DataFrame:
    """Sum of precision times the step in recall; null without positives."""
    step = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return running(df).agg(step.alias("_a"), F.max("all_pos").alias("_n")).select(F.when(F.col("_n") > 0, F.col("_a") / F.col("_n")).alias("average_precision"))


def roc_curve(df: DataFrame) -> DataFrame:
    """``threshold, fpr, tpr`` per different score, from (0, 0); a point between two equal steps is dropped."""
    points = running(df)
    first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    keep = first | F.col("next").isNull() | (F.col("next.pos") != F.col("pos")) | (F.col("next.neg") != F.col("neg"))
    curve = points.where(keep).select(F.col("s").alias("threshold"), _div(F.col("fp"), F.col("all_neg")).alias("fpr"), _div(F.col("tp"), F.col("all_pos")).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(curve)


def pr_curve(df: DataFrame) -> DataFrame:
    """``threshold, precision, recall`` per different score and the end point (1, 0)."""
    curve = running(df).select(F.col("s").alias("threshold"), _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _div(F.col("tp"), F.col("all_pos")).alias("recall"))
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return curve.unionByName(end)


def threshold_sweep(df: DataFrame, steps: int = 99) -> DataFrame:
    """Precision, recall, F1 and accepted rate at evenly spaced thresholds from 0.01 to 0.99, in one pass over the rows.

    Every row is counted once, at the highest threshold it reaches; running sums over the thresholds do the rest.
    """
    spark = df.sparkSession
    grid = [round(0.01 + i * (0.98 / (steps - 1)), 12) for i in range(steps)] if steps > 1 else [0.01]
    rank = sum((F.col("s") >= t).cast("int") for t in grid)
    counts = df.groupBy(rank.alias("rank")).agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    frame = spark.createDataFrame([(i + 1, t) for i, t in enumerate(grid)] + [(0, None)], "rank int, threshold double")
    w = Window.partitionBy(F.lit(0))  # one row per threshold
    down = w.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    got = frame.join(counts, "rank", "left").withColumns({"pos": F.coalesce("pos", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    got = got.select("threshold", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("taken"), F.sum("pos").over(w).alias("all_pos"), F.sum("n").over(w).alias("total"))
    p, r = _div(F.col("tp"), F.col("taken")), _div(F.col("tp"), F.col("all_pos"))
    return got.where("threshold is not null").select("threshold", p.alias("precision"), r.alias("recall"), F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("f1"), _div(F.col("taken"), F.col("total")).alias("accepted_rate"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and share of positives per uniform bin; a value on an edge belongs to the lower bin; only filled bins."""
    k = sum((F.col("s") > i / bins).cast("int") for i in range(1, bins))
    return df.groupBy(k.alias("bin")).agg(F.avg("s").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("positive_rate"), F.count("*").alias("count"))


def predictions(df: DataFrame, label: str, score: str, threshold: float = 0.9) -> DataFrame:
    """All columns with ``true_label, predicted_label`` and their names."""
    name = lambda c: F.when(c == 1, "PERSON").otherwise("NON_PERSON")
    some = df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull()).withColumn("true_label", F.col(label).cast("int")).withColumn("predicted_label", (F.col(score) >= threshold).cast("int"))
    return some.withColumn("true_label_name", name(F.col("true_label"))).withColumn("predicted_label_name", name(F.col("predicted_label")))


def errors(predicted: DataFrame, score: str, kind: str = "all") -> DataFrame:
    """Wrong predictions: all, false positives (highest score first) or false negatives (lowest first)."""
    wrong = predicted.where("true_label <> predicted_label")
    if kind == "fp":
        return wrong.where("true_label = 0").orderBy(F.desc(score))
    if kind == "fn":
        return wrong.where("true_label = 1").orderBy(F.asc(score))
    return wrong
