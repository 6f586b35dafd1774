"""Sensitivity to the two decision thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkroll.operators.aggregate import candidate_summary
from inkroll.operators.rules import NON_PERSON, PERSON, UNCERTAIN, by_thresholds

# The default pairs of a sweep.
DEFAULT_PAIRS = "0.95:0.05,0.90:0.10,0.85:0.15,0.80:0.20,0.75:0.25,0.70:0.30"


def parse_pairs(raw: str) -> list[tuple[float, float]]:
    """Pairs "person:non_person" separated by commas; blanks are skipped, 0 <= non_person < person <= 1 must hold."""
    pairs = []
    for part in raw.split(","):
        if part.strip():
            person, colon, non_person = part.strip().partition(":")
            if not colon:
                raise ValueError(f"not a threshold pair: {part.strip()}")
            p, n = float(person), float(non_person)
            if not 0 <= n < p <= 1:
                raise ValueError(f"thresholds must satisfy 0 <= non-person < person <= 1: {part.strip()}")
            pairs.append((p, n))
    if not pairs:
        raise ValueError("no threshold pairs")
    return pairs


def tag(person: float, non_person: float) -> str:
    """A folder-safe name of a pair."""
    return f"p{person}_np{non_person}".replace(".", "")


def apply_pairs(scored: DataFrame, pairs: list[tuple[float, float]], score: str = "person_score") -> DataFrame:
    """Every row under every pair: adds ``person_threshold, nonperson_threshold, tag, decision``.

    The pairs are constants of the plan; each row is expanded in place, without a join or shuffle.
    """
    options = F.array(*[F.struct(F.lit(p).alias("person_threshold"), F.lit(n).alias("nonperson_threshold"), F.lit(tag(p, n)).alias("tag")) for p, n in pairs])
    every = scored.withColumn("_pair", F.explode(options)).select(*scored.columns, "_pair.*")
    return every.withColumn("decision", by_thresholds(F.col(score), F.col("person_threshold"), F.col("nonperson_threshold")))


def by_interval(scored: DataFrame, pairs: list[tuple[float, float]], keys: list[str], score: str = "person_score", extra: list[Column] | None = None) -> DataFrame:
    """One row per ``keys`` and interval of the score between which no threshold lies: ``_level`` and the aggregates ``_n`` and ``extra``.

    All thresholds together part the scores into few intervals, in each of which every pair decides alike. So rows
    are combined first, and only what is left is expanded to the pairs.
    """
    cuts = [F.col(score) >= p for p in sorted({p for p, _ in pairs})] + [F.col(score) <= n for n in sorted({n for _, n in pairs})]
    level = F.concat(*[F.when(c, "1").otherwise("0") for c in cuts])
    return scored.groupBy(*keys, level.alias("_level")).agg(F.count("*").alias("_n"), *(extra or []))


def expand(levels: DataFrame, pairs: list[tuple[float, float]]) -> DataFrame:
    """Every row of `by_interval` under every pair: ``person_threshold, nonperson_threshold, tag, decision``."""
    upper, lower = sorted({p for p, _ in pairs}), sorted({n for _, n in pairs})
    place = {("p", p): k + 1 for k, p in enumerate(upper)} | {("n", n): len(upper) + k + 1 for k, n in enumerate(lower)}
    options = F.array(*[F.struct(F.lit(p).alias("person_threshold"), F.lit(n).alias("nonperson_threshold"), F.lit(tag(p, n)).alias("tag"), F.lit(place["p", p]).alias("_p"), F.lit(place["n", n]).alias("_q")) for p, n in pairs])
    every = levels.withColumn("_pair", F.explode(options)).select(*levels.columns, "_pair.*")
    said = lambda where: F.substring(F.col("_level"), F.col(where), F.lit(1)) == "1"
    return every.withColumn("decision", F.when(said("_p"), PERSON).when(said("_q"), NON_PERSON).otherwise(UNCERTAIN)).drop("_level", "_p", "_q")


def _summary(per: DataFrame) -> DataFrame:
    names = {"person": PERSON, "nonperson": NON_PERSON, "uncertain": UNCERTAIN}
    sums = [F.sum("_n").alias("total_candidate_occurrences")]
    sums += [F.coalesce(F.sum(F.when(F.col("decision") == d, F.col("_n"))), F.lit(0)).alias(f"{k}_occurrences") for k, d in names.items()]
    sums += [F.count_if((F.col("decision") == d) & F.col("candidate").isNotNull()).alias(f"{k}_unique") for k, d in names.items()]
    rates = [(F.col(f"{k}_occurrences") / F.col("total_candidate_occurrences")).alias(f"{k}_occurrence_rate") for k in names]
    return per.groupBy("person_threshold", "nonperson_threshold").agg(*sums).select("*", *rates)


_PER = ("person_threshold", "nonperson_threshold", "decision", "candidate")


def summarise(decided: DataFrame) -> DataFrame:
    """Per pair: occurrences, different candidates and shares of every decision, of rows decided by `apply_pairs`."""
    return _summary(decided.groupBy(*_PER).agg(F.count("*").alias("_n")))  # first level: bounds the distinct counts of hot names


def summarise_pairs(scored: DataFrame, pairs: list[tuple[float, float]], score: str = "person_score") -> DataFrame:
    """The same of scored rows, combined per candidate and interval of the score before the pairs are expanded."""
    return _summary(expand(by_interval(scored, pairs, ["candidate"], score), pairs).groupBy(*_PER).agg(F.sum("_n").alias("_n")))


def bucket_groups(decided: DataFrame, score: str = "person_score") -> DataFrame:
    """Per pair, decision and candidate: frequency, scores and usual NER label, of rows decided by `apply_pairs`."""
    return candidate_summary(decided, ["tag", "decision"], score)


def group_pairs(scored: DataFrame, pairs: list[tuple[float, float]], score: str = "person_score", ner_label: str | None = "ner_label") -> DataFrame:
    """The same of scored rows: frequency, mean, least and largest score, usual NER label (ties to the smallest, "" if none).

    Rows are combined per candidate, interval and label first; the pairs are expanded over that. Null candidates are no group.
    """
    has = ner_label is not None and ner_label in scored.columns
    some = scored.where(F.col("candidate").isNotNull())
    x = F.col(score)
    parts = by_interval(some, pairs, ["candidate", *([ner_label] if has else [])], score, [F.sum(x).alias("_sum"), F.count(x).alias("_m"), F.min(x).alias("_min"), F.max(x).alias("_max")])
    by = ["tag", "decision", "candidate"]
    labelled = expand(parts, pairs).groupBy(*by, *([ner_label] if has else [])).agg(*[F.sum(c).alias(c) for c in ("_n", "_sum", "_m")], F.min("_min").alias("_min"), F.max("_max").alias("_max"))
    usual = [F.coalesce(F.max(F.when(F.col(ner_label).isNotNull(), F.struct(F.col("_n"), _reversed(F.col(ner_label)), F.col(ner_label).alias("label"))))["label"], F.lit("")).alias(f"most_common_{ner_label}")] if has else []
    return labelled.groupBy(*by).agg(F.sum("_n").alias("frequency"), (F.sum("_sum") / F.sum("_m")).alias("mean_score"), F.min("_min").alias("min_score"), F.max("_max").alias("max_score"), *usual)


def _reversed(text: Column) -> Column:
    """Something that sorts opposite to a text: the negated code points, and what is shorter last."""
    return F.concat(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: -F.ascii(c)), F.array(F.lit(1)))
