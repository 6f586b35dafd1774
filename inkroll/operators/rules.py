"""Decisions on candidates: the rule cascade and thresholds on a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkroll.functions.text import normalize_spaces
from inkroll.operators.features import FEATURES, with_features

PERSON, NON_PERSON, UNCERTAIN = "PERSON", "NON_PERSON", "UNCERTAIN"
PERSON_AT, NON_PERSON_AT = 0.90, 0.10


def _decide(label: str, score: float, reason: str) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))


def rule_decision(candidate: Column) -> Column:
    """The first rule that fits, over the feature columns: struct of label, score and reason."""
    f = F.col
    # Scores and reasons.
    return (
        F.when(normalize_spaces(candidate) == "", _decide(NON_PERSON, 1.0, "empty"))
        .when((f("has_digit") + f("has_email") + f("has_url")) > 0, _decide(NON_PERSON, 0.99, "contains digit/email/url"))
        .when(f("looks_like_collaboration") == 1, _decide(NON_PERSON, 0.98, "collaboration/group-like"))
        .when(f("org_phrase_count") > 0, _decide(NON_PERSON, 0.97, "contains organization phrase"))
        .when(f("org_keyword_count") >= 2, _decide(NON_PERSON, 0.96, "multiple organization keywords"))
        .when((f("org_keyword_count") >= 1) & (f("contains_of") == 1), _decide(NON_PERSON, 0.95, "organization keyword plus 'of'"))
        .when(f("too_long_for_person") == 1, _decide(NON_PERSON, 0.93, "too many tokens"))
        .when(f("starts_with_the") == 1, _decide(NON_PERSON, 0.92, "starts with 'the'"))
        .when((f("uppercase_tokens") >= 1) & (f("char_count") <= 8), _decide(NON_PERSON, 0.88, "short acronym-like candidate"))
        .when(f("ner_is_org") == 1, _decide(NON_PERSON, 0.80, "NER says ORG"))
        .when(
            (f("plausible_person_length") == 1) & (f("all_tokens_name_like") == 1) & (f("org_keyword_count") == 0) & (f("titlecase_tokens") + f("initial_count") > 0),
            _decide(PERSON, 0.90, "name-like structure"),
        )
        .when((f("ner_is_person") == 1) & (f("plausible_person_length") == 1) & (f("org_keyword_count") == 0), _decide(PERSON, 0.88, "NER says PERSON and structure plausible"))
        .when(f("token_count") == 1, _decide(UNCERTAIN, 0.50, "single-token candidate"))
        .when((f("connector_count") > 0) & (f("particle_count") == 0), _decide(UNCERTAIN, 0.45, "connector words present"))
        .otherwise(_decide(UNCERTAIN, 0.50, "ambiguous"))
    )


def with_rules(df: DataFrame, candidate: str = "candidate", ner_label: str | None = None, fix_initials: bool = False) -> DataFrame:
    """Add ``rule_label``, ``rule_score``, ``rule_reason``; a null candidate is ambiguous. Narrow, no shuffle."""
    featured = with_features(df, candidate, ner_label, fix_initials).withColumn("_rule", rule_decision(F.col(candidate)))
    return featured.select(*df.columns, F.col("_rule.label").alias("rule_label"), F.col("_rule.score").alias("rule_score"), F.col("_rule.reason").alias("rule_reason"))


def classify_by_rules(df: DataFrame, candidate: str = "candidate", ner_label: str | None = None) -> DataFrame:
    """Add ``label, score, reason``: the score is the probability of a person, 0.5 for every uncertain one."""
    decided = with_rules(df, candidate, ner_label)
    score = F.when(F.col("rule_label") == PERSON, F.col("rule_score")).when(F.col("rule_label") == NON_PERSON, 1 - F.col("rule_score")).otherwise(0.5)
    return decided.select(*df.columns, F.col("rule_label").alias("label"), F.round(score, 10).alias("score"), F.col("rule_reason").alias("reason"))


def by_thresholds(score: Column, person: Column | float, non_person: Column | float) -> Column:
    """PERSON from ``person`` up, else NON_PERSON up to ``non_person``, else UNCERTAIN; a null score is UNCERTAIN."""
    return F.when(score >= person, PERSON).when(score <= non_person, NON_PERSON).otherwise(UNCERTAIN)


def classify_by_score(df: DataFrame, score: str, person: float = PERSON_AT, non_person: float = NON_PERSON_AT) -> DataFrame:
    """Add ``label`` and ``reason`` from a model's probability."""
    return df.withColumn("label", by_thresholds(F.col(score), person, non_person)).withColumn("reason", F.lit("supervised_model"))


def ner_priority(labels: Column) -> Column:
    """One label of an array of entity labels: PERSON, then ORG, then LOCATION (GPE or LOC), else null."""
    has = lambda x: F.array_contains(labels, x)
    return F.when(has("PERSON"), "PERSON").when(has("ORG"), "ORG").when(has("GPE") | has("LOC"), "LOCATION")


__all__ = ["FEATURES", "rule_decision", "with_rules", "classify_by_rules", "by_thresholds", "classify_by_score", "ner_priority"]
