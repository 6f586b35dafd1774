"""Structural features of a candidate as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkroll.functions import text as X
from inkroll.functions.vocab import COLLABORATION, CONNECTORS, ORG_KEYWORDS, ORG_PHRASES, PARTICLES

COUNTS = [
    "token_count", "char_count", "org_keyword_count", "connector_count", "particle_count", "collaboration_count", "org_phrase_count", "initial_count", "alpha_name_piece_count", "uppercase_tokens", "titlecase_tokens",
]
FLAGS = [
    "has_digit", "has_email", "has_url", "has_ampersand", "has_slash", "has_hyphen", "has_apostrophe", "all_tokens_name_like", "plausible_person_length", "too_long_for_person", "starts_with_the", "contains_of",
    "looks_like_collaboration", "ner_is_person", "ner_is_org",
]
FEATURES = sorted(["log_char_count", *COUNTS, *FLAGS])


def with_features(df: DataFrame, candidate: str = "candidate", ner_label: str | None = None, fix_initials: bool = False) -> DataFrame:
    """Add the 27 features. A null candidate has null features but for the NER flags; an empty one has no tokens.

    ``fix_initials``: count initials such as "J."; off, they never count, as their dot is stripped first.
    """
    c = X.normalize_spaces(F.col(candidate))
    df = df.withColumn("_c", c).withColumn("_cl", F.lower("_c")).withColumn("_tk", X.tokens(F.col(candidate))).withColumn("_lt", F.transform("_tk", F.lower))
    c, cl = F.col("_c"), F.col("_cl")

    def count(where: str, test) -> Column:
        return F.size(F.filter(where, test))

    def flag(test: Column) -> Column:
        return test.cast("int")

    collaboration = count("_lt", lambda t: t.isin(COLLABORATION))
    ner = F.col(ner_label) if ner_label else F.lit(None).cast("string")
    n = F.size("_tk")
    values = {
        "token_count": n,
        "char_count": F.length(c),
        "log_char_count": F.log1p(F.length(c).cast("double")),
        "org_keyword_count": count("_lt", lambda t: t.isin(ORG_KEYWORDS)),
        "connector_count": count("_lt", lambda t: t.isin(CONNECTORS)),
        "particle_count": count("_lt", lambda t: t.isin(PARTICLES)),
        "collaboration_count": collaboration,
        "org_phrase_count": sum((flag(F.contains(cl, F.lit(p))) for p in ORG_PHRASES), F.lit(0)),
        "initial_count": count("_tk", lambda t: X.is_initial(t, fix_initials)),
        "alpha_name_piece_count": count("_tk", X.is_name_piece),
        "uppercase_tokens": count("_tk", X.is_upper),
        "titlecase_tokens": count("_tk", lambda t: (F.length(t) > 1) & X.is_mixed_case(t)),
        "has_digit": flag(c.rlike("\\p{Nd}")),
        "has_email": flag(c.rlike("[^ ]+@[^ ]+")),
        "has_url": flag(cl.rlike("https?://|www\\.")),
        "has_ampersand": flag(F.contains(c, F.lit("&"))),
        "has_slash": flag(F.contains(c, F.lit("/"))),
        "has_hyphen": flag(F.contains(c, F.lit("-"))),
        "has_apostrophe": flag(F.contains(c, F.lit("'")) | F.contains(c, F.lit("’"))),
        "all_tokens_name_like": flag((n > 0) & F.forall("_tk", lambda t: X.is_name_piece(t) | X.is_initial(t, fix_initials))),
        "plausible_person_length": flag(n.between(2, 5)),
        "too_long_for_person": flag(n > 6),
        "starts_with_the": flag(F.startswith(cl, F.lit("the "))),
        "contains_of": flag(F.contains(F.concat(F.lit(" "), cl, F.lit(" ")), F.lit(" of "))),
        "looks_like_collaboration": flag((collaboration > 0) | F.endswith(cl, F.lit("collaboration"))),
        "ner_is_person": flag(F.coalesce(ner == "PERSON", F.lit(False))),
        "ner_is_org": flag(F.coalesce(ner == "ORG", F.lit(False))),
    }
    return df.withColumns(values).drop("_c", "_cl", "_tk", "_lt")
