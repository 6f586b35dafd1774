"""Text functions as column expressions; only Unicode NFKC, which Spark lacks, is a vectorised UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkroll.functions.vocab import CANDIDATE_TRIM, TOKEN_TRIM, WS


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize_unicode(text: Column) -> Column:
    """Unicode NFKC; ASCII rows stay in the JVM. Null stays null."""
    odd = text.rlike("[^\\u0000-\\u007F]")
    return F.when(odd, _nfkc(F.when(odd, text))).otherwise(text)


def normalize_spaces(text: Column) -> Column:
    """Runs of white space to one blank, ends stripped."""
    return F.btrim(F.regexp_replace(text, f"{WS}+", " "))


def remove_parentheses(text: Column) -> Column:
    """Each innermost-first ``(...)`` without nesting to a blank; an unclosed one stays."""
    return F.regexp_replace(text, "\\([^)]*\\)", " ")


def clean_field(text: Column, nfkc: bool = True) -> Column:
    """NFKC, parentheses, line breaks and tabs, white space, in this order."""
    text = remove_parentheses(normalize_unicode(text) if nfkc else text)
    return normalize_spaces(F.translate(text, "\n\t", "  "))


def unify_separators(text: Column) -> Column:
    """``;`` and ``|`` with the white space around them, and the word "and" between white space, to a comma."""
    text = F.regexp_replace(text, f"{WS}*[;|]{WS}*", ",")
    return F.regexp_replace(text, f"(?i){WS}+and{WS}+", ",")


def split_candidates(text: Column, nfkc: bool = True) -> Column:
    """The array of candidates of a raw field; null gives null, blank slots are dropped."""
    parts = F.split(unify_separators(clean_field(text, nfkc)), ",", -1)
    tidy = F.transform(parts, lambda x: normalize_spaces(F.btrim(normalize_spaces(x), F.lit(CANDIDATE_TRIM))))
    return F.filter(tidy, lambda x: x != "")


def strip_outer_punctuation(token: Column) -> Column:
    return F.btrim(token, F.lit(TOKEN_TRIM))


def tokens(text: Column) -> Column:
    """The tokens of a candidate without outer punctuation; empty ones are dropped."""
    return F.filter(F.transform(F.split(normalize_spaces(text), " ", -1), strip_outer_punctuation), lambda t: t != "")


def lower_tokens(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.btrim(F.lower(t)))


def is_initial(token: Column, fixed: bool = False) -> Column:
    """A capital and a dot. Outer dots are stripped first, so without ``fixed`` no token ever is one."""
    return token.rlike("^[A-Z]\\.?$") if fixed else F.lit(False)


def is_name_piece(token: Column) -> Column:
    """Letters, hyphens and apostrophes, with at least one letter."""
    return strip_outer_punctuation(token).rlike("^[\\p{L}\\-'’]*\\p{L}[\\p{L}\\-'’]*$")


def is_mixed_case(token: Column) -> Column:
    """A capital first and a lower-case letter later."""
    return token.rlike("^\\p{Lu}.*\\p{Ll}")


def is_upper(token: Column) -> Column:
    """At least two characters, a cased one among them, and none in lower case."""
    return (F.length(token) > 1) & (F.upper(token) == token) & (F.lower(token) != token)
