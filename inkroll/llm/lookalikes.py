"""Problem 2: one consistent form for text that looks the same but differs in its characters.

Canonical form: NFKC, letters of other scripts that look like Latin ones replaced by those, characters
without visible shape dropped, blanks of any kind turned into plain ones, runs of blanks made one, ends
stripped. Case, punctuation, order and visible accents are kept.

A quick check decides per character whether it can change: Unicode's quick-check property of the normal form (a
character that is its own normal form), its combining class, and whether it can join the character before it; letters
with look-alikes and characters without shape can change, too. Texts of stable characters only are passed
through inside the JVM; in the others only the unstable segments, each with the stable character before it as
boundary context, are normalised, and the results spliced between the unchanged rest.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkroll.operators.multivalue import split_values
from inkroll.session import spread
from inkroll.sources.tables import table

# Letters of other scripts that look like Latin letters, by script, and hyphens that look like "-".
CYRILLIC = ("аеоурсхіјѕһԁԛԝкАВЕКМНОРСТХІЈЅУԚԜԌ", "aeoypcxijshdqwkABEKMHOPCTXIJSYQWG")
GREEK = ("οανιρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "oavipukABEZHIKMNOPTYXCj")
LATIN = ("ıɑɡ", "iag")
ARMENIAN = ("օոսհցզյՕՍՏԼ", "onuhgqjOUSL")
CHEROKEE = ("ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᎡᏒ", "ABCDEGHiJKLMPSTVWZRR")
COPTIC = ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥⲭ", "ABEHIKMNOPCTYXopcx")
HYPHENS = ("‐‑⁃﹣", "----")
LOOKALIKES = {a: b for other, own in (CYRILLIC, GREEK, LATIN, ARMENIAN, CHEROKEE, COPTIC, HYPHENS) for a, b in zip(other, own, strict=True)}
# Letters without ink or width that are not of category Cf or Mn.
INVISIBLE = "ᅟᅠㅤﾠ⠀͏឴឵᠋᠌᠍︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"
# Fixed value: the end of the two planes with alphabets; what lies beyond counts as unstable.
_LAST = 0x20000
# Blocks that are stable or unstable as a whole, ideographs and Hangul syllables, surrogates and private use.
_WHOLE = {(0x3400, 0x4DBF): True, (0x4E00, 0x9FFF): True, (0xAC00, 0xD7A3): True, (0xD800, 0xF8FF): False}


def _stable_ranges() -> list[tuple[int, int]]:
    """Code points that no step can change, by the properties of the Unicode tables that Python comes with."""
    joins = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # vowels and final consonants of Hangul
    for c in (c for first, last in ((0xC0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, _LAST)) for c in range(first, last)):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            joins.add(int(parts[1], 16))

    def stable(c: int) -> bool:
        char = chr(c)
        if c < 0x7F:
            return c >= 0x20 or char in "\t\n\r\x0b\x0c"
        if unicodedata.category(char)[0] not in "LNPSM" or unicodedata.combining(char) or c in joins:
            return False
        return char not in LOOKALIKES and char not in INVISIBLE and unicodedata.is_normalized("NFKC", char)

    ranges: list[tuple[int, int]] = []
    at = 0
    for (first, last), kept in [*_WHOLE.items(), ((_LAST, _LAST), False)]:
        for c in range(at, first):
            if stable(c):
                if ranges and ranges[-1][1] == c - 1:
                    ranges[-1] = (ranges[-1][0], c)
                else:
                    ranges.append((c, c))
        if kept:
            ranges.append((first, last))
        at = last + 1
    return ranges


_RANGES = _stable_ranges()
#: The stable code points as the inside of a character class.
STABLE = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _RANGES)
# For the JVM, whose character classes try one range after the other: a few ranges that hold most texts, and all stable
# characters but those of whole blocks for a look-up in a table.
_COMMON = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _RANGES if b < 0x250 or (a, b) in _WHOLE or 0x3041 <= a < 0x3100)
_TABLE_OF_STABLE = "".join(chr(c) for a, b in _RANGES if (a, b) not in _WHOLE for c in range(a, b + 1))
PLAIN_BLANKS = " \t\n\r\x0b\x0c"

_SEGMENT = re.compile(f"[{STABLE}]?[^{STABLE}]+")
_UNSTABLE = re.compile(f"[^{STABLE}]")
_TABLE = str.maketrans({**LOOKALIKES, **dict.fromkeys(INVISIBLE, None)})
_BLANKS = re.compile(r"[\s⠀ㅤ]+")


def _normal(segment: str) -> str:
    text = unicodedata.normalize("NFKC", segment.translate(_TABLE)).translate(_TABLE)
    if text.isascii() and text.isprintable():
        return text
    kept = []
    for c in text:
        kind = unicodedata.category(c)
        if c.isspace() or kind in ("Zs", "Zl", "Zp"):
            kept.append(" ")
        elif kind not in ("Cf", "Cc", "Cn", "Co"):
            kept.append(c)
    return unicodedata.normalize("NFKC", "".join(kept))


def canonical_text(text: str | None) -> str | None:
    """The canonical form of one text; None stays None, an empty or invisible text gives an empty one."""
    if text is None:
        return None
    if text.isascii() and text.isprintable():
        return _BLANKS.sub(" ", text).strip() if "  " in text or text[:1] == " " or text[-1:] == " " else text
    if _UNSTABLE.search(text):
        text = _SEGMENT.sub(lambda m: _normal(m.group()), text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
    return _BLANKS.sub(" ", text).strip()


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text, na_action="ignore")


def is_stable(text: Column) -> Column:
    """The quick check inside the JVM: no character can change. Each step sees only texts that failed the one before."""
    ascii_only, common = ~text.rlike("[^\\t\\n\\x0b\\f\\r -~]"), ~text.rlike(f"[^{_COMMON}]")
    return ascii_only | common | (F.translate(text, _TABLE_OF_STABLE, "") == "")


def _tidy(text: Column) -> Column:
    """Runs of plain blanks made one, ends stripped."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\u000b\\f]+", " "))


def canonical(text: Column) -> Column:
    """Canonical form as a column. Rows that pass the quick check only have their blanks tidied; they reach Python as nulls."""
    return F.when(is_stable(text), _tidy(text)).otherwise(_canonical(F.when(~is_stable(text), text)))


def normalise(df: DataFrame, column: str, into: str) -> DataFrame:
    """Add the canonical form of ``column``; nulls stay null, all rows and other columns are kept. One pass."""
    return df.withColumn(into, canonical(F.col(column)))


def looks_like(df: DataFrame, name: str, names: DataFrame, ref: str) -> DataFrame:
    """Rows of ``df`` whose ``name`` looks like an entry ``ref`` of ``names`` but is another string.

    Columns of both sides are kept. A name of stable characters could only look like an entry by being
    it (up to plain blanks, which are no case), so such rows leave before Python. Nulls, empty names and
    empty tables give no rows; repeated rows are kept. The join is on the canonical form; Catalyst
    broadcasts ``names`` only if its size is below the session's threshold.
    """
    odd = df.where(~is_stable(F.col(name))).withColumn("_form", _canonical(F.col(name)))
    refs = names.where(F.col(ref).isNotNull()).withColumn("_form", _canonical(F.col(ref)))
    return odd.join(refs, "_form").where((F.col("_form") != "") & (_tidy(F.col(name)) != F.col(ref))).drop("_form")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Names that look the same as a reference name but are not the same string."""
    refs = table(spark, folder, "reference_names").select("ref_id", "ref_name")
    scored = table(spark, folder, "scored_candidates").select(F.lit("scored_candidates").alias("table_name"), F.col("cand_id").alias("row_key"), F.col("candidate").alias("name"))
    records = table(spark, folder, "raw_records").select("line_no", "authors").where(F.col("authors").isNotNull() & ~is_stable(F.col("authors")))
    items = split_values(spread(records), "authors", blanks=PLAIN_BLANKS).select(F.lit("raw_records").alias("table_name"), F.col("line_no").alias("row_key"), F.col("item").alias("name"))
    hits = [looks_like(x, "name", refs, "ref_name").select("table_name", "row_key", "ref_id") for x in (scored, items)]
    return hits[0].unionByName(hits[1].distinct())


def p2_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every scored candidate with its canonical form."""
    rows = table(spark, folder, "scored_candidates").select("cand_id", "candidate")
    return normalise(rows, "candidate", "canonical")


QUERIES = {"p2_found": p2_found, "p2_canonical": p2_canonical}
