"""Splitting fields that pack several values, by a parsing expression grammar.

    field   <- slot (SEP slot)*
    slot    <- blank* (quoted / bare) blank*          # ordered: quoted first, bare on failure
    quoted  <- '"' ('""' / [^"])* '"' &(blank* (SEP / end))
    bare    <- (bracketed / nickname / !SEP any)+
    bracketed <- '(' (bracketed / [^()])* ')'         # else the '(' is an ordinary character
    SEP     <- ';' / '|' / TAB / line end / ideographic comma / blank '&' / blank '/' / bullet / ' and ' / ','

The comma is the only separator that may also stand inside a value: before a suffix (``Smith, Jr.``)
and between family and given name (``Smith, Ann B.``); `_joins` decides each one by its two sides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Name suffixes that stay with the name before them.
SUFFIXES = frozenset("jr sr ii iii iv v phd md esq".split())
# Titles that may stand before a given name.
TITLES = frozenset("dr mr mrs ms prof".split())
# Words after which one further word and "and" open a topic ("for Ice and Snow Studies").
TOPIC_OPENERS = frozenset("for of in on institute institut inst centre center ctr school laboratory lab academy acad department dept university univ".split())
# Opening and closing quotes that may enclose a whole value.
QUOTE_PAIRS = {'"': '"', "“": "”", "«": "»", "'": "'"}

_STOP = re.compile(r"""[("\[]|[,;|；、，\t\n\r\x0b\x0c]|\s+[&/•](?=\s|$)|(?<=\S)[&/•](?=\s)|\s+and(?=\s)""", re.IGNORECASE)
_ANY = re.compile(r"""["'“«(\[,;|；、，\t\n\r\x0b\x0c&/•]|\sand\s""", re.IGNORECASE)
_GAP = re.compile(r"[ \t\n\r\x0b\x0c,;|；、，&/•]+")
_LEAD_AND = re.compile(r"and\s+", re.IGNORECASE)
_SLOT_END = re.compile(r"\s*(?:$|[,;|；、，\t\n\r&/•]|and\s)", re.IGNORECASE)
_QUOTED = {'"': re.compile(r'"((?:[^"]|"")*)"'), "“": re.compile("“([^“”]*)”"), "«": re.compile("«([^«»]*)»"), "'": re.compile(r"'([^']*)'")}
_BRACKETS = re.compile(r"[()\[\]]")
_NOTE = re.compile(r'\([^()]*\)|"[^"]*"|\[[^\[\]]*\]')
_INITIAL = re.compile(r"(?:\w\.?(?:-?\w\.)*)$")


def _fold(text: str) -> str:
    """Letters as they look: compatibility forms resolved, invisible characters dropped."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")


def _ends(text: str) -> dict[int, int]:
    """End of every bracket that closes, by its start; round and square brackets are matched apart, in one pass."""
    ends: dict[int, int] = {}
    open_at: dict[str, list[int]] = {")": [], "]": []}
    for m in _BRACKETS.finditer(text):
        c = m.group()
        if c in "([":
            open_at[")" if c == "(" else "]"].append(m.start())
        elif open_at[c]:
            ends[open_at[c].pop()] = m.end()
    return ends


def _name_word(word: str) -> bool:
    """A capitalised or upper-case word of cased letters, hyphens allowed."""
    for part in re.split("[-‐‑－]", word):
        bare = part.replace("'", "").replace("’", "")
        if not bare or not bare.isalpha() or not bare[0].isupper() or not (len(bare) == 1 or bare[1:].islower() or bare.isupper()):
            return False
    return True


def _joins(left: str, right: str) -> bool:
    """Whether a comma between these two pieces belongs to one name."""
    after = _fold(_NOTE.sub(" ", right)).split()
    if not after:
        return False
    if len(after) == 1 and after[0].rstrip(".").lower() in SUFFIXES:
        return True
    if len(after) > 1 and after[0].rstrip(".").lower() in TITLES:
        after = after[1:]
    before = _fold(left).split()
    if len(before) != 1 or not _name_word(before[0]) or len(after) > 3:
        return False
    return all(_INITIAL.fullmatch(x) for x in after[1:]) and (_name_word(after[0].removesuffix(".")) or bool(_INITIAL.fullmatch(after[0])))


def _opens_topic(left: str) -> bool:
    """Whether ``left`` ends in a preposition or kind of organisation and one word, so that "and" continues it."""
    words = left.rsplit(None, 2)[-2:]
    if len(words) < 2 or len(left.split()) < 3:
        return False
    return _fold(words[0]).translate(_SHAPES).rstrip(".").lower() in TOPIC_OPENERS


# Cyrillic and Greek letters that can stand in the prepositions above.
_SHAPES = str.maketrans({"о": "o", "ο": "o", "О": "O", "Ο": "O", "і": "i", "Ι": "I"})



def split_field(text: str, blanks: str | None = None) -> list[tuple[str, str | None]]:
    """The values of one field with an error flag each (``bad_quote``, ``bad_bracket`` or None).

    ``blanks``: the characters to take off around a value, by default all white space.
    """
    if not _ANY.search(text):
        text = text.strip(blanks)
        return [(text, None)] if text else []
    pieces: list[list] = []  # start, end, separator before, value if quoted, flag
    at, n, gap, ends = 0, len(text), "", None
    while at < n:
        if m := _GAP.match(text, at):
            gap += m.group()
            at = m.end()
        if gap.strip() or pieces:
            if m := _LEAD_AND.match(text, at):
                gap += " and "
                at = m.end()
                continue
        if at >= n:
            break
        flag, opening = None, text[at]
        if opening in QUOTE_PAIRS:
            m = _QUOTED[opening].match(text, at)
            if m and _SLOT_END.match(text, m.end()):
                value = m.group(1).replace('""', '"') if opening == '"' else m.group(1)
                pieces.append([at, m.end(), gap, value.strip(blanks), None])
                at, gap = m.end(), ""
                continue
            flag = "bad_quote" if opening == '"' else None
        k = at
        while True:
            m = _STOP.search(text, k)
            if not m:
                end = nxt = n
                break
            what = m.group()
            if what in "([":
                ends = _ends(text) if ends is None else ends
                k = ends.get(m.start(), -1)
                if k < 0:
                    flag, k = "bad_bracket", m.end()
            elif what == '"':
                k = text.find('"', m.end()) + 1
                if not k:
                    flag, k = "bad_quote", m.end()
            elif what.strip().lower() in ("and", "&") and _opens_topic(text[at : m.start()]):
                k = m.end()
            else:
                end, nxt = m.start(), m.end()
                break
        pieces.append([at, end, gap, None, flag])
        gap, at = text[end:nxt], nxt
    out: list[list] = []
    for piece in pieces:
        start, end, sep, value, flag = piece
        if out and value is None and sep.strip(" ") == "," and out[-1][3] is None and _joins(text[out[-1][0] : out[-1][1]].strip(), text[start:end]):
            out[-1][1], out[-1][4] = end, out[-1][4] or flag
        else:
            out.append(piece)
    values = ((text[a:b].strip(blanks) if value is None else value, flag) for a, b, _, value, flag in out)
    return [(v, f) for v, f in values if v]


def split_values(df: DataFrame, field: str, position: str = "position", item: str = "item", error: str = "error", blanks: str | None = None) -> DataFrame:
    """One row per value packed in ``field``, with all other columns, the 0-based position and an error flag.

    Null, empty and blank fields and empty slots yield no row; repeated rows stay repeated; a field of
    any length is parsed whole, in time linear in its length but for unclosed quotes. The output
    columns ``position``, ``item`` and ``error`` replace input columns of the same name. Narrow: no shuffle.
    """
    new = {position, item, error}
    keep = [c for c in df.columns if c != field and c not in new]
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + [T.StructField(position, T.IntegerType()), T.StructField(item, T.StringType()), T.StructField(error, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, positions, items, errors = [], [], [], []
            for r, text in enumerate(batch.column(len(keep)).to_pylist()):
                if text:
                    for p, (value, flag) in enumerate(split_field(text, blanks)):
                        rows.append(r)
                        positions.append(p)
                        items.append(value)
                        errors.append(flag)
            index = pa.array(rows, pa.int64())
            columns = [batch.column(k).take(index) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(positions, pa.int32()), pa.array(items, pa.string()), pa.array(errors, pa.string())], names=[*keep, position, item, error])

    return df.select(*keep, field).where(df[field].isNotNull()).mapInArrow(run, schema)
