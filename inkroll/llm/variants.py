"""Problem 1: variant spellings of one person or organisation, by canonical rewritings and an equi-join.

Every spelling is rewritten under fixed rules: titles dropped, nicknames to formal names, given names to
initials, legal forms and abbreviations to full words, accents and token order removed, acronyms to their
letters, and for typing errors the forms with one letter left out. A reading is looked up under its forms
among the forms of full names, and what it meets is scored by the rarity of the rewriting (an exact full
form is rarest, a lone initial most common). A spelling joins the entity of its best partner; if its best
form fits several entities it stays alone.

No form gathers pairs: the full names of a form are first combined to one row (the most frequent, and the
two ends of the range of names, which tell whether the form is ambiguous), and each reading meets that row.

Family names and given names are told apart by rarity, too: words that occur in many different names are
given names or generic words of organisations. Those are counted over all rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkroll.llm.lookalikes import canonical_text
from inkroll.session import materialise, release, spread
from inkroll.sources.tables import table

# Titles.
TITLES = frozenset("dr prof mr ms mrs".split())
# Words that organisations drop or change freely.
STOP = frozenset("the of for and in on at de des der".split())
# Abbreviations and other spellings of words in the names of organisations.
WORDS = dict(
    pair.split("=")
    for pair in (
        "inst=institute institut=institute univ=university universitat=university universite=university dept=department dep=department lab=laboratory labs=laboratory laboratories=laboratory acad=academy "
        "ctr=centre center=centre collab=collaboration coll=collaboration exp=experiment expt=experiment cons=consortium grp=group phys=physics chem=chemistry math=mathematics res=research stud=studies sci=science "
        "tech=technology eng=engineering natl=national intl=international assoc=association corp=corporation co=company ltd=limited inc=incorporated"
    ).split()
)
# Words that mark an organisation or group.
ORGANISATIONS = frozenset("institute university department laboratory academy centre collaboration experiment consortium group team survey school faculty college company corporation limited incorporated association society observatory".split())
# Formal given names and their common short forms.
SHORT_FORMS = """
abigail: abby gail abbie | alexander: alex xander sasha sandy lex alec | anthony: tony ant | benjamin: ben benny benji | charles: chuck charlie chas | christopher: chris kit topher
deborah: deb debbie debby | dmitri: dima mitya | edward: ed eddie ned ted teddy | ekaterina: katya katia katja | elizabeth: liz beth betty eliza lizzie bess libby lisa | francisco: paco pancho fran cisco
friedrich: fritz fred fritzi | gabriella: gabi ella gaby gabby | giuseppe: beppe pino peppe | guillermo: memo guille willy | henrietta: etta hattie hetty | james: jim jamie jimmy | johannes: jan hannes hans
john: jack johnny jon | joseph: joe jo joey | katherine: kat kathy kate katie kit kitty | lawrence: larry laurie | leonardo: leo leon nardo | margaret: maggie meg peggy marge | matthias: matt hias
michael: mike mick mickey mikey | nicholas: nick nico nicky | patricia: pat trish patty tricia | penelope: penny nell | richard: rick rich dick ricky richie | robert: bob bobby rob robbie bert | samuel: sam sammy
susanna: sue sanna susie suzy | theodore: ted theo teddy | thomas: tom tommy | victoria: vicky tori vic | william: bill will billy willy liam | andrew: andy drew | daniel: danny | david: dave davey
""".replace("\n", "|")
#: A word is common if it occurs in at least this share of the different names,
COMMON = 0.0005
#: to which so many imagined names without it are added, as a few names in a small table say little about a word.
PRIOR = 16_000
#: Two names that differ by an accent stay apart if both have this many times the rows of a typical spelling (the geometric mean),
FREQUENT = 2.0
#: two that differ by a letter if they have this many times, as a letter is sooner mistyped,
FREQUENT_LETTERS = 4.0
#: and the rarer one is not rarer than this share of the other. Both are ratios: the same rows several times over change nothing.
MAJOR_SHARE = 0.1
#: Families per shard when families of one letter's difference are sought: what one task sorts, some twelve forms of ten bytes each.
SHARD = 200_000

ROOTS: dict[str, tuple[str, ...]] = {}
for _entry in SHORT_FORMS.split("|"):
    if _entry.strip():
        _formal, _, _short = _entry.partition(":")
        for _s in _short.split():
            ROOTS[_s] = (*ROOTS.get(_s, ()), _formal.strip())
FORMAL = frozenset(f for fs in ROOTS.values() for f in fs)
# Letters that carry no combining mark and still lose their stroke.
_STROKES = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ]")


def plain(word: str) -> str:
    """A lower-case word without accents."""
    return word if word.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", word.translate(_STROKES)))


def rewrite(name: str, common: frozenset[str]) -> tuple[str, list[tuple]]:
    """The class of a spelling (its words, order and format removed) and its readings.

    A reading is (kind, family, family with accents, given, middle initial, whether that was written as one). Kinds: f full
    name, p and w full name with an unknown given name (likelier and other order), i initials only, o organisation,
    a organisation with an acronym, m a single word.
    """
    text = canonical_text(name) or ""
    written = _WORD.findall(text.lower())
    cls = " ".join(sorted(written))
    words = [(plain(w), w) for w in written if w not in TITLES]
    tokens = [WORDS.get(p, p) for p, _ in words]
    if ORGANISATIONS.intersection(tokens):
        kept = [(t, a) for t, (_, a) in zip(tokens, words, strict=True) if t not in STOP]
        head = next(((t, a) for t, a in kept if t not in common and t not in ORGANISATIONS and len(t) > 3), kept[0] if kept else ("", ""))
        rest = list(kept)
        rest.remove(head) if head in rest else None
        others = sorted(t for t, _ in rest)
        return cls, [("o", head[0], head[1], " ".join(others), "".join(sorted(t[0] for t in others)), False)]
    if words and words[0][0] == "the":
        words = words[1:]
    long = [(p, a) for p, a in words if len(p) > 1]
    initials = [p for p, _ in words if len(p) == 1]
    if len(long) < 1 or len(words) < 2:
        return cls, [("m", " ".join(p for p, _ in words), " ".join(a for _, a in words), "", "", False)]
    rare = [x for x in long if x[0] not in common and x[0] not in ROOTS and x[0] not in FORMAL]
    known = [x for x in long if x not in rare]
    block = [x for x in rare if 2 <= len(x[0]) <= 4 and x[0].isalpha()] if len(long) == 2 and len(rare) == 2 and not initials else []
    found: list[tuple] = []

    def add(kind: str, family: list[tuple[str, str]], given: str, middle: str) -> None:
        found.append((kind, " ".join(sorted(p for p, _ in family)), " ".join(sorted(a for _, a in family)), given, middle, middle in initials))

    if not known and initials and len(rare) <= 2 and (len(rare) == 1 or not block):
        if len(rare) == 1:
            add("i", rare, initials[0], initials[1] if len(initials) > 1 else "")
            return cls, found
    if known and rare:
        given = "".join(p for p, _ in known)
        roots = () if given in common else ROOTS.get(given, ())
        add("f" if len(roots) < 2 else "p", rare, roots[0] if len(roots) == 1 else given, initials[0] if initials else "")
        return cls, found
    pool = rare or known
    if len(block) == 1 and block[0][0] not in ROOTS:
        family = [x for x in rare if x is not block[0]]
        letters = block[0][0]
        add("i", family, letters[0], letters[1])
        add("a", family, "", "".join(sorted(letters)))
    inverted = "," in text or ";" in text
    order = list(range(len(pool))) if not inverted else list(range(len(pool) - 1, -1, -1))
    for n, k in enumerate(order):  # the first word, or the last one of an inverted name, is the likeliest given name
        family = [x for j, x in enumerate(pool) if j != k]
        if family:
            add("w" if n or len(block) == 1 else "p", family, pool[k][0], initials[0] if initials else "")
    return cls, found or [("m", pool[0][0], pool[0][1], "", "", False)]


def shortened(word: str) -> list[str]:
    """The word with one letter left out."""
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


class GivenNames:
    """Rewritings of a given name into known ones: short forms, typing errors, beginnings. Known are the common words and the fixed lists."""

    def __init__(self, common: frozenset[str]) -> None:
        self.known = {w for w in {*common, *FORMAL, *ROOTS} if len(w) > 1}
        self.near: dict[str, set[str]] = defaultdict(set)
        self.starts: dict[str, set[str]] = defaultdict(set)
        for w in self.known:
            for form in (w, *shortened(w)):
                self.near[form].add(w)
            for n in range(2, len(w)):
                self.starts[w[:n]].add(w)
        self.rewritings = cache(self.rewritings)

    def rewritings(self, kind: str, given: str) -> str:
        """Scores and names like ``55:robert 40:bobby``."""
        if kind not in "fpw" or len(given) < 2:
            return ""
        found = dict.fromkeys(sorted(self.starts.get(given, ())), 40)
        if kind != "f" and len(given) > 2:
            found |= {w: 50 for form in (given, *shortened(given)) for w in sorted(self.near.get(form, ())) if w != given}
        found |= dict.fromkeys(ROOTS.get(given, ()), 55)
        found.pop(given, None)
        return " ".join(f"{score}:{w}" for w, score in sorted(found.items()))


#: No middle initial, as a number of a bit. Latin letters are 0 to 25, those of other scripts share 27 to 62 by code point.
NO_MIDDLE = 26


def middle_bit(middle: str) -> int:
    c = middle[:1]
    return NO_MIDDLE if not c else ord(c) - 97 if "a" <= c <= "z" else 27 + ord(c) % 36


_PARSED = "name string, weight long, cls string, reading string, middles long, first boolean, several boolean"
# The fields of a reading: letters is the acronym of an organisation, and the middle initial of a reading with initials only (a
# bit's number); others are the rewritings of the given name; free: the given name is no known word.
_READING = ("kind", "family", "accented", "given", "letters", "free", "others")
_PART = "\u0001"


def typical_weight(names: DataFrame) -> float:
    """The geometric mean of the rows of the different names."""
    return math.exp(names.agg(F.avg(F.ln(F.greatest("weight", F.lit(1)))).alias("m")).first().m or 0.0)


def common_words(names: DataFrame) -> frozenset[str]:
    """Words in at least `COMMON` of the different names: at most (words per name) / COMMON rows reach the driver."""
    total = names.count()
    # Cased look-alikes and accents are few among common words; they are made plain here.
    words = names.select(F.explode(F.array_distinct(F.filter(F.split(F.lower("name"), "[^\\p{L}\\p{N}]+"), lambda x: F.length(x) > 1))).alias("w"))
    found = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON * (total + PRIOR)).select("w").collect()
    return frozenset(plain(canonical_text(r.w) or "") for r in found)


def parse(names: DataFrame, common: frozenset[str]) -> DataFrame:
    """One row per spelling and reading, the fields of the reading packed in one text; ``middles`` is the middle initial as a bit, if it
    was written as one (two letters after a family name may be a short given name).
    """
    shipped = names.sparkSession.sparkContext.broadcast(common)
    columns = [x.split() for x in _PARSED.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        given_names = GivenNames(known)
        for batch in batches:
            rows = []
            for name, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cls, found = rewrite(name, known)
                if cls:
                    for n, (kind, family, accented, given, middle, written) in enumerate(found):
                        bit = middle_bit(middle) if kind in "fpwi" else 0
                        letters = middle if kind in "oa" else str(bit) if kind == "i" and bit != NO_MIDDLE else ""
                        reading = (kind, family, accented, given, letters, "" if given in given_names.known else "1", given_names.rewritings(kind, given))
                        rows.append((name, weight, cls, _PART.join(reading), (1 << (bit if written else NO_MIDDLE)) if kind in "fpwi" else 0, n == 0, len(found) > 1))
            values = list(zip(*rows, strict=True)) or [()] * len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(values, columns, strict=True)], names=[c for c, _ in columns])

    return names.select("name", "weight").mapInArrow(run, _PARSED)


def _field(name: str) -> Column:
    """A field of a packed reading."""
    value = F.split("reading", _PART)[_READING.index(name)]
    return value == "1" if name == "free" else value


def _key(*parts: Column | str) -> Column:
    """48 bits of a hash: what meets by chance is told apart by the score, and the zero bytes compress away."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 16)


# Odd numbers that mix the bits of a hash.
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_BACK = pow(_BASE, -1, 1 << 64)


def deletion_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the word and hash of every form of it: itself and with one letter left out, a run of equal letters once.

    A hash is a polynomial of the letters, so that of a form without a letter is made of two partial sums: time and
    memory are linear in the letters.
    """
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    index, forms, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(order):
        width = len(words[order[at]])
        end = at
        while end < len(order) and len(words[order[end]]) == width and (end == at or (end - at) * width < 1_000_000):
            end += 1
        rows = np.array(order[at:end], np.int64)
        at = end
        if not width:
            continue
        codes = np.frombuffer("".join(words[k] for k in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), width).astype(np.uint64)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(width - 1, _BASE, np.uint64)]), dtype=np.uint64)
        sums = np.cumsum((codes + np.uint64(7)) * powers, axis=1, dtype=np.uint64)
        total = sums[:, -1:]
        before = np.concatenate([np.zeros((len(rows), 1), np.uint64), sums[:, :-1]], axis=1)
        found = np.concatenate([total, before + (total - sums) * np.uint64(_BACK)], axis=1)
        fresh = np.ones(found.shape, bool)
        fresh[:, 2:] = codes[:, 1:] != codes[:, :-1]
        index.append(np.repeat(rows, fresh.sum(axis=1)))
        forms.append(found[fresh])
    mixed = np.concatenate(forms)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(_MIX)
    return np.concatenate(index), mixed ^ (mixed >> np.uint64(29))


def near_families(heads: DataFrame, shards: int) -> DataFrame:
    """Families ``fam, near`` that share a form with one letter less, both ways; told apart by the letters later.

    Forms travel packed, four bytes of the form's hash and six of the family's, one row per batch and bucket; a task sorts the
    forms of its buckets. The families of one form are bounded by the alphabet: all are the form with one letter put in
    somewhere, and each family occurs once, however many names have it. ``heads`` has one row per ``fam, family``.
    """
    buckets = 16 * shards

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, forms = deletion_hashes(batch.column(1).to_pylist())
            fams = batch.column(0).to_numpy().astype("<u8")[index]
            bucket = (forms >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            packed = np.empty((len(order), 10), np.uint8)
            packed[:, :4] = (forms[order] & np.uint64(0xFFFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)
            packed[:, 4:] = fams[order].view(np.uint8).reshape(-1, 8)[:, :6]
            kept, starts = np.unique(bucket[order], return_index=True)
            ends = [*starts[1:].tolist(), len(order)]
            yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int64)), pa.array([packed[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary())], names=["bucket", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at = [], []
        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(packed.as_buffer(), np.uint8).reshape(-1, 10)
                parts.append(rows)
                at.append(np.full(len(rows), bucket, np.uint64))
        if not parts:
            return
        rows, bucket = np.concatenate(parts), np.concatenate(at)
        key = (bucket << np.uint64(32)) | rows[:, :4].copy().view("<u4").reshape(-1).astype(np.uint64)
        fam = np.zeros((len(rows), 8), np.uint8)
        fam[:, :6] = rows[:, 4:]
        order = np.argsort(key)
        key, fam = key[order], fam.view("<i8").reshape(-1)[order]
        left, right, step = [], [], 1
        while len(same := np.flatnonzero(key[:-step] == key[step:])) if step < len(key) else False:
            left += [fam[same], fam[same + step]]
            right += [fam[same + step], fam[same]]
            step += 1
        if left:
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["fam", "near"])

    some = heads.where(F.length("family") > 2).select("fam", "family")
    packed = some.mapInArrow(pack, "bucket long, packed binary").repartition(shards, "bucket")
    return packed.mapInArrow(meet, "fam long, near long").distinct()


def _one_off(a: Column, b: Column) -> Column:
    """One letter added, lost or changed, or two neighbours swapped."""
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return F.levenshtein(a, b, 1).between(0, 1) | swapped


def _less_one(text: Column) -> Column:
    """All forms of a text with one letter left out, and itself."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))))


def _forms(*entries: tuple[Column, Column]) -> Column:
    """One array of all entries whose condition holds; an entry is an array of structs."""
    return F.flatten(F.array(*[F.when(test, found).otherwise(F.array().cast("array<struct<key:bigint,rank:int>>")) for test, found in entries]))


def _entry(key: Column, rank: int | Column = 0) -> Column:
    return F.struct(key.alias("key"), (F.lit(rank) if isinstance(rank, int) else rank).cast("int").alias("rank"))


#: What is more frequent, the family first; ties go to the longer family name, and the last one breaks those left.
_ORDER = ("pull", "support", "size", "node")


def _targets(live: DataFrame) -> DataFrame:
    """One row per form of full names: the most frequent, known given names first, and the ends of the range of names under the form."""
    c, fam, acc = F.col, F.col("fam"), F.xxhash64("accented")
    person, organisation = c("kind").isin("f", "p"), c("kind") == "o"
    first = F.substring("given", 1, 1)
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.getbit(F.col("middles"), b) == 1)
    sought = person & (c("initials") | (c("degree") > 0))
    forms = _forms(
        (person, F.array(_entry(_key(F.lit("g"), fam, "given")))),
        (sought, F.array(_entry(_key(F.lit("i"), fam, first, F.lit(""))))),
        (sought, F.transform(bits, lambda b: _entry(_key(F.lit("i"), fam, first, b.cast("string"))))),
        (person & c("accents"), F.array(_entry(_key(F.lit("G"), acc, "given")))),
        (sought & c("accents"), F.array(_entry(_key(F.lit("I"), acc, first, F.lit(""))))),
        (sought & c("accents"), F.transform(bits, lambda b: _entry(_key(F.lit("I"), acc, first, b.cast("string"))))),
        (person & c("free") & (F.length("given") > 2), F.transform(F.sequence(F.lit(2), F.length("given") - 1), lambda n: _entry(_key(F.lit("x"), fam, F.substring(c("given"), F.lit(1), n))))),
        (organisation, F.array(_entry(_key(F.lit("o"), fam, "given")), _entry(_key(F.lit("a"), fam, "letters")))),
        (organisation & c("accents"), F.array(_entry(_key(F.lit("O"), acc, "given")), _entry(_key(F.lit("A"), acc, "letters")))),
    )
    rows = live.where(person | organisation).select(F.explode(forms).alias("f"), F.struct((c("kind") == "f").alias("sure"), *_ORDER).alias("v"), F.concat_ws("|", "family", "given").alias("whose"))
    return rows.groupBy("f.key").agg(F.max("v").alias("v"), F.min("whose").alias("a"), F.max("whose").alias("b"))


def _probes(live: DataFrame, near: DataFrame) -> DataFrame:
    """The forms under which every reading is looked up, with the rank of the rewriting."""
    c, fam, acc = F.col, F.col("fam"), F.xxhash64("accented")
    person, organisation = c("kind").isin("f", "p", "w"), c("kind") == "o"
    others = F.filter(F.split("others", " "), lambda x: x != "")
    rank, name = lambda x: F.substring_index(x, ":", 1).cast("int"), lambda x: F.substring_index(x, ":", -1)
    # With a middle initial: names that have it, and, as a weaker rewriting, names that occur without one.
    middles = F.when(c("letters") == "", F.array(F.struct(F.lit("").alias("m"), F.lit(0).alias("more")))).otherwise(
        F.array(F.struct(c("letters").alias("m"), F.lit(4).alias("more")), F.struct(F.lit(str(NO_MIDDLE)).alias("m"), F.lit(0).alias("more")))
    )
    own = _forms(
        (person & ((c("kind") != "f") | c("accents")), F.array(_entry(_key(F.lit("g"), fam, "given"), 60))),
        (person & c("accents"), F.array(_entry(_key(F.lit("G"), acc, "given"), 61))),
        (person, F.transform(others, lambda x: _entry(_key(F.lit("g"), fam, name(x)), rank(x)))),
        (person & c("accents"), F.transform(others, lambda x: _entry(_key(F.lit("G"), acc, name(x)), rank(x) + 1))),
        (person & c("open") & (F.length("given") > 1), F.array(_entry(_key(F.lit("x"), fam, "given"), 40))),
        (c("kind") == "i", F.transform(middles, lambda m: _entry(_key(F.lit("i"), fam, "given", m["m"]), 30 + m["more"]))),
        ((c("kind") == "i") & c("accents"), F.transform(middles, lambda m: _entry(_key(F.lit("I"), acc, "given", m["m"]), 31 + m["more"]))),
        (organisation & c("accents"), F.array(_entry(_key(F.lit("o"), fam, "given"), 60), _entry(_key(F.lit("O"), acc, "given"), 61))),
        (c("kind") == "a", F.array(_entry(_key(F.lit("a"), fam, "letters"), 35))),
        ((c("kind") == "a") & c("accents"), F.array(_entry(_key(F.lit("A"), acc, "letters"), 36))),
    )
    to = F.col("near")
    off = _forms(
        (person, F.array(_entry(_key(F.lit("g"), to, "given"), 20))),
        (person, F.transform(F.filter(others, lambda x: rank(x) != 50), lambda x: _entry(_key(F.lit("g"), to, name(x)), F.when(rank(x) == 55, 13).otherwise(12)))),
        (person & (F.length("given") > 1), F.array(_entry(_key(F.lit("x"), to, "given"), 12))),
        (c("kind") == "i", F.transform(middles, lambda m: _entry(_key(F.lit("i"), to, "given", m["m"]), F.when(m["more"] > 0, 11).otherwise(10)))),
        (organisation, F.array(_entry(_key(F.lit("o"), to, "given"), 25))),
        (c("kind") == "a", F.array(_entry(_key(F.lit("a"), to, "letters"), 15))),
    )
    kept = [F.struct(*_ORDER).alias("u"), c("kind").alias("u_kind")]
    beside = live.where((c("degree") > 0) & (F.length("family") > 3)).join(near, "fam").select(F.explode(off).alias("f"), *kept, c("family").alias("u_family"))
    return live.select(F.explode(own).alias("f"), *kept, F.lit(None).cast("string").alias("u_family")).unionByName(beside).select("f.key", "f.rank", "u", "u_kind", "u_family")


def _mistyped(live: DataFrame) -> DataFrame:
    """What meets under a form with one letter less of the given name, or of the other words of an organisation: probe and target.

    Only where a family has several of them; names under one form are bounded by the alphabet, and by accents.
    """
    c = F.col
    person, organisation = c("kind").isin("f", "p", "w") & c("free") & c("unknown"), (c("kind") == "o") & c("organisations")
    some = live.where((person | organisation) & (F.length("given") > 1))
    rows = some.select(F.explode(_less_one(c("given"))).alias("form"), "fam", "kind", "given", "family", F.struct((c("kind") == "f").alias("sure"), *_ORDER).alias("v"))
    rows = rows.select(_key(F.when(c("kind") == "o", "o").otherwise("p"), "fam", "form").alias("key"), "kind", "given", "v", F.concat_ws("|", "family", "given").alias("whose"))
    u = rows.where("kind in ('p', 'w', 'o') and length(given) > 2").select("key", F.struct(*[f"v.{x}" for x in _ORDER]).alias("u"), c("kind").alias("u_kind"), c("given").alias("u_given"))
    v = rows.where("kind <> 'w'").select("key", "v", "given", c("whose").alias("a"), c("whose").alias("b"))
    met = u.join(v, "key").where(_one_off(c("u_given"), c("given")))
    return met.select("key", F.when(c("u_kind") == "o", 45).otherwise(50).alias("rank"), "u", "u_kind", F.lit(None).cast("string").alias("u_family"), "v", "a", "b")


def _edges(live: DataFrame, near: DataFrame, typical: float) -> DataFrame:
    """``u, kind, score, v, a, b``: what every reading meets, kept if the rewriting holds."""
    met = _probes(live, near).join(_targets(live), "key").unionByName(_mistyped(live)).where("u.node <> v.node")
    c, rank = F.col, F.col("rank")
    smaller = c("u") < F.struct(*[f"v.{x}" for x in _ORDER])
    grows = (c("v.sure") & (c("u_kind") != "f")) | smaller
    bound = F.when(rank.isin(60, 61), FREQUENT * typical).otherwise(FREQUENT_LETTERS * typical)
    apart = (F.least("u.support", "v.support") >= bound) & (c("u.support") >= MAJOR_SHARE * c("v.support"))
    holds = (
        F.when(rank.isin(60, 61), ~apart & F.when(c("u_kind") == "o", smaller).otherwise(grows))
        .when(rank.isin(40, 41, 50, 51), ~apart & grows)
        .when(rank.isin(20, 25, 45), ~apart & smaller)
        .when(rank == 12, ~apart)
        .otherwise(True)
    )
    far = (rank < 30) & ~_one_off(c("u_family"), F.substring_index("a", "|", 1))  # all names under a form have one family
    return met.where(holds & ~far).select(c("u.node").alias("u"), c("u_kind").alias("kind"), rank.alias("score"), F.struct(*[f"v.{x}" for x in _ORDER]).alias("v"), "a", "b")


def rooted(parents: DataFrame) -> DataFrame:
    """``u, v, score`` with the parent ``v`` of every ``u`` replaced by the root of its chain, however long.

    Every round doubles the steps and cuts the lineage with a table. While a chain is not at its root, each round brings some node
    there; when none gets there any more, the rest runs in circles, and each circle gets its largest member as root.
    """
    steps, before, last = parents, None, None
    while True:
        jump = parents.select(F.col("u").alias("v"), F.col("v").alias("w"))
        moved = materialise(parents.join(jump, "v", "left").select("u", F.coalesce("w", "v").alias("v"), "score", F.col("w").isNotNull().alias("moved")))
        left = moved.where("moved").count()
        if last is not None:
            release(last)
        parents, last = moved.drop("moved"), moved
        if not left:
            return parents
        if left == before:
            break
        before = left
    circling = parents.join(steps.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    ring = steps.join(circling, "u", "left_semi").select("u", "v", F.col("u").alias("top"))
    for _ in range((left - 1).bit_length()):  # top: the largest of as many nodes from u on as v is steps away
        jump = ring.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("top").alias("more"))
        ring = materialise(ring.join(jump, "v").select("u", F.col("w").alias("v"), F.greatest("top", "more").alias("top")))
    ends = ring.join(ring.select(F.col("u").alias("v"), F.col("top").alias("root")), "v").select("u", "root")
    return parents.join(ends, "u", "left").select("u", F.coalesce("root", "v").alias("v"), "score")


def link_variants(names: DataFrame, paired_only: bool = False) -> DataFrame:
    """The entity of every spelling: ``name``, ``cls`` (spellings equal but for format), ``entity``.

    ``names`` has one row per different ``name`` (not null) and its ``weight`` in rows. Empty names and names without letters
    or digits get no row; an empty table gives none. Spellings of one class always share their entity.
    With ``paired_only`` entities of one class may be left out, which have no pairs.

    Readings equal but for format are one node. Only nodes whose family has several, or one letter's difference to another, can have
    links; the others leave before the forms are made. Middle initials are no part of a node: an entity in
    which several occur is parted by them at the end, and spellings without one then are an entity of their own.
    """
    typical = typical_weight(names)
    parsed = parse(names, common_words(names)).withColumn("cls", F.shiftrightunsigned(F.xxhash64("cls"), 16))
    parsed = materialise(parsed.withColumn("node", F.xxhash64("reading")))
    nodes = parsed.groupBy("reading").agg(F.sum("weight").alias("support"), F.bit_or("middles").alias("middles"), F.min("cls").alias("_a"), F.max("cls").alias("_b"))
    nodes = materialise(nodes.select("reading", "support", "middles", (F.col("_a") != F.col("_b")).alias("multi"), _key(_field("family")).alias("fam")))
    fields = nodes.select(*[_field(x).alias(x) for x in ("kind", "family", "accented", "free")], "support").where("kind <> 'm' and length(family) > 1")
    accent = F.when(F.col("accented") == F.col("family"), 0).otherwise(F.hash("accented"))
    person = F.col("kind").isin("f", "p", "w")
    heads = fields.groupBy("family").agg(
        F.count("*").alias("nodes"), (F.min(accent) != F.max(accent)).alias("accents"), F.max(F.col("kind") == "i").alias("initials"), (F.count_if(F.col("kind") == "o") > 1).alias("organisations"),
        F.max(person & F.col("free")).alias("open"), (F.count_if(person & F.col("free")) > 1).alias("unknown"), F.sum("support").alias("pull"),
    )
    heads = materialise(heads.withColumn("fam", _key("family")))
    near = materialise(near_families(heads, max(names.sparkSession.sparkContext.defaultParallelism, math.ceil(heads.count() / SHARD))))
    # Of two families of one letter's difference the one with more rows is right.
    marked = heads.drop("family").withColumn("degree", F.lit(0)).unionByName(near.groupBy("fam").agg(F.count("*").cast("int").alias("degree")), allowMissingColumns=True)
    marked = marked.groupBy("fam").agg(*[F.max(x).alias(x) for x in ("nodes", "accents", "initials", "organisations", "open", "unknown", "pull", "degree")])
    live = nodes.drop("multi").join(marked.where("nodes > 1 or degree > 0").drop("nodes"), "fam")
    live = materialise(live.withColumn("node", F.xxhash64("reading")).withColumns({x: _field(x) for x in _READING}).withColumn("size", F.length("family")).where("kind <> 'm'").drop("reading"))
    edges = _edges(live, near, typical).repartition("u")
    best = edges.groupBy("u", "kind", "score").agg(F.max("v")["node"].alias("v"), F.min("a").alias("a"), F.max("b").alias("b"))
    best = best.groupBy("u").agg(F.max(F.struct("score", "kind", "v", "a", "b")).alias("t")).select("u", "t.*")
    parents = materialise(best.where("a = b or startswith(b, a) or levenshtein(a, b, 2) between 0 and 2 or (kind <> 'i' and score >= 20 and score not between 40 and 41)").select("u", "v", "score"))
    release(heads, near)
    parents = rooted(parents)
    # Only nodes that can be linked, or have several classes, can have pairs.
    linkable = nodes.where("multi").select(F.xxhash64("reading").alias("node"), "middles").unionByName(live.select("node", "middles")).distinct()
    members = linkable.join(parents.withColumnRenamed("u", "node"), "node", "left").select("node", "middles", "score", F.coalesce("v", "node").alias("root"))
    members = materialise(members)
    release(nodes, live, parents)
    roots = members.groupBy("root").agg(F.bit_or("middles").alias("all"))
    members = members.join(roots, "root").select("node", "root", "score", (F.bit_count(F.col("all").bitwiseAND(F.lit(~(1 << NO_MIDDLE)))) > 1).alias("parted"))
    chosen = parsed.select("name", "cls", "node", "middles", "first", "several").join(members, "node", "inner" if paired_only else "left")
    entity = F.when(F.col("parted"), F.xxhash64("root", "middles")).otherwise(F.coalesce("root", "node")).alias("entity")
    chosen = chosen.where("first or score is not null").select("name", "cls", "several", F.coalesce("score", F.lit(0)).alias("score"), entity)
    single = chosen.where("not several").select("name", "cls", "entity")
    return single.unionByName(chosen.where("several").groupBy("name", "cls").agg(F.max(F.struct("score", "entity"))["entity"].alias("entity")))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of spellings of one entity that differ by more than format or look-alike characters.

    Only entities with several classes are joined with themselves; the copies within a class make no pairs.
    The pairs are the result asked for; `link_variants` gives the same as membership, one row per spelling.
    """
    linked = materialise(linked)
    several = linked.groupBy("entity").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("entity")
    members = linked.join(several, "entity", "left_semi")
    left, right = members.alias("l"), members.alias("r")
    return left.join(right, (F.col("l.entity") == F.col("r.entity")) & (F.col("l.cls") != F.col("r.cls")) & (F.col("l.name") < F.col("r.name"))).select(F.col("l.name").alias("name_1"), F.col("r.name").alias("name_2"))


def _names(spark: SparkSession, folder: str) -> DataFrame:
    both = table(spark, folder, "author_counts").select(F.col("author").alias("name")).unionByName(table(spark, folder, "scored_candidates").select(F.col("candidate").alias("name")))
    return spread(materialise(both.where("name is not null").groupBy("name").agg(F.count("*").alias("weight"))))


def p1_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with its entity."""
    return link_variants(_names(spark, folder)).select("name", "entity")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of spellings that name the same person or organisation."""
    return variant_pairs(link_variants(_names(spark, folder), paired_only=True))


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities}
