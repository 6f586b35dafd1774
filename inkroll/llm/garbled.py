"""Problem 6: text decoded with the wrong character encoding, found and restored.

Every chain "encode as A, decode as B" (once or twice) that is possible for a name proposes a reading.
A smoothed character n-gram model, trained on the clean names of the whole table, scores the name as it
stands and every reading; the likeliest reading is accepted if it beats the name by a margin. A part of the
names, chosen by a hash, is left out of the training; the margin is validated on all of these, as they are
and garbled by the same chains, in one distributed pass. Text that lost characters has no reading; it is told by the
model, too: by how unlikely its least likely sign is among clean names, against a bound validated on the same
names with characters replaced.

The name as it stands is scored in its look-alike canonical form, so unusual but intended characters
(full-width letters, invisible characters) do not speak for a reading.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkroll.llm.lookalikes import PLAIN_BLANKS, canonical_text
from inkroll.operators.multivalue import split_field
from inkroll.session import materialise, spread
from inkroll.sources.tables import table

# Fixed values: (encoding the text was wrongly read in, encoding it was written in).
CHAINS = (
    ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1250", "utf-8"), ("cp1251", "utf-8"), ("cp1254", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("cp866", "utf-8"), ("mac_roman", "utf-8"), ("koi8_r", "utf-8"), ("gbk", "utf-8"),
    ("latin-1", "gbk"), ("cp1252", "gbk"), ("latin-1", "cp1251"), ("cp1252", "cp1251"), ("latin-1", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("latin-1", "shift_jis"), ("latin-1", "euc_jp"), ("latin-1", "big5"),
)
#: Letters of two scripts side by side, as look-alikes leave them.
_MIXED = re.compile("[A-Za-z\u00c0-\u024f][\u0370-\u052f]|[\u0370-\u052f][A-Za-z\u00c0-\u024f]")
#: A second wrong reading after a first one: again UTF-8 read byte by byte.
_DOUBLE = tuple((a, b) for a, b in CHAINS if b == "utf-8" and a != "gbk")
#: One in so many different clean names beyond ASCII, chosen by a hash of the name, validates the margin and is not learned from.
HELD_OUT = 20
#: Least margin and distance of the margins that are tried.
LEAST, STEP = 2.0, 0.5
# Fixed value: share of garbled names, by which falsely accepted and missed names are weighed.
EXPECTED = 0.01
_SINGLE_BYTE = frozenset(a for a, _ in CHAINS if a != "gbk")
_ENCODE: dict[str, dict[int, int]] = {}
for _name in _SINGLE_BYTE:
    _map: dict[int, int] = {b: b for b in range(128, 160)}  # bytes a code page leaves undefined pass as control characters
    for _b in range(256):
        try:
            _map[ord(bytes([_b]).decode(_name))] = _b
        except UnicodeDecodeError:
            pass
    _ENCODE[_name] = _map
_LOST = "�"
#: Quick check, in Python and in Java: bytes beyond ASCII come in runs in all encodings of several bytes and in Cyrillic ones; only
#: GBK makes one character of the two bytes of an accented letter, always an ideograph, which may stand alone.
QUICK = "[^\u0000-\u007f]{2}|[\u4e00-\u9fff]"
_RUN = re.compile(QUICK)
_FOREIGN_RUN = re.compile("[\u0080-\u024f]{4}")


def encode(text: str, encoding: str) -> bytes | None:
    """The bytes that give ``text`` when read as ``encoding``; None if there are none."""
    codes = _ENCODE.get(encoding)
    try:
        return text.encode(encoding) if codes is None else codecs.charmap_encode(text, "strict", codes)[0]
    except UnicodeEncodeError:
        return None


def reread(text: str, wrong: str, right: str) -> str | None:
    """``text``, wrongly read as ``wrong``, read as ``right``; None if that is impossible."""
    raw = encode(text, wrong)
    if raw is None:
        return None
    try:
        return raw.decode(right)
    except UnicodeDecodeError:
        return None


@cache
def _back(wrong: str) -> dict[int, str]:
    return {b: chr(c) for c, b in sorted(_ENCODE[wrong].items(), reverse=True)}


def garble(text: str, right: str, wrong: str) -> str:
    """The inverse: written as ``right``, read as ``wrong``, undefined bytes as control characters."""
    if wrong not in _ENCODE:
        return text.encode(right).decode(wrong)
    back = _back(wrong)
    return "".join(back[b] for b in text.encode(right))


def kind(c: str) -> str:
    """Coarse class of a character, the back-off of the model."""
    if c.isascii():
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c == " " else "."
    code, category = ord(c), unicodedata.category(c)
    if category in ("Ll", "Lu", "Lt", "Lm"):
        script = "l" if code < 0x250 or 0x1E00 <= code < 0x1F00 else "c" if 0x400 <= code < 0x530 else "g" if 0x370 <= code < 0x400 else "o"
        return script.upper() if category == "Lu" else script
    if category == "Lo":
        return "h" if 0x4E00 <= code < 0xA000 else "k" if 0x3040 <= code < 0x3100 else "x"
    return category


# Rough numbers of characters per class, over which unseen ones share their probability.
_SIZES = {"h": 21000, "k": 180, "x": 10000, "So": 6000, "Sm": 900}


@dataclass
class CharModel:
    """Interpolated character bigram model with a class bigram below it."""

    pairs: dict[str, int]
    singles: Counter = field(default_factory=Counter)
    heads: Counter = field(default_factory=Counter)
    kind_pairs: Counter = field(default_factory=Counter)
    kinds: Counter = field(default_factory=Counter)
    cache: dict[str, float] = field(default_factory=dict)
    lost: float = 12.0

    def __post_init__(self) -> None:
        for pair, n in self.pairs.items():
            a, b = pair
            self.singles[b] += n
            self.heads[a] += n
            self.kind_pairs[kind(a) + "|" + kind(b)] += n
            self.kinds[kind(b)] += n
        self.kind_heads = Counter()
        for key, n in self.kind_pairs.items():
            self.kind_heads[key.partition("|")[0]] += n

    def step(self, pair: str) -> float:
        """Log probability of the second character after the first."""
        if (known := self.cache.get(pair)) is not None:
            return known
        a, b = pair
        ka, kb = kind(a), kind(b)
        shape = (self.kind_pairs.get(f"{ka}|{kb}", 0) + 0.05) / (self.kind_heads.get(ka, 0) + 0.05 * 30)
        inside = (self.singles.get(b, 0) + 0.2) / (self.kinds.get(kb, 0) + 0.2 * _SIZES.get(kb, 200))
        head = self.heads.get(a, 0)
        trust = head / (head + 20)
        direct = self.pairs.get(pair, 0) / head if head else 0.0
        value = math.log(0.8 * trust * direct + (1 - 0.8 * trust) * shape * inside)
        if len(self.cache) < 200_000:
            self.cache[pair] = value
        return value

    def surprise(self, of: str) -> float:
        """Negative log probability of a class of characters."""
        return -math.log((self.kinds.get(of, 0) + 0.05) / (self.kinds.total() + 0.05 * 30))

    def score(self, text: str) -> float:
        """Log probability of a text between two blanks."""
        text = f" {text} "
        return sum(self.step(text[i : i + 2]) for i in range(len(text) - 1))


def readings(text: str, deep: bool = True) -> list[tuple[str, str]]:
    """Every other reading of ``text`` with its chain, by one chain or by two."""
    found: dict[str, str] = {}
    if not _RUN.search(text):
        return []
    for wrong, right in CHAINS if deep else _DOUBLE:
        new = reread(text, wrong, right)
        if new and new != text and new not in found and not any(ord(c) < 32 or unicodedata.category(c) in ("Cn", "Co") for c in new):
            found[new] = f"{wrong}>{right}"
    if deep:
        for new, chain in list(found.items()):
            if chain.endswith(">utf-8") and not new.isascii():
                for newer, more in readings(new, deep=False):
                    if newer != text:
                        found.setdefault(newer, f"{chain} {more}")
    return list(found.items())


def best_reading(text: str, model: CharModel) -> tuple[str, str, float] | None:
    """The likeliest other reading, its chain and by how much it beats the text as it stands."""
    options = readings(text)
    if not options:
        return None
    own = max(model.score(text), model.score(canonical_text(text)))
    score, new, chain = max((model.score(new), new, chain) for new, chain in options)
    return new, chain, score - own


def signs(text: str) -> Iterator[str]:
    """Characters that may be left of a wrong decoding: symbols, controls, and quotes and marks inside words."""
    for i, c in enumerate(text):
        if c.isascii() or c in "‘’":
            continue
        category = unicodedata.category(c)
        if category in ("So", "Sm", "Sc", "No", "Cc") or (category in ("Sk", "Pi", "Pf", "Ps") and i and text[i - 1].isalpha()):
            if c == _LOST or not unicodedata.normalize("NFKC", c).isalnum():
                yield c


def strangeness(text: str, model: CharModel) -> float:
    """How unlikely the least likely sign is among the characters of clean names, as a negative log probability; 0 without signs."""
    return max((model.surprise(kind(c)) for c in signs(text)), default=0.0)


def _words(text: str) -> list[str]:
    return re.split(r"([ \t\n\r]+)", text)


def restore(item: str, model: CharModel, margin: float) -> tuple[bool, str | None, str | None]:
    """Whether a name is garbled, its original where it can be restored, and the chain."""
    if item.isascii():
        return False, None, None
    bare = "".join(c for c in item if ord(c) < 256 or unicodedata.category(c) != "Cf")
    if _LOST not in bare:
        found = best_reading(bare, model)
        if found and found[2] > margin:
            return True, found[0], found[1]
        words, chains = _words(bare), []
        for i, word in enumerate(words):
            if not word.isascii() and (found := best_reading(word, model)) and found[2] > margin:
                words[i] = found[0]
                chains.append(found[1])
        if chains:
            text = "".join(words)
            return True, None if strangeness(text, model) > model.lost else text, chains[0]
    return strangeness(item, model) > model.lost, None, None


def _plain(name: str) -> bool:
    """Clean enough to learn from: no other reading, no sign of damage, no unusual characters."""
    return name.isascii() or not (_FOREIGN_RUN.search(name) or readings_possible(name) or any(signs(name)) or _MIXED.search(name) or unicodedata.normalize("NFKC", name) != name or any(unicodedata.category(c) in ("Cf", "Zs", "Mn") for c in name if not c.isascii()))


def readings_possible(name: str) -> bool:
    """Whether some chain to UTF-8 fits; by chance that happens to next to no clean name."""
    return bool(_RUN.search(name)) and any(right == "utf-8" and (new := reread(name, wrong, right)) is not None and new != name for wrong, right in CHAINS)


def held_out(name: str) -> bool:
    """Whether a clean name validates the margin; the same in every run and for every copy of the name."""
    return not name.isascii() and zlib.crc32(name.encode()) % HELD_OUT == 0


def count(records: DataFrame, authors: str) -> DataFrame:
    """``held, text, n``: the character pairs of the clean names that are learned from, and the names that are held out.

    Counted per task and combined in one small shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter[str] = Counter()
        held: Counter[str] = Counter()
        for batch in batches:
            names: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    names.update(name for name, _ in split_field(text, PLAIN_BLANKS))
            clean = {name: n for name, n in names.items() if _plain(name)}
            often: dict[int, list[str]] = defaultdict(list)  # names that occur equally often are counted together
            for name, n in clean.items():
                if not held_out(name):
                    often[n].append(name)
            for n, some in often.items():
                padded = "".join(f" {name} " for name in some)
                own = Counter(map("".join, zip(padded, padded[1:], strict=False)))
                own["  "] -= max(0, len(some) - 1)  # the seams, but for names that hold such a pair
                for pair, k in own.items():
                    pairs[pair] += k * n
            held.update({name: n for name, n in clean.items() if held_out(name)})
        pairs = +pairs
        yield pa.RecordBatch.from_arrays([pa.array([False] * len(pairs) + [True] * len(held), pa.bool_()), pa.array([*pairs, *held], pa.string()), pa.array([*pairs.values(), *held.values()], pa.int64())], names=["held", "text", "n"])

    found = records.select(authors).where(F.col(authors).isNotNull()).mapInArrow(run, "held boolean, text string, n long")
    return materialise(found.groupBy("held", "text").agg(F.sum("n").alias("n")))


def trained(counted: DataFrame) -> CharModel:
    """The model; what reaches the driver is one row per character pair, bounded by the alphabets and not by the rows."""
    return CharModel({r.text: r.n for r in counted.where("not held").collect() if len(r.text) == 2})


def _spoilt(name: str) -> Iterator[str]:
    """A name garbled by every chain that is possible for it, and by one pair of chains, a different one per name."""
    twice = zlib.crc32(name.encode()) // HELD_OUT % len(_DOUBLE) ** 2
    (first, _), (second, _) = _DOUBLE[twice // len(_DOUBLE)], _DOUBLE[twice % len(_DOUBLE)]
    for steps in [*([chain] for chain in CHAINS), [(first, "utf-8"), (second, "utf-8")]]:
        text = name
        try:
            for wrong, right in steps:
                text = garble(text, right, wrong)
        except (UnicodeError, KeyError):
            continue
        if text != name:
            yield text


def leads(name: str, model: CharModel) -> Iterator[tuple[bool, int]]:
    """Whether garbled, and by how many steps a reading leads: of a clean name, of it and of its words; of the name garbled by each chain.

    0 if none leads; a garbled name has a lead only if its likeliest reading is the name.
    """
    yield False, max(_steps(found[2]) if not x.isascii() and (found := best_reading(x, model)) else 0 for x in [name, *_words(name)])
    known: dict[str, int] = {}  # several chains often garble alike
    for text in _spoilt(name):
        if text not in known:
            found = best_reading(text, model)
            known[text] = _steps(found[2]) if found and found[0] == name else 0
        yield True, known[text]


def _steps(lead: float) -> int:
    return max(0, math.ceil(lead / STEP))


def losses(name: str, model: CharModel) -> Iterator[tuple[bool, int]]:
    """Whether characters were lost, and the strangeness in steps: of a clean name, and of it read as ASCII and as UTF-8 after each single-byte encoding."""
    yield False, _steps(strangeness(name, model))
    for text in {name.encode().decode("ascii", "replace"), *(name.encode(x, "ignore").decode("utf-8", "replace") for x in ("latin-1", "cp1250", "cp1251", "koi8_r"))}:
        if _LOST in text:
            yield True, _steps(strangeness(text, model))


def margin_from(tally: dict[tuple[bool, int], int]) -> float:
    """The margin with the fewest errors expected: clean names accepted and garbled names missed, by their shares. The least of equal ones, at least `LEAST`."""
    clean, garbled = (max(1, sum(n for (bad, _), n in tally.items() if bad == kind)) for kind in (False, True))

    def errors(margin: int) -> float:
        accepted = sum(n for (bad, lead), n in tally.items() if not bad and lead > margin)
        missed = sum(n for (bad, lead), n in tally.items() if bad and lead <= margin)
        return (1 - EXPECTED) * accepted / clean + EXPECTED * missed / garbled

    least = round(LEAST / STEP)
    return STEP * min(range(least, max([least, *(lead for _, lead in tally)]) + 1), key=lambda m: (errors(m), m))


def bound_from(tally: dict[tuple[bool, int], int]) -> float:
    """The strangeness above which characters count as lost, with the fewest errors expected; the middle of equal ones."""
    clean, lost = (max(1, sum(n for (bad, _), n in tally.items() if bad == kind)) for kind in (False, True))
    errors = [(1 - EXPECTED) * sum(n for (bad, x), n in tally.items() if not bad and x > m) / clean + EXPECTED * sum(n for (bad, x), n in tally.items() if bad and x <= m) / lost for m in range(1 + max([1, *(x for _, x in tally)]))]
    best = [m for m, e in enumerate(errors) if e == min(errors)]
    return STEP * best[len(best) // 2] if tally else CharModel.lost


def validated_margin(model: CharModel, clean: list[str]) -> float:
    """The margin for a model from names as they should be, which it was not trained on."""
    return margin_from(Counter(x for name in clean for x in leads(name, model)))


def tallies(names: DataFrame, model: CharModel) -> tuple[dict[tuple[bool, int], int], dict[tuple[bool, int], int]]:
    """How often each of `leads` and of `losses` occurs over all ``text`` of ``names``; one row per value reaches the driver."""
    shipped = names.sparkSession.sparkContext.broadcast(model.pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = CharModel(shipped.value), Counter()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                counts.update((False, *x) for x in leads(name, own))
                counts.update((True, *x) for x in losses(name, own))
        columns = list(zip(*counts, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["lost", "bad", "lead", "n"])

    found = spread(names.select("text")).mapInArrow(run, "lost boolean, bad boolean, lead long, n long")
    rows = found.groupBy("lost", "bad", "lead").agg(F.sum("n").alias("n")).collect()
    return tuple({(r.bad, r.lead): r.n for r in rows if r.lost == which} for which in (False, True))


def tally_leads(names: DataFrame, model: CharModel) -> dict[tuple[bool, int], int]:
    """The first of `tallies`."""
    return tallies(names, model)[0]


def fit(records: DataFrame, authors: str) -> tuple[CharModel, float]:
    """Train on the clean names but for a hash-chosen part, and validate margin and bound on all of that part, clean and damaged."""
    counted = count(records, authors)
    model = trained(counted)
    chains, lost = tallies(counted.where("held"), model)
    model.lost = bound_from(lost)
    return model, margin_from(chains)


def find_garbled(records: DataFrame, authors: str, model: CharModel, margin: float) -> DataFrame:
    """One row per garbled name: all other columns, ``position``, ``item``, ``restored`` (null if lost), ``chain``.

    Null, empty and ASCII fields give no rows; repeated rows stay repeated; fields are read whole. The
    model goes to the executors as one broadcast, bounded by the alphabets. No shuffle.
    """
    keep = [c for c in records.columns if c not in (authors, "position", "item", "restored", "chain")]
    shipped = records.sparkSession.sparkContext.broadcast((model.pairs, margin, model.lost))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, least, lost = shipped.value
        own = CharModel(pairs, lost=lost)
        for batch in batches:
            out = []
            known: dict[str, tuple] = {}  # names repeat
            for r, text in enumerate(batch.column(len(keep)).to_pylist()):
                for p, (item, _) in enumerate(split_field(text, PLAIN_BLANKS)):
                    if item.isascii():
                        continue
                    if item not in known:
                        known[item] = restore(item, own, least)
                    bad, restored, chain = known[item]
                    if bad:
                        out.append((r, p, item, restored, chain))
            index = pa.array([x[0] for x in out], pa.int64())
            columns = [batch.column(k).take(index) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([x[1] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.string()) for k in (2, 3, 4))], names=[*keep, "position", "item", "restored", "chain"]
            )

    odd = records.where(F.col(authors).rlike(QUICK + "|[\\u0080-\\u00bf\\u2000-\\u2bff\\ufffd]")).select(*keep, authors)
    return odd.mapInArrow(run, f"{kept}{', ' if kept else ''}position int, item string, restored string, chain string")


def p6_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled names with the original where it can be restored."""
    records = spread(table(spark, folder, "raw_records").select("line_no", "authors"))
    model, margin = fit(records, "authors")
    return find_garbled(records, "authors", model, margin)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that hold at least one garbled name."""
    return p6_restored(spark, folder).select("line_no").distinct()


QUERIES = {"p6_found": p6_found, "p6_restored": p6_restored}
