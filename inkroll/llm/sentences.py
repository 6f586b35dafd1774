"""Problem 9: sentence units in every language and script.

Layout comes first: blank lines, list marks, quoted lines and code blocks part the text, all with their
offsets. Inside a part, every end mark (in Thai, which has none, every blank) is tagged as boundary or
inside by a linear-chain model with Viterbi decoding; all other characters can only be inside.

The model is an averaged structured perceptron whose weights are trained when the query runs, on a bounded
sample of the documents. Its labels need no annotation: how often a word ends or starts a paragraph or list item,
in all documents, is known from the layout, and a mark between a word that can end and a word that can start a unit is a boundary. For scripts
without end marks, paragraphs are joined by blanks, marks removed, and the joints are the labels.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkroll.session import materialise, spread
from inkroll.sources.tables import table

#: Documents the weights are trained on, at most; the words of every document are counted and every document is segmented.
SAMPLE = 4000
#: Code points of a text of the sample, at most; longer ones are counted and segmented, but no weights are trained on them.
LONGEST = 20_000
#: Entries of the word counts of a task after which they are handed on.
FLUSH = 200_000
EPOCHS = 4

_MARK = re.compile(r"(?:[-*+•]|\d{1,9}[.)])[ \t]+(?=\S)|>")
_CODE_LINE = re.compile(r"(?: {4}|\t)[ \t]*\S")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_INLINE = re.compile(r"(`+)[^`\n](?:[^`]*?[^`])?\1(?!`)")
_URL = re.compile(r"(?:https?://|www\.)[!-~]+")
_URL_TAIL = re.compile(r"[.,;:!?…'\")\]}>]+$")
_URL_JOINED = re.compile(r"[.!?]+(?=[A-Z][a-z]*'?[a-z]*$)")
# Characters with the Unicode property Sentence_Terminal beyond the common ones; they end sentences only.
_TERMINAL = (
    "\u0589\u061d\u0700\u0701\u0702\u07f9\u0837\u0839\u083d\u083e\u0965\u104a\u104b\u1362\u1367\u1368\u166e\u1735\u1736\u17d4\u17d5\u1803\u1809\u1944\u1945\u1aa8"
    "\u1aa9\u1aaa\u1aab\u1b4e\u1b4f\u1b5a\u1b5b\u1b5e\u1b5f\u1b7d\u1b7e\u1b7f\u1c3b\u1c3c\u1c7e\u1c7f\u203c\u203d\u2047\u2048\u2049\u2cf9\u2cfa\u2cfb\u2e2e\u2e3c"
    "\u2e53\u2e54\ua4ff\ua60e\ua60f\ua6f3\ua6f7\ua876\ua877\ua8ce\ua8cf\ua92f\ua9c8\ua9c9\uaa5d\uaa5e\uaa5f\uaaf0\uaaf1\uabeb\ufe12\ufe15\ufe16\ufe52\ufe56\ufe57"
    "\uff0e\uff61\U00010a56\U00010a57\U00010f55\U00010f56\U00010f57\U00010f58\U00010f59\U00010f86\U00010f87\U00010f88\U00010f89\U00011047\U00011048\U000110be"
    "\U000110bf\U000110c0\U000110c1\U00011141\U00011142\U00011143\U000111c5\U000111c6\U000111cd\U000111de\U000111df\U00011238\U00011239\U0001123b\U0001123c\U000112a9"
    "\U0001144b\U0001144c\U000115c2\U000115c3\U00011641\U00011642\U0001173c\U0001173d\U0001173e\U00011944\U00011946\U00011a42\U00011a43\U00011a9b\U00011a9c\U00011c41"
    "\U00011c42\U00011ef7\U00011ef8\U00011f43\U00011f44\U00016a6e\U00016a6f\U00016af5\U00016b37\U00016b38\U00016b44\U00016e98\U0001bc9f\U0001da88"
)
_END = re.compile(f"[.!?…。！？।؟۔{_TERMINAL}]+")
#: Marks that are no part of words or numbers.
_ALWAYS = "。！？।؟!?" + _TERMINAL
_CLOSERS = "\"'”’»)]」』）›"
_SPANS = re.compile(r"“[^“”]*”|«[^«»]*»|„[^„“”]*[“”]|「[^「」]*」|『[^『』]*』|\"[^\"]*\"|(?<!\w)'(?=\S)(?:[^'\n]|\n(?!\n)|(?<=\w)'(?=\w))*'(?!\w)|\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]")
_LAST = re.compile(r"[^\s(\[{\"“«„‘'`（「『]*$")
_NEXT_WORD = re.compile(r"[^\W\d_](?:[^\W_]|['’_-](?=\w))*")
#: Scripts that part sentences by blanks: Thai, Lao, Khmer, Tai Tham.
_THAI = re.compile("[\u0e00-\u0eff\u1780-\u17d3\u17d7\u17dc-\u17ff\u19e0-\u19ff\u1a20-\u1aad]")
_BLANKS = re.compile(r"\s+")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_UNCASED = re.compile("[֐-෿฀-ჿ\u1200-\u139f\u1700-\u1c4f぀-鿿]")


def layout(text: str) -> list[tuple[int, int, bool, int]]:
    """The parts of a text: start, end, whether it is code, and where the text after a list mark starts."""
    parts: list[tuple[int, int, bool, int]] = []
    at, n = 0, len(text)
    open_at = body = -1  # paragraph
    code_at = code_end = -1  # indented block
    blank_before = True

    def flush(end: int) -> None:
        nonlocal open_at
        if open_at >= 0:
            parts.append((open_at, end, False, body))
        open_at = -1

    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        line = text[at:end]
        bare = line.strip()
        if code_at >= 0 and bare and not _CODE_LINE.match(line):
            parts.append((code_at, code_end, True, code_at))
            code_at = -1
        if not bare:
            flush(at)
            blank_before = True
            at = end + 1
            continue
        if code_at >= 0 or (blank_before and _CODE_LINE.match(line)):
            if code_at < 0:
                flush(at)
                code_at = at
            code_end = end
            at = end + 1
            continue
        fence = _FENCE.match(line)
        if fence:
            flush(at)
            sign = fence.group(1)
            stop = end + 1
            while stop < n:
                last = text.find("\n", stop)
                last = n if last < 0 else last
                row = text[stop:last].strip()
                stop = last + 1
                if row.startswith(sign) and not row.strip(sign[0]):
                    break
            stop = min(stop, n)
            parts.append((at, stop, True, at))
            at, blank_before = stop, True
            continue
        pre = line.find("<pre")
        if pre >= 0:
            if line[:pre].strip():
                if open_at < 0:
                    open_at = body = at
                flush(at + pre)
            else:
                flush(at)
            close = text.find("</pre>", at + pre)
            stop = n if close < 0 else close + 6
            parts.append((at + pre, stop, True, at + pre))
            at, blank_before = stop, True
            continue
        lead = at + len(line) - len(line.lstrip())
        mark = _MARK.match(text, lead, end)
        if mark and not (open_at >= 0 and text[lead].isdigit() and text[mark.end()].islower() and re.search(r"\d\.\s*$", text[open_at:at])):
            flush(at)
            open_at, body = at, mark.end()
        elif open_at < 0:
            open_at = body = at
        blank_before = False
        at = end + 1
    flush(n)
    if code_at >= 0:
        parts.append((code_at, code_end, True, code_at))
    return parts


def _mask(text: str) -> str:
    """Inline code and links with their marks hidden, at the same offsets."""
    if "`" in text:
        text = _INLINE.sub(lambda m: "`" + "x" * (len(m.group()) - 2) + "`", text)
    if "://" in text or "www." in text:

        def hide(m: re.Match) -> str:
            link = m.group()
            if joined := _URL_JOINED.search(link):
                return "x" * joined.start() + link[joined.start() :]
            tail = _URL_TAIL.search(link)
            return "x" * tail.start() + tail.group() if tail else "x" * len(link)

        text = _URL.sub(hide, text)
    return text


def _before(masked: str, at: int) -> str:
    """The word before a mark, in the form in which it is counted; words are told apart by their last 40 characters."""
    head = masked[max(0, at - 40) : at].rstrip()
    if not head:
        return "<start>"
    if head[-1] in "`":
        return "<code>"
    if head[-1] in _CLOSERS + "“":
        return "<close>"
    word = _LAST.search(head).group()
    if not word:
        return "<none>"
    if _CJK.match(word[-1]):
        return "<cjk>"
    if word.replace(".", "").replace(",", "").replace(":", "").isdigit():
        return "<n>"
    if any(c.isdigit() for c in word):
        return "<v>"
    if len(word) == 1:
        return "<I>" if word.isupper() else word
    if "." in word and re.fullmatch(r"[\w.-]+\.[a-z]{2,8}", word):
        return "<f>"
    return word


def _after(masked: str, at: int) -> str:
    """The word after a blank or mark, in the form in which it is counted."""
    if at >= len(masked):
        return "<end>"
    c = masked[at]
    if _THAI.match(c):
        return masked[at : at + 4]
    if _CJK.match(c):
        return masked[at : at + 2]
    if c.isdigit():
        return "<n>"
    if m := _NEXT_WORD.match(masked, at):
        word = m.group()
        return "<link>" if len(word) > 9 and not word.strip("x") else word
    return c


@dataclass
class Candidate:
    """A place where a unit may end: the end of the unit, the mark, its surroundings, where the next unit would start."""

    end: int
    start: int
    mark: str
    before: str
    after: str
    glued: bool
    closed: bool


def candidates(text: str, masked: str, a: int, b: int) -> list[Candidate]:
    """All places in text[a:b] at which a unit may end, but for its end itself. Inside quotations and brackets there are none."""
    part = masked[a:b]
    spans = [(m.start(), m.end()) for m in _SPANS.finditer(part)] if re.search(r"[\"'“«„「『(（\[]", part) else []
    starts = [s for s, _ in spans]
    out: list[Candidate] = []
    thai = len(_THAI.findall(part)) * 3 > len(part.replace(" ", ""))
    for m in _END.finditer(part):
        p, e = m.span()
        closed = False
        k = bisect_right(starts, p) - 1
        if k >= 0 and p < spans[k][1]:
            inner, stop = spans[k]
            rest = part[e:stop]
            if rest.strip(_CLOSERS + "“   "):
                continue
            e, closed = stop, True
        while e < len(part) and part[e] in "”’»)]」』）›":
            e, closed = e + 1, True
        after = _BLANKS.match(part, e)
        nxt = after.end() if after else e
        if nxt >= len(part):
            continue
        glued = not after
        mark = m.group()
        mark = "..." if len(mark) > 1 and set(mark) <= set(".…") or mark == "…" else mark[0] if mark[0] in ".。।" else mark[-1]
        before, following = _before(part, p), _after(part, nxt)
        if glued and mark in (".", "...") and not closed:
            c = part[nxt]
            if c.isdigit() or before in ("<I>", "<none>", "<start>") or c in ",;:-_/\\%=&@#*+":
                continue
        if glued and (part[nxt] in ",;:，、；：" or mark in "．﹒" and part[nxt].isdigit()):
            continue
        out.append(Candidate(a + e, a + nxt, mark, before, following, glued, closed))
    if thai:
        taken = {c.start for c in out}
        for m in _BLANKS.finditer(part):
            if 0 < m.start() and m.end() < len(part) and a + m.end() not in taken:
                k = bisect_right(starts, m.start()) - 1
                if k >= 0 and m.start() < spans[k][1]:
                    continue
                before = part[max(0, m.start() - 3) : m.start()]
                before = before if _THAI.match(before[-1]) else "<n>" if before[-1].isdigit() else "<code>" if before[-1] == "`" else "<lat>"
                following = _after(part, m.end())
                out.append(Candidate(a + m.start(), a + m.end(), "_", before, following if _THAI.match(following[0]) or following[0] in "<`" else "<lat>", False, False))
        out.sort(key=lambda c: c.end)
    return out


@dataclass
class SentenceModel:
    """What the documents say about words at the ends and starts of units, and the weights of the chain."""

    ends: Counter = field(default_factory=Counter)
    starts: Counter = field(default_factory=Counter)
    seen_before: Counter = field(default_factory=Counter)
    seen_after: Counter = field(default_factory=Counter)
    followed: Counter = field(default_factory=Counter)
    weights: dict[str, float] = field(default_factory=dict)

    def can_start(self, word: str, thai: bool = False) -> str:
        """start: known to start units; never: often seen after marks and never at a start; else its shape."""
        if not thai and (word == "<n>" or word[0] == "<" or not word[0].isalnum()):
            return "digit" if word == "<n>" else "start" if word[0] in "¿¡" else "sign"
        key = f"_{word}" if thai else word
        first, later = self.starts[key], self.seen_after[key]
        if first >= 2 and first >= 0.02 * (first + later):
            return "start"
        if later >= 4 and first == 0:
            return "never"
        if word == "<n>":
            return "digit"
        if word[0] == "<" or not word[0].isalnum():
            return "sign"
        if _UNCASED.match(word[0]):
            return "uncased"
        return "upper" if word[0].isupper() else "lower"

    def can_end(self, word: str) -> str:
        """abbr: never ends a unit; both: may; num, code, ...: by shape; word: an ordinary word."""
        if word in ("<n>", "<v>", "<f>", "<code>", "<close>", "<cjk>", "<none>", "<start>", "<lat>"):
            return word
        seen, last = self.seen_before[word], self.ends[word]
        follow = self.followed[word] / seen if seen else 1.0
        if word == "<I>":
            return "abbr"
        if seen >= 2 and last <= 0.02 * seen and follow <= 0.5:
            return "abbr"
        if seen < 2 and ("." in word and all(len(x) < 2 for x in word.split("."))):
            return "abbr"
        if seen >= 3 and follow <= 0.7:
            return "both"
        return "word"

    def label(self, c: Candidate) -> bool:
        """The label of a candidate in training: whether what comes before can end and what follows can start a unit."""
        if c.mark == "_":
            return self.can_start(c.after, True) == "start"
        start = self.can_start(c.after)
        if c.mark in _ALWAYS and c.mark != "..." and not c.closed:
            return not (start == "never" and c.after[0].islower())
        if c.closed or c.mark == "...":
            return start in ("start", "upper") or (start == "uncased" and c.mark in _ALWAYS and c.mark not in "!?") or (start in ("digit", "sign") and not c.closed)
        end = self.can_end(c.before)
        if c.glued:
            return start == "start" and (c.after[0].isupper() or end not in ("<n>", "abbr")) or (start == "upper" and end == "word" and len(c.after) > 1 and c.after[1:].islower() and not c.before[-1].isupper())
        if end == "abbr":
            return False
        if end == "<n>":
            return start in ("start", "upper", "uncased")
        if end == "both":
            return start in ("start", "upper")
        return start in ("start", "upper", "uncased", "digit", "sign") or (start == "never" and not c.after[0].islower() and c.after[0].isalpha() and end == "word")

    def features(self, c: Candidate) -> list[str]:
        thai = c.mark == "_"
        start, end = self.can_start(c.after, thai), "thai" if thai else self.can_end(c.before)
        glue = f"{'g' if c.glued else ''}{'c' if c.closed else ''}"
        low = "l" if c.after[0].islower() else "u" if c.after[0].isupper() else "o"
        return [f"a|{c.mark}|{end}|{start}|{glue}|{low}", f"b|{c.mark}|{start}|{glue}", f"c|{end}|{start}|{low}", f"d|{c.mark}|{c.before}", f"e|{c.mark}|{c.after}", f"f|{c.mark}"]

    def decode(self, cs: list[Candidate]) -> list[bool]:
        """The likeliest tags by Viterbi."""
        w = self.weights
        trans = [[w.get(f"t|{p}{q}", 0.0) for q in (0, 1)] for p in (0, 1)]
        score, back = (0.0, -1e9), []
        first = True
        for c in cs:
            emit = sum(w.get(x, 0.0) for x in self.features(c))
            if first:
                score, first = (0.0, emit), False
                back.append((0, 0))
                continue
            picks = []
            new = []
            for q in (0, 1):
                via = [score[p] + trans[p][q] for p in (0, 1)]
                p = int(via[1] > via[0])
                picks.append(p)
                new.append(via[p] + (emit if q else 0.0))
            back.append(tuple(picks))
            score = tuple(new)
        tags, q = [], int(score[1] > score[0])
        for picks in reversed(back):
            tags.append(bool(q))
            q = picks[q]
        return tags[::-1]


@dataclass
class Observed:
    """A part outside code: its bare text, whether it is Thai, its first word, its last one if marks follow, its candidates."""

    part: str
    thai: bool
    first: str
    last: str | None
    places: list[Candidate]


def observe(text: str) -> Iterator[Observed]:
    """All parts of a text that can be learned from."""
    masked = _mask(text)
    for _, b, code, body in layout(text):
        part = masked[body:b].rstrip()
        at = body + len(part) - len(part.lstrip())
        b = body + len(part)
        if code or at >= b:
            continue
        thai = len(_THAI.findall(part)) * 3 > len(part)
        tail = re.search(r"(.*?)[.…]+$", part[-40:], re.S)
        last = _before(part, len(part) - (len(part[-40:]) - tail.end(1))) if tail else None
        first = _after(masked[:b], at)
        yield Observed(part, thai, f"_{first}" if thai else first, last, candidates(text, masked, at, b))


def observations(seen: Observed) -> Iterator[tuple[str, str, str]]:
    """What a part adds to the counts: (start, word, ""), (end, word, ""), (after, word, "") and, at a full stop, (pair, word before, word after).

    Signs and numbers after a full stop can start a unit (open) or not (shut) whatever the counts: (open or shut, word before, "").
    """
    yield "start", seen.first, ""
    if seen.last is not None:
        yield "end", seen.last, ""
    for c in seen.places:
        if c.mark == "." and not c.glued and not c.closed:
            if c.after[0].isalnum():
                yield "pair", c.before, c.after
            else:
                yield "open" if c.after[0] in "¿¡" else "shut", c.before, ""
        else:
            yield "after", f"_{c.after}" if c.mark == "_" else c.after, ""


def count_words(parts: list[Observed]) -> SentenceModel:
    """The word counts of ``parts``, without weights."""
    model, pairs = SentenceModel(), Counter()
    for seen in parts:
        for kind, word, after in observations(seen):
            if kind in ("start", "end", "after"):
                {"start": model.starts, "end": model.ends, "after": model.seen_after}[kind][word] += 1
                continue
            model.seen_before[word] += 1
            if kind == "pair":
                pairs[word, after] += 1
                model.seen_after[after] += 1
            elif kind == "open":
                model.followed[word] += 1
    for (word, after), n in pairs.items():
        if model.can_start(after) == "start":
            model.followed[word] += n
    return model


def fit(texts: list[str], seed: int = 9, counted: SentenceModel | None = None) -> SentenceModel:
    """The model from raw texts alone, with the word counts of ``counted`` if given; the same texts give the same model."""
    seen = [part for text in texts for part in observe(text)]
    model = counted or count_words(seen)
    sequences = [x.places for x in seen]
    loose = [re.sub(r"[.!?…]+(?=\s|$)", "", x.part) for x in seen if x.thai and len(x.part) < 400]
    labelled = [(cs, [model.label(c) for c in cs]) for cs in sequences if cs]
    for i in range(0, len(loose) - 2, 3):  # unpunctuated text: paragraphs joined by blanks, the joints are boundaries
        joined, joints = "", set()
        for piece in loose[i : i + 3]:
            if joined:
                joined += " "
                joints.add(len(joined))
            joined += piece
        cs = candidates(joined, joined, 0, len(joined))
        if cs:
            labelled.append((cs, [c.start in joints or model.label(c) for c in cs]))
    rng, total, steps = random.Random(seed), defaultdict(float), 0
    model.weights = defaultdict(float)
    stamp: dict[str, int] = defaultdict(int)

    def bump(name: str, by: float) -> None:
        total[name] += (steps - stamp[name]) * model.weights[name]
        stamp[name] = steps
        model.weights[name] += by

    for _ in range(EPOCHS):
        rng.shuffle(labelled)
        for cs, gold in labelled:
            steps += 1
            tags = model.decode(cs)
            if tags == gold:
                continue
            for i, (c, t, g) in enumerate(zip(cs, tags, gold, strict=True)):
                if t != g:
                    for x in model.features(c):
                        bump(x, 1.0 if g else -1.0)
                if i and (tags[i - 1], t) != (gold[i - 1], g):
                    bump(f"t|{int(gold[i - 1])}{int(g)}", 1.0)
                    bump(f"t|{int(tags[i - 1])}{int(t)}", -1.0)
    for name in list(model.weights):
        bump(name, 0.0)
    model.weights = {k: v / steps for k, v in total.items() if v} if steps else {}
    return model


def segment(text: str | None, model: SentenceModel) -> list[tuple[int, int]]:
    """The units of a text, 0-based start and exclusive end, in order; null, empty and blank texts have none."""
    if not text or text.isspace():
        return []
    masked, units = _mask(text), []

    def add(a: int, b: int) -> None:
        piece = text[a:b]
        lead = len(piece) - len(piece.lstrip())
        if lead < len(piece):
            units.append((a + lead, a + len(piece.rstrip())))

    for a, b, code, body in layout(text):
        if code:
            add(a, b)
            continue
        part = masked[body:b].rstrip()
        lead = len(part) - len(part.lstrip())
        cs = candidates(text, masked, body + lead, body + len(part))
        at = a
        for c, cut in zip(cs, model.decode(cs) if cs else [], strict=True):
            if cut:
                add(at, c.end)
                at = c.end
        add(at, b)
    return units


def count_all(df: DataFrame, text: str) -> SentenceModel:
    """The word counts of all documents, combined per task, in one small shuffle of the words.

    Only words whose class differs from that of a word never seen reach the driver, with their exact counts, so
    every class is the same as with all counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = list(zip(*counts, strict=True)) or [(), (), ()]
            done = pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(counts.values()), pa.int64())], names=["kind", "word", "after", "n"])
            counts.clear()
            return done

        for batch in batches:
            for value in batch.column(0).to_pylist():
                for part in observe(value):
                    counts.update(observations(part))
                if len(counts) > FLUSH:
                    yield out()
        yield out()

    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    found = df.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "kind string, word string, after string, n long")
    counted = materialise(found.groupBy("kind", "word", "after").agg(F.sum("n").alias("n")))
    kind = F.col("kind")
    starts = counted.where("kind in ('start', 'after', 'pair')").groupBy(F.when(kind == "pair", F.col("after")).otherwise(F.col("word")).alias("after")).agg(total(kind == "start").alias("first"), total(kind != "start").alias("later"))
    told = materialise(starts.where("first >= 2 and first >= 0.0199 * (first + later) or first = 0 and later >= 4"))  # a little more than decides
    model = SentenceModel()
    for r in told.collect():
        model.starts[r.after], model.seen_after[r.after] = r.first, r.later
    openers = told.where((F.col("first") >= 2) & (F.col("first") >= F.lit(0.02) * (F.col("first") + F.col("later")))).select("after", F.lit(True).alias("opens"))  # as can_start has it
    ends = counted.where("kind in ('pair', 'open', 'shut', 'end')").join(openers, "after", "left")
    words = ends.groupBy("word").agg(total(kind != "end").alias("seen"), total(kind == "end").alias("last"), total((kind == "open") | (kind == "pair") & F.col("opens")).alias("followed"))
    dotted = F.col("word").rlike("^[^.]?(\\.[^.]?)+$")
    for r in words.where((F.col("seen") >= 2) & (dotted | (F.col("followed") <= 0.701 * F.col("seen")))).collect():
        model.seen_before[r.word], model.ends[r.word], model.followed[r.word] = r.seen, r.last, r.followed
    return model


def train(df: DataFrame, key: str, text: str, sample: int = SAMPLE) -> SentenceModel:
    """Words counted over all documents; weights from at most ``sample`` of them, those not above `LONGEST` with the smallest hashes of their keys."""
    rows = df.where(F.length(text) <= LONGEST).select(text, F.xxhash64(F.lit(9), F.col(key)).alias("_o")).orderBy("_o", text).limit(sample)
    return fit([r[0] for r in rows.collect()], counted=count_all(spread(df), text))


def sentences(df: DataFrame, text: str, model: SentenceModel) -> DataFrame:
    """One row per sentence unit: all other columns, ``sent_start`` and ``sent_end`` (code points).

    The units cover all of a text but white space, however long it is. Null, empty and blank texts give no
    rows; repeated rows stay repeated; input columns named like the new ones are replaced. No shuffle.
    """
    keep = [c for c in df.columns if c not in (text, "sent_start", "sent_end")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            index, starts, ends = [], [], []
            for r, value in enumerate(batch.column(len(keep)).to_pylist()):
                for a, b in segment(value, own):
                    index.append(r)
                    starts.append(a)
                    ends.append(b)
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keep))), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[*keep, "sent_start", "sent_end"])

    return df.select(*keep, text).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "sent_start bigint", "sent_end bigint"]))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """All sentence units of all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sentences(spread(docs), "text", train(docs, "doc_id", "text"))


QUERIES = {"p9_found": p9_found}
