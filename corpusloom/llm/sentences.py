"""Sentence units in any of the corpus's languages and scripts.

Characters are tagged as boundary or inside by a linear-chain model decoded
with Viterbi. Only places where a unit can end are open to both tags (after a
final mark and what closes with it, at line breaks, at spaces between Thai
letters); all others are inside. Weights are those of an averaged structured
perceptron, trained on a bounded sample of the texts themselves; how words begin,
end and follow each other is counted over all distinct texts. Where marks,
letter case or script leave little doubt they label a place for training, and
what they say is one feature among others: the model decodes every place. The
same sentences with their marks stripped, joined as their script joins them and
wrapped inside, teach it through how often a word begins or ends a sentence to
find boundaries no mark shows.

A paragraph is read once for its words, quotes and white space; what a place
needs of them is then looked up, so time grows with the length of the text.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import checkpointed, rows_within

#: Most counts of words and pairs that are sent to the executors whole, and texts that fetch theirs together.
COUNTS, GROUP = 200_000, 512

#: Weight of what rules say before training: they hold for what the sample does not show.
PRIOR = 6.0

# Marks that can end a sentence, the wide ones that need no white space, what opens and closes.
FINAL = ".!?…。！？।॥؟۔"
GLUED = "。！？।॥"
OPENERS = "\"'“‘„«‹([{「『（【〔《¿¡"
CLOSERS = "\"'”’“»›)]}」』）】〕》"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "〔": "〕", "《": "》"}
BRACKETS = ")]}）】〕"
DASHES = "-–—―"
# Abbreviations before a name or number, which never end a sentence.
LEADING = set(
    "mr mrs ms dr prof st vol fig figs p pp sec no nos vs cf approx ca nr abs hr fr art núm num pág pag sr sra sres srta dra mme mlle mm m n° env réf chap "
    "стр рис см гл г им тов проф डॉ श्री श्रीमती पृ".split()
)
# Abbreviations that may stand last in a sentence.
TRAILING = set("bzw ej ex jan feb mar apr jun jul aug sep sept oct nov dec".split())
# Abbreviations that end a sentence where a capital follows.
ENDING = set("inc ltd co corp jr etc usw gmbh cía am pm тд тп др".split())
# German months, which follow an ordinal number.
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

BREAK = r"\n\r \x85"
CANDIDATE = re.compile(
    rf"(?P<mark>[{re.escape(FINAL)}]+)(?P<close>(?:[   ]?[»›](?!\w)|[\"'”’“)\]}}」』）】〕》])*)(?P<gap>\s*)|(?P<line>\s*[{BREAK}]\s*)|(?<=[ก-ฺเ-๎])(?P<space>\s+)(?=[ก-ฺเ-๎])"
)
WORD = re.compile(r"[^\W_](?:[\w‌̀-ͯऀ-ःऺ-ॏ]|['’\-](?=\w))*")
LAST = re.compile(r"[\w‌̀-ͯऀ-ःऺ-ॏ'’\-]+")
LETTERS = re.compile(r"[^\W\d_]+")
NAME = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
FOLLOWS = re.compile(r"[^\W\d_]+(?=[\s,'’]|\.[\s.])")
DOTTED = re.compile(r"(?<![^\s(])(?:[^\W\d]\.\s?)+[^\W\d]")
LISTED = re.compile(rf"(?:^|[{BREAK}])\s*\(?(?:\d{{1,3}}|[a-zA-Z])(?=[{re.escape(FINAL)}])")
SOLID = re.compile(rf"[^{re.escape(FINAL)} \u00a0\u202f]+")
SPACES = re.compile(r"\s*")
INK = re.compile(r"\S+")
QUOTES = re.compile(r"[\"“”„«»‹›()\[\]{}「」『』（）【】〔〕《》]")
KERNEL = re.compile(rf"[^{re.escape(FINAL + CLOSERS)} \u00a0]+")
BULLET = re.compile(r"[-–•*·◦▪‣]\s")
NUMBER = re.compile(r"\(?(?:\d{1,3}|[०-९]{1,3}|[a-z])[.)]\s")


def script(ch: str) -> str:
    o = ord(ch)
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xFF66 <= o < 0xFFA0:
        return "han"
    if 0xE00 <= o < 0xE80:
        return "thai"
    return "cased" if ch.lower() != ch.upper() else "plain"


class Runs:
    """Where the matches of a pattern lie in a text, for looking up by position."""

    def __init__(self, pattern: re.Pattern, text: str) -> None:
        spans = [m.span() for m in pattern.finditer(text)]
        self.start, self.end = [a for a, _ in spans], [b for _, b in spans]

    def before(self, at: int) -> tuple[int, int] | None:
        """The part up to ``at`` of the last run that begins before it."""
        k = bisect_left(self.start, at) - 1
        return (self.start[k], min(self.end[k], at)) if k >= 0 else None

    def after(self, at: int) -> tuple[int, int] | None:
        """The part from ``at`` on of the first run that ends after it."""
        k = bisect_right(self.end, at)
        return (max(self.start[k], at), self.end[k]) if k < len(self.end) else None


class Outline:
    """What the places of a paragraph look up in it, each read once and only if asked for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.signs = {x: [m.start() for m in re.finditer(x, text)] if x in text else [] for x in "„“\""}
        spans = quoted(text)
        self.opened = {b: a for a, b in spans}
        self.covered: list[list[int]] = []  # merged spans, the opening sign left out
        for a, b in sorted(spans):
            if self.covered and a <= self.covered[-1][1]:
                self.covered[-1][1] = max(self.covered[-1][1], b)
            else:
                self.covered.append([a, b])

    words = functools.cached_property(lambda self: Runs(WORD, self.text))
    lasts = functools.cached_property(lambda self: Runs(LAST, self.text))
    letters = functools.cached_property(lambda self: Runs(LETTERS, self.text))
    names = functools.cached_property(lambda self: Runs(NAME, self.text))
    solid = functools.cached_property(lambda self: Runs(SOLID, self.text))
    ink = functools.cached_property(lambda self: Runs(INK, self.text))
    dotted = functools.cached_property(lambda self: Runs(DOTTED, self.text))
    listed = functools.cached_property(lambda self: {m.end() for m in LISTED.finditer(self.text)})

    def inside(self, end: int) -> bool:
        k = bisect_left(self.covered, [end]) - 1
        return k >= 0 and end <= self.covered[k][1]

    def count(self, sign: str, end: int) -> int:
        return bisect_left(self.signs[sign], end)

    def first_word(self, at: int) -> str:
        """The word beginning at or after ``at``; of scripts without spaces its first two characters."""
        if not (run := self.words.after(at)):
            return ""
        a, b = run
        return self.text[a : min(b, a + 2)] if script(self.text[a]) in ("han", "thai") else self.text[a:b]

    def last_word(self, end: int) -> str:
        """The word ending at ``end``."""
        run = self.lasts.before(end)
        if not run or run[1] != end:
            return ""
        if script(self.text[end - 1]) in ("han", "thai"):
            return self.text[max(run[0], end - 2) : end].lstrip("'’-")
        return self.text[run[0] : end].lstrip("'’-")

    def abbreviation(self, end: int) -> tuple[int, int] | None:
        """Letters with points between them that end at ``end``."""
        if end < 2 or not (self.text[end - 2] == "." or (self.text[end - 2].isspace() and self.text[end - 3 : end - 2] == ".")):
            return None
        run = self.dotted.before(end)
        return run if run and run[1] == end and end - run[0] > 1 and self.text[end - 1].isalpha() else None

    def run_on(self, mark: int, stop: int) -> bool:
        """Does a capitalized word follow a plain word's point without a space?"""
        run = self.names.before(mark)
        if not run or run[1] != mark or (run[0] and not self.text[run[0] - 1].isspace()):
            return False
        first = re.split("['’\\-]", self.text[run[0] : mark])[0]
        return self.text[mark - 1].islower() and mark - run[0] > 2 and bool(first) and bool(FOLLOWS.match(self.text, stop)) and self.text[stop].isupper()


def quoted(text: str) -> list[tuple[int, int]]:
    """Spans from opening to closing sign of the matched quotes and brackets of a paragraph."""
    if not QUOTES.search(text):
        return []
    spans, stack, waiting = [], [], Counter()  # signs that would close something open

    def push(at: int, close: str) -> None:
        stack.append((at, close))
        waiting.update(close)

    def pop() -> tuple[int, str]:
        waiting.subtract(stack[-1][1])
        return stack.pop()

    for m in QUOTES.finditer(text):
        ch, at = m.group(), m.start()
        if stack and ch in stack[-1][1]:
            spans.append((pop()[0], at))
        elif ch == '"':
            if at == 0 or not text[at - 1].isalnum():
                push(at, '"')
        elif ch in PAIRS:
            push(at, PAIRS[ch])
        else:
            while waiting[ch] > 0:  # what was opened since is never closed
                begin, close = pop()
                if ch in close:
                    spans.append((begin, at))
                    break
    return spans


class Place:
    """A place where a unit of a paragraph may end: units end at ``end``, the next begins at ``next``."""

    __slots__ = ("end", "next", "mark", "close", "kind", "features", "label", "own")

    def __init__(self, end: int, nxt: int, mark: str, close: str, kind: str) -> None:
        self.end, self.next, self.mark, self.close, self.kind = end, nxt, mark, close, kind
        self.features: list[str] = []
        self.label: int | None = None
        self.own = 0  # 1 where the inside pairs were counted from this very place


def places(text: str, outline: Outline | None = None) -> list[Place]:
    """All places of a paragraph in order, with their features and, where rules have one, their label."""
    o = outline or Outline(text)
    out = []
    for m in CANDIDATE.finditer(text):
        if m.group("mark"):
            gap, close = m.group("gap"), m.group("close")
            for sign, opens in (("“", o.count("„", m.start()) <= o.count("“", m.start())), ('"', o.count('"', m.start()) % 2 == 0)):
                if sign in close and opens and m.end("mark") + close.index(sign) not in o.opened:  # it belongs to what follows
                    close, gap = close[: close.index(sign)].rstrip(), ""
            stop = m.end("mark") + len(close)
            gap = gap or SPACES.match(text, stop).group()
            after = text[stop : stop + 1]
            if not gap and after and not (m.group("mark")[-1] in GLUED or (close and close[-1] in "”」』）】》") or after in "“„" or (m.group("mark")[-1] in "!?؟" and (script(after) != "cased" or after.isupper())) or o.run_on(m.start(), stop)):
                continue
            p = Place(stop, stop + len(gap), m.group("mark"), close.strip(), "line" if re.search(f"[{BREAK}]", gap) else "gap" if gap else "glued")
        else:
            p = Place(m.start(), m.end(), "", "", "line" if m.group("line") else "space")
        if p.end > 0 and p.next < len(text):
            _describe(o, p)
            if p.label is not None:
                p.features.insert(0, f"rule{p.label}")
            out.append(p)
    return out


def _describe(o: Outline, p: Place) -> None:
    text, n = o.text, p.next
    while n < len(text) and (text[n] in OPENERS or text[n] in DASHES or text[n].isspace()):
        n += 1
    after = text[n] if n < len(text) else ""
    kind = "e" if not after else "U" if after.isupper() or after.istitle() else "l" if after.islower() else "d" if after.isdigit() else {"han": "h", "thai": "t"}.get(script(after), "c") if after.isalpha() else "p"
    inside = o.inside(p.end)
    body = p.end  # where the text before the mark ends
    if p.mark:
        run = o.solid.before(p.end - len(p.close))
        body = run[1] if run else 0
    prev = o.last_word(body)
    first = o.first_word(p.next)
    bullet = bool(BULLET.match(text, p.next)) and p.kind == "line"
    item = NUMBER.match(text, p.next) if p.kind == "line" else None
    listing = text[item.end() : item.end() + 1] if item else ""
    number = bool(listing) and not listing.islower() and not listing.isdigit() and o.first_word(item.end()).casefold() not in MONTHS
    before = text[p.end - 1] if p.end else ""
    f = p.features
    f += ["bias", f"lex:{prev}>", f"next:{kind}"]
    if inside:
        p.label = 0
        f += ["inside", f"inside:{p.kind}"]
        return
    if p.mark:
        m = "…" if p.mark.startswith(("...", "…", "..")) else p.mark[-1]
        quote = ""
        if p.close:
            start = o.opened.get(p.end - 1)
            run = o.ink.before(start) if start is not None else None
            lead = text[run[1] - 1] if run else ""
            quote = "?" if start is None else ":" if lead in (":", "：") and lead else "^" if not lead or lead in FINAL + CLOSERS or re.search(f"[{BREAK}]", text[run[1] : start]) else "m"
            quote += "b" if p.close[-1] in BRACKETS else "q"
        token = re.split("['’]", prev.casefold().rstrip("."))[-1]
        dotted = o.abbreviation(body)
        if dotted and m == ".":
            token = re.sub(r"[\s.]", "", text[max(dotted[0], body - 24) : body])  # no abbreviation of the lists is longer
            token = "initials" if token.isupper() and kind == "U" else token.casefold()
        initial = len(token) == 1 and token.isalpha() and m == "."
        short = "title" if m == "." and (token in LEADING or token == "initials") else "end" if m == "." and token in ENDING else "tail" if m == "." and (token in TRAILING or dotted) else "one" if initial else "num" if token.isdigit() else "word"
        listed = m == "." and len(prev) < 4 and body in o.listed
        month = m == "." and short == "num" and first.casefold() in MONTHS
        dash = text[p.next] in DASHES and not bullet
        run = o.letters.before(body) if kind in ("h", "t", "c") else None
        switched = run is not None and script(text[run[1] - 1]) == "cased" and short not in ("title", "tail")
        f += [f"m:{m}|{quote}|{kind}|{p.kind}", f"m:{m}|{short}|{kind}|{listed}|{month}", f"q:{quote}|{kind}", f"s:{short}|{kind}", f"dash:{dash}|{kind}", f"bul:{bullet}{number}"]
        # what rules say
        if listed or month:
            p.label = 0
        elif bullet or number:
            p.label = 1
        elif kind in ("l", "p"):
            p.label = 0
        elif switched and p.kind != "glued":
            p.label = 1
        elif quote:
            caseless = kind in ("h", "t", "c")
            p.label = 1 if quote in (":q", ":b", "^b") else 1 if not caseless and kind == "U" else 0
            if kind == "p" or (kind == "d" and quote[0] == "m"):
                p.label = 0
        elif m == "…":
            p.label = 1 if kind == "U" or (p.kind == "line" and kind != "l") else 0
        elif m != ".":
            p.label = 1
        elif short in ("title", "one"):
            p.label = 0
        elif short == "end":
            p.label = 1 if kind != "d" else None
        elif short == "tail":
            p.label = None if kind != "d" else 0
        elif kind == "d":
            p.label = 1 if text[p.next] in OPENERS and short == "word" else (1 if number else None) if short == "word" and len(token) > 2 else 0
        else:
            p.label = 1
        f.append(f"first:{first}")
        if short == "tail":
            f += [f"tail:{token}|{kind}"]
    elif p.kind == "space":
        p.label = 1
        f.append("thai-space")
    else:
        sides = script(before) if before.isalpha() or unicodedata.category(before)[0] == "M" else "x"
        nxt = text[p.next]
        other = script(nxt) if nxt.isalpha() else "x"
        f += [f"nl:{kind}|{sides}|{other}", f"nl-bul:{bullet}", f"nl-num:{number}", "nl-comma" if before in ",;:،؛、，；-–" else "nl-plain"]
        if bullet or number:
            p.label = 1
        elif (sides == "han" and other == "han") or (sides == "thai" and other == "thai"):
            p.label = 1
        elif "thai" in (sides, other) and (before.isdigit() or nxt.isdigit() or "cased" in (sides, other)) and not number:
            p.label = 0
        elif kind == "l" or before in ",،、，":
            p.label = 0
        f += ["lexical", prev, first]


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches between blank lines; a unit never crosses one."""
    at = 0
    for m in re.finditer(rf"[{BREAK}]\s*[{BREAK}]\s*", text):
        if m.group().replace("\r\n", "\n").strip(" \t") == "\n" or m.group() == "\r\n":
            continue
        yield at, m.start()
        at = m.end()
    yield at, len(text)


class Model:
    """Weights of features and transitions, and how often words begin and end sentences."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.starts: dict[str, float] = {}
        self.ends: dict[str, float] = {}
        self.inside: dict[tuple[str, str], int] = {}

    def load(self, entries: Iterable[tuple[str, str, int, int, int]]) -> Model:
        """Take the counts of words and pairs as :func:`_entries` gives them."""
        for a, b, n, start, end in entries:
            if b:
                self.inside[a, b] = n
            else:
                self.starts[a] = math.log((start + 0.2) / (max(n - start, 0) + 0.2))
                self.ends[a] = math.log((end + 0.2) / (max(n - end, 0) + 0.2))
        return self

    def expanded(self, p: Place) -> list[str]:
        """The features of a place, its words replaced by classes of their counts."""
        f = [x for x in p.features if not x.startswith(("lex:", "first:"))]
        if "lexical" in f:
            at = f.index("lexical")
            prev, first = f[at + 1 : at + 3]
            del f[at:]
            e, s = self._class(self.ends, prev), self._class(self.starts, first)
            head = next(x for x in f if x.startswith("nl:"))
            seen = self.inside.get((prev, first if first in self.starts else "?"), 0) - p.own
            pair = "0" if seen < 1 else "1" if seen < 3 else "3" if seen < 10 else "10"
            f += [f"e{e}", f"s{s}", f"e{e}s{s}", f"{head}|s{s}", f"{head}|e{e}", f"pair{pair}", f"pair{pair}|s{s}", f"pair{pair}|e{e}", f"pair{pair}|{head}"]
        else:
            first = next((x[6:] for x in p.features if x.startswith("first:")), "")
            f.append(f"ms{self._class(self.starts, first)}")
            if any(x.startswith("tail:") for x in f):
                f.append(f"tail-s{self._class(self.starts, first)}")
        return f

    @staticmethod
    def _class(table: dict[str, float], word: str) -> str:
        if not word:
            return "-"
        odds = table.get(word)
        return "?" if odds is None else str(max(-4, min(4, round(odds))))

    def score(self, features: Iterable[str]) -> float:
        return sum(self.weight.get(x, 0.0) for x in features)

    def tags(self, text: str, spots: list[Place], features: list[list[str]], clamp: bool = False) -> list[int]:
        """Best sequence of tags by Viterbi; with ``clamp`` known labels are kept."""
        w, back = self.weight, []
        best = [0.0, -1e9]  # last tag inside, boundary; a paragraph begins as after a boundary
        best = [-1e9, 0.0]
        for p, f in zip(spots, features):
            s = self.score(f)
            row, new = [], []
            for tag in (0, 1):
                if clamp and p.label is not None and p.label != tag:
                    new.append(-1e9)
                    row.append(0)
                    continue
                both = [best[q] + w.get(f"t{q}{tag}", 0.0) for q in (0, 1)]
                q = int(both[1] > both[0])
                new.append(both[q] + (s if tag else 0.0))
                row.append(q)
            back.append(row)
            best = new
        tag = int(best[1] > best[0])
        out = []
        for row in reversed(back):
            out.append(tag)
            tag = row[tag]
        return out[::-1]


def tally(texts: Iterable[str]) -> tuple[dict[str, Counter], list[tuple[str, list[Place]]]]:
    """Counts of how words begin (``s``), end (``e``) and follow each other inside sentences (``p``) at places beyond doubt, of all
    words (``w``) and of the words around doubtful line breaks (``b``), by pairs of words; and the paragraphs seen."""
    got, seen = {k: Counter() for k in "wsepb"}, []
    for text in texts:
        for a, b in paragraphs(text):
            para = text[a:b].strip()
            if not para:
                continue
            o = Outline(para)
            spots = places(para, o)
            seen.append((para, spots))
            last, gone = "", 0
            for m in WORD.finditer(para):
                w = m.group()
                w = w[:2] if script(w[0]) in ("han", "thai") else w
                got["w"][w, ""] += 1
                if para[gone : m.start()] == " ":
                    got["p"][last, w] += 1
                last, gone = w, m.end()
            sure = [p for p in spots if p.label == 1 and p.kind != "space"]
            kernel = Runs(KERNEL, para)
            firsts = [o.first_word(0), *[o.first_word(p.next) for p in sure]]
            got["s"].update((x, "") for x in firsts if x)
            tails = [run[1] for end in [*(p.end for p in sure), len(para)] if (run := kernel.before(end))]
            got["e"].update((x, "") for t in tails if (x := o.last_word(t)))
            got["b"].update(_around(p) for p in spots if p.label is None and not p.mark and "lexical" in p.features)
    return got, seen


def _around(p: Place) -> tuple[str, str]:
    at = p.features.index("lexical")
    return p.features[at + 1], p.features[at + 2]


def wanted(spots: Iterable[Place]) -> set[tuple[str, str]]:
    """The words, and pairs of words, whose counts the features of places are made of."""
    out = set()
    for p in spots:
        if "lexical" in p.features:
            prev, first = _around(p)
            out |= {(prev, ""), (first, ""), (prev, first), (prev, "?")}
        else:
            out |= {(x[6:], "") for x in p.features if x.startswith("first:")}
    return out


def _local(got: dict[str, Counter]) -> list[tuple[str, str, int, int, int]]:
    """Counts of words used more than once and of pairs, as :func:`_entries` gives them."""
    out = [(w, "", n, got["s"][w, ""], got["e"][w, ""]) for (w, _), n in got["w"].items() if n > 1]
    known, pairs = {x[0] for x in out}, Counter()
    for (a, b), n in got["p"].items():
        pairs[a, b if b in known else "?"] += n
    return out + [(a, b, n, 0, 0) for (a, b), n in pairs.items()]


def wrap_share(model: Model, breaks: Counter) -> float:
    """Share of the doubtful line breaks between two words that also follow each other inside sentences."""
    known = sum(n for (_, first), n in breaks.items() if first in model.starts)
    wrapped = sum(n for (prev, first), n in breaks.items() if first in model.starts and model.inside.get((prev, first), 0) > 2)
    return (wrapped + 0.5) / (known + 1)


def stripped(seen: list[tuple[str, list[Place]]], share: float) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Paragraphs without their final marks, sentences joined by line breaks and some lines wrapped: text and (place, tag).

    Before small letters, which begin no sentence, every fifth space is made a
    break; before others as many as ``share`` of the breaks seen are wraps.
    """
    per_end = sum(len(p.split(" ")) for p, _ in seen) / max(1, sum(1 for _, s in seen for x in s if x.label == 1))
    others = min(200, int(1000 * share / (1 - share) / max(per_end, 1)))
    for k, (para, spots) in enumerate(seen):
        cuts = [p for p in spots if p.label == 1 and not p.close]
        parts, at = [], 0
        for p in [*cuts, None]:
            piece = para[at : p.end if p else len(para)].strip()
            if not p or p.mark:
                piece = piece.rstrip(FINAL)
            if piece:
                parts.append(piece)
            at = p.next if p else at
        if len(parts) < 2 or any(re.search(f"[{BREAK}]", x) for x in parts):
            continue
        out, marks, n = [], [], 0
        for i, piece in enumerate(parts):
            words = piece.split(" ")
            for j, w in enumerate(words):
                n += len(w)
                out.append(w)
                if j + 1 < len(words):
                    wrap = (k * 131 + i * 71 + j * 31) % 1000 < (200 if words[j + 1][:1].islower() else others)
                    out.append("\n" if wrap else " ")
                    if wrap:
                        marks.append((n, 0))
                    n += 1
            if i + 1 < len(parts):
                thai = script(piece[-1]) == script(parts[i + 1][0]) == "thai"
                out.append(" " if thai else "\n")
                marks.append((n, 1))
                n += 1
        yield "".join(out), marks


def fit(texts: list[str], rounds: int = 5, share: float | None = None, fetch: Callable[[set[tuple[str, str]]], Iterable[tuple]] | None = None) -> Model:
    """A model trained on texts in a fixed order; the same texts give the same model.

    ``share`` and ``fetch`` give the share of wrapped lines and the counts of
    wanted words and pairs in a larger collection; else the texts are counted.
    """
    model = Model()
    got, seen = tally(texts)
    if fetch is None:
        model.load(_local(got))
        share = wrap_share(model, got["b"])
    given = [(para, spots) for para, spots in seen if spots]
    for text, marks in stripped(seen, share):
        truth = dict(marks)
        spots = [p for p in places(text) if p.end in truth or p.label is not None]
        for p in spots:
            p.label = truth.get(p.end, p.label)
            p.own = int(truth.get(p.end) == 0)
        given.append((text, spots))
    if fetch is not None:
        model.load(fetch(wanted(p for _, spots in given for p in spots)))
    data = [(text, spots, [model.expanded(p) for p in spots]) for text, spots in given]
    total: dict[str, float] = defaultdict(float)
    step = 1
    model.weight = {"rule0": -PRIOR, "rule1": PRIOR} if data else {}
    for _ in range(rounds):
        for text, spots, features in data:
            got = model.tags(text, spots, features)
            if any(p.label is not None and p.label != g for p, g in zip(spots, got)):
                want = model.tags(text, spots, features, clamp=True)
                change: dict[str, float] = defaultdict(float)
                for tags, sign in ((want, 1.0), (got, -1.0)):
                    last = 1
                    for t, f in zip(tags, features):
                        change[f"t{last}{t}"] += sign
                        if t:
                            for x in f:
                                change[x] += sign
                        last = t
                for x, v in change.items():
                    model.weight[x] = model.weight.get(x, 0.0) + v
                    total[x] += step * v
            step += 1
    model.weight = {x: v - total[x] / step for x, v in model.weight.items()}
    return model


def units(text: str, model: Model) -> list[tuple[int, int]]:
    """Bounds of the sentence units of a text, white space at their ends left out."""
    out = []
    for a, b in paragraphs(text):
        para = text[a:b]
        lead = len(para) - len(para.lstrip())
        para = para.strip()
        if not para:
            continue
        spots = places(para)
        tags = model.tags(para, spots, [model.expanded(p) for p in spots])
        at = 0
        for p, t in zip(spots, tags):
            if t:
                out.append((a + lead + at, a + lead + p.end))
                at = p.next
        out.append((a + lead + at, a + lead + len(para)))
    return [(x, y) for x, y in out if y > x]


def _entries(texts: DataFrame) -> tuple[DataFrame, float]:
    """Counts ``(a, b, n, s, e)`` over all texts ``t``, and the share of wrapped lines.

    Words used more than once have ``b`` empty and how often they begin and end
    a sentence; pairs have both words, the second as ``?`` if used once only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, _ = tally(batch.column(0).to_pylist())
            rows = [(k, a, b, n) for k, table in got.items() for (a, b), n in table.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["kind", "a", "b", "n"])

    counts = checkpointed(texts.select("t").mapInArrow(count, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    own = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias({"w": "n"}.get(k, k))
    words = counts.where("kind in ('w', 's', 'e')").groupBy("a").agg(own("w"), own("s"), own("e")).where("n > 1")
    known = words.select(F.col("a").alias("b"), F.lit(True).alias("known"))
    pairs = counts.where("kind = 'p'").join(known, "b", "left").groupBy("a", F.when(F.col("known"), F.col("b")).otherwise("?").alias("b")).agg(F.sum("n").alias("n"))
    entries = checkpointed(words.select("a", F.lit("").alias("b"), "n", "s", "e").unionByName(pairs.select("a", "b", "n", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"))))
    breaks = counts.where("kind = 'b'").select("a", "b", F.col("n").alias("k")).join(known, "b").join(entries.where("b != '' and n > 2").select("a", "b", F.lit(1).alias("often")), ["a", "b"], "left")
    k, wrapped = breaks.agg(F.sum("k"), F.sum(F.col("k") * F.col("often"))).first()
    return entries, ((wrapped or 0) + 0.5) / ((k or 0) + 1)


def _texts(documents: DataFrame, text: str) -> DataFrame:
    """Every text ``t`` that is not blank, once."""
    return documents.select(F.col(text).cast("string").alias("t")).where("length(trim(t)) > 0").distinct()


def _fitted(documents: DataFrame, text: str, sample_rows: int) -> tuple[Model, DataFrame]:
    """The model fitted on at most ``sample_rows`` distinct texts, with the counts its own places want, and all counts."""
    texts = _texts(documents, text)
    entries, share = _entries(texts)
    picked = texts.withColumn("h", F.xxhash64("t")).orderBy("h", "t").limit(sample_rows).toArrow().column("t").to_pylist()

    def fetch(keys: set[tuple[str, str]]) -> Iterator[tuple]:
        table = pa.table({"a": pa.array([k[0] for k in keys], pa.string()), "b": pa.array([k[1] for k in keys], pa.string())})
        return map(_row, entries.join(documents.sparkSession.createDataFrame(table), ["a", "b"]).toArrow().to_pylist()) if keys else iter(())

    return fit(picked, share=share, fetch=fetch), entries


def _row(r: dict) -> tuple[str, str, int, int, int]:
    return r["a"], r["b"], r["n"], r["s"], r["e"]


def fit_sample(documents: DataFrame, *, key: str, text: str, sample_rows: int = 3000) -> Model:
    """The model with the counts of all texts, its weights fitted on at most ``sample_rows`` distinct texts, the first by a hash."""
    model, entries = _fitted(documents, text, sample_rows)
    return model.load(map(_row, entries.toArrow().to_pylist()))


def sentence_units(documents: DataFrame, *, key: str, text: str, model: Model | None = None, sample_rows: int = 3000, count_rows: int = COUNTS) -> DataFrame:
    """Sentence units ``(key, unit_no, start_char, end_char, sentence)`` of every text.

    Positions count characters from 0, the end exclusive, white space at either
    end left out. Without a model one is fitted: weights on a bounded sample, counts of
    words over all distinct texts. Counts of more than ``count_rows`` words and
    pairs are not sent to the executors; groups of texts fetch what they need.

    Defined cases: null, empty and blank texts have no units; repeated rows give
    theirs again; an empty table gives none; texts of any length are cut at
    blank lines first, so time grows with their length; other columns are
    ignored.
    """
    entries = None
    if model is None:
        model, entries = _fitted(documents, text, sample_rows)
        if rows_within(entries, count_rows):
            model.load(map(_row, entries.toArrow().to_pylist()))
            entries = None
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    shape = f"k {kind}, unit_no int, start_char int, end_char int, sentence string"

    def pieces(keys: pa.Array, texts: list[str], model: Model) -> pa.RecordBatch:
        who, no, start, end, piece = [], [], [], [], []
        for i, t in enumerate(texts):
            for j, (a, b) in enumerate(units(t, model)):
                who.append(i)
                no.append(j)
                start.append(a)
                end.append(b)
                piece.append(t[a:b])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(who, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(piece, pa.string())], names=["k", "unit_no", "start_char", "end_char", "sentence"])

    rows = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    if entries is None:
        sent = spark.sparkContext.broadcast(model)
        cut = rows.mapInArrow(lambda batches: (pieces(b.column(0), b.column(1).to_pylist(), sent.value) for b in batches), shape)
        return cut.withColumnRenamed("k", key)
    sent = spark.sparkContext.broadcast(model.weight)
    groups = max(spark.sparkContext.defaultParallelism, -(-rows.count() // GROUP))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("k", "t"), F.lit(groups)))

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = set()
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in paragraphs(t):
                    keys |= {(g, *x) for x in wanted(places(t[a:b].strip()))}
            keys = list(keys)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["g", "a", "b"])

    def cut_group(texts: pa.Table, counts: pa.Table) -> pa.Table:
        own = Model()
        own.weight = sent.value
        own.load(map(_row, counts.to_pylist()))
        return pa.Table.from_batches([pieces(texts.column("k").combine_chunks(), texts.column("t").to_pylist(), own)])

    found = rows.select("g", "t").distinct().mapInArrow(need, "g long, a string, b string").distinct().join(entries, ["a", "b"])
    return rows.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(cut_group, shape).withColumnRenamed("k", key)
