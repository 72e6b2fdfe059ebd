"""Text of scanned pages repaired into continuous paragraphs.

Page furniture is found by what repeats within a file: a printed number keeps
its distance to the page's own number, a head its letters. Words cut at line
ends are joined when the corpus knows them joined. Misread characters are
corrected by a noisy channel: the candidates of every word are all corpus words
it can be a reading of and the word itself, weighed by character confusion
probabilities (estimated from the corpus) times the likelihood of the corpus's
word pairs, and decoded by Viterbi over the words of a line. Counts are taken
without the occurrence at hand and less what misreadings of other words explain.

Rows are grouped by page only, and a page is cut into lines once; what a page
must know of its file or its neighbours comes to it through joins on file and
key or file and page, so a file of any size is never in one task. The lexicon
holds every word and pair used at least ``LEAST`` times, whatever the size of
the corpus: without the occurrence at hand, others have no count. It is sent to
the executors whole if counted to have at most ``LEXICON`` entries; else groups
of pages fetch the entries that their words need by a join on the words' forms.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import checkpointed, rows_within

#: Uses from which a word or pair counts as known, at every size: without the occurrence at hand a single one has none.
LEAST = 2
#: Misreadings allowed for above the expected number before a word counts as one, in general and with a sign or digit among its letters.
DOUBT, ODD_DOUBT = 20.0, 400.0
#: Uses supposed of a word never seen, and the chance that a word with such a sign is meant so.
UNSEEN, AS_MEANT = 0.001, math.log(1e-4)
#: Most entries of a lexicon that is sent to the executors whole.
LEXICON = 200_000
#: Pages that fetch their part of a larger lexicon together, and neighbouring pages of a file kept together.
GROUP, RUN = 128, 32

# What is read, and what it may stand for.
CONFUSED = (
    ("c", "e"), ("0", "o"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("@", "a"), ("5", "s"), ("8", "b"), ("f", "t"), ("b", "h"), ("q", "g"), ("9", "g"), ("6", "b"),
    ("ſ", "f"), ("ſ", "s"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("|", "l"), ("6", "é"), ("6", "ö"), ("6", "ó"), ("ii", "ü"), ("b", "ß"), ("m", "rn"), ("d", "cl"),
)
# Signs at the end of a line; the soft ones are never part of a word.
SIGNS = "-‐\xad¬"
SOFT = "\xad¬"
# Words before a printed page number, and what digits are misread as.
NUMBER_WORDS = r"(?:p|pp|page|seite|s|pag|pág|página|стр)"
DIGITS = {"l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "O": "0", "o": "0", "Q": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "g": "9", "q": "9", "b": "6", "ſ": "5"}

TOKEN = re.compile(r"(?:[^\W_]|[@|])+")
COMPOUND = re.compile(r"(?:[^\W_]|[@|])+(?:[-‐](?:[^\W_]|[@|])+)+")
ODD = re.compile(r"[@|ſ]|[^\W\d_]\d|\d[^\W\d_]")
BROKEN = re.compile(rf"((?:[^\W_]|[@|'’])+(?:[-‐](?:[^\W_]|[@|])+)*)([{SIGNS}])\s*$")
SINGLE = {}
for _a, _b in CONFUSED:
    if len(_a) == 1:
        SINGLE.setdefault(_a, _b)


@functools.lru_cache(maxsize=1 << 16)
def skeleton(word: str) -> str:
    """One form of all readings of a word: words that a misreading can turn into each other share it."""
    s = word
    for a, b in (("0", "o"), ("|", "l"), ("1", "l"), ("i", "l"), ("@", "a"), ("5", "s"), ("ſ", "f"), ("8", "b"), ("6", "b"), ("é", "b"), ("ö", "b"), ("ó", "b"), ("ß", "b"), ("9", "g"), ("q", "g"), ("b", "h"), ("t", "f"), ("e", "c"), ("s", "f")):
        s = s.replace(a, b)
    for a, b in (("d", "cl"), ("u", "ll"), ("ü", "ll"), ("m", "rn"), ("w", "vv")):
        s = s.replace(a, b)
    return s


def aligned(read: str, meant: str, cost: dict[tuple[str, str], float]) -> tuple[float, list[int]] | None:
    """Log probability of reading ``meant`` as ``read`` and the places misread, or None if impossible."""
    state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by place in meant
    states = [state] + [{} for _ in read]
    for i in range(len(read)):
        for j, (p, where) in states[i].items():
            if j < len(meant) and read[i] == meant[j] and (j + 1 not in states[i + 1] or states[i + 1][j + 1][0] < p):
                states[i + 1][j + 1] = (p, where)
            for n, m in ((1, 1), (2, 1), (1, 2)):
                if j + m <= len(meant) and i + n <= len(read) and (c := cost.get((read[i : i + n], meant[j : j + m]))) is not None:
                    q = p + c
                    if j + m not in states[i + n] or states[i + n][j + m][0] < q:
                        states[i + n][j + m] = (q, [*where, *range(i, i + n)])
    return states[len(read)].get(len(meant))


class Lexicon:
    """Corpus words and word pairs with their counts, and the channel estimated from them."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], total: int, cost: dict[tuple[str, str], float] | None = None) -> None:
        self.words, self.pairs, self.total = words, pairs, max(total, 1)
        self.by_form: dict[str, list[str]] = defaultdict(list)
        for w in words:
            self.by_form[skeleton(w)].append(w)
        self.cost = cost or self.costs(self.evidence([(w, words[w]) for w in group if len(w) > 1] for group in self.by_form.values()), self.letters(words.items()))
        self.uses: dict[str, float] = {}
        self.memo: dict[str, list] = {}
        self.choice: dict[str, list] = {}

    @classmethod
    def evidence(cls, groups: Iterable[list[tuple[str, int]]]) -> Counter:
        """How often each confusion seems to have happened, from groups of words of one form with their counts."""
        flat = dict.fromkeys(CONFUSED, math.log(0.01))
        seen: Counter = Counter()
        for group in groups:
            for w, n in group if len(group) > 1 else ():
                for c, m in group:
                    if m > 4 * n and (hit := aligned(w, c, flat)) and hit[1]:
                        seen.update(dict.fromkeys(cls.changes(w, c), n))
        return seen

    @staticmethod
    def letters(words: Iterable[tuple[str, int]]) -> Counter:
        """How often a word holds each letter that can be misread."""
        out: Counter = Counter()
        for w, n in words:
            for ch in set(w) & _MEANT:
                out[ch] += n
        return out

    @staticmethod
    def costs(seen: Counter, letters: Counter) -> dict[tuple[str, str], float]:
        return {k: math.log(min(0.05, max(0.002, (seen[k] + 1) / (letters[k[1][0]] + 200)))) for k in CONFUSED}

    @staticmethod
    def changes(read: str, meant: str) -> list[tuple[str, str]]:
        """The confusions that turn one word into the other, from left to right."""
        out, i, j = [], 0, 0
        while i < len(read) and j < len(meant):
            if read[i] == meant[j] and (read[i : i + 2], meant[j]) not in _KNOWN:
                i, j = i + 1, j + 1
                continue
            for n, m in ((2, 1), (1, 2), (1, 1)):
                if (k := (read[i : i + n], meant[j : j + m])) in _KNOWN:
                    out.append(k)
                    i, j = i + n, j + m
                    break
            else:
                return out
        return out

    def alternatives(self, word: str) -> list[tuple[str, float, list[int]]]:
        """All corpus words other than it that a lower-case word may stand for, with channel and misread places."""
        if word not in self.memo:
            found = ((c, aligned(word, c, self.cost)) for c in self.by_form.get(skeleton(word), ()) if c != word)
            self.memo[word] = [(c, *hit) for c, hit in found if hit and hit[1]]
        return self.memo[word]

    def options(self, word: str) -> list[tuple[str, float, list[int]]]:
        """What a lower-case word may stand for, itself first."""
        if word not in self.choice:
            out = [(word, AS_MEANT if odd(word) else 0.0, [])]
            if not word.isdigit():
                others = self.alternatives(word)
                # a word never seen but by misreading has the least chance there is: it loses to a word read as meant, so is no candidate beside one
                out += others if odd(word) else [x for x in others if self.supposed(x[0]) > UNSEEN]
                if not others and (plain := _plain(word, self.cost)):
                    out.append(plain)
            self.choice[word] = out
        return self.choice[word]

    def supposed(self, word: str) -> float:
        """Uses of a word beyond those that misreadings of other words explain."""
        if word not in self.uses:
            n = self.words.get(word, 0)
            if n:
                n -= (ODD_DOUBT if odd(word) else DOUBT) * sum(self.words[c] * math.exp(p) for c, p, _ in self.alternatives(word))
            self.uses[word] = max(n, UNSEEN)
        return self.uses[word]

    def known(self, word: str) -> int:
        """Count of the word, or of the word it is a misreading of."""
        own = self.words.get(word, 0)
        return own if self.supposed(word) >= 1 else max((self.words[c] for c, _, _ in self.alternatives(word)), default=own)

    def chance(self, before: str | None, word: str, here: bool, both: bool) -> float:
        """Log probability of a word after another; ``here`` and ``both``: the word, the pair is the occurrence at hand, which does not count."""
        uses = self.supposed(word)
        p = max(uses - here, UNSEEN) / self.total
        if before is not None and self.supposed(before) >= 1 and (n := self.pairs.get((before, word), 0)):
            p = 0.3 * p + 0.7 * max(n * uses / self.words.get(word, uses) - both, 0) / self.words[before]
        return math.log(p)


_KNOWN = set(CONFUSED)
_MEANT = {meant[0] for _, meant in CONFUSED}


def odd(word: str) -> bool:
    """Has a word signs or digits among its letters?"""
    return not word.isalpha() and ODD.search(word) is not None or "ſ" in word


def decoded(tokens: list[str], lex: Lexicon) -> list[tuple[str, list[int]]]:
    """What each token of a line stands for, and the places misread in it, by Viterbi over the candidates.

    Words with one candidate part a line: between two of them it is decoded by itself.
    """
    lattice = [lex.options(t.lower()) for t in tokens]
    out = [(options[0][0], options[0][2]) for options in lattice]
    k = 0
    while k < len(lattice):
        if len(lattice[k]) == 1:
            k += 1
            continue
        end = k
        while end < len(lattice) and len(lattice[end]) > 1:
            end += 1
        out[k:end] = _best_path(lattice[k - 1] if k else None, lattice[k:end], lattice[end] if end < len(lattice) else None, lex)
        k = end + 1
    return out


def _best_path(left: list | None, lattice: list[list], right: list | None, lex: Lexicon) -> list[tuple[str, list[int]]]:
    """The likeliest words of a stretch between two words known."""
    best, prev, back = [0.0], left or [(None, 0.0, [])], []
    for options in [*lattice, *([right] if right else [])]:
        row = []
        for w, (word, channel, _) in enumerate(options):
            scores = [best[i] + lex.chance(p[0], word, w == 0, w == 0 and i == 0) for i, p in enumerate(prev)]
            at = max(range(len(scores)), key=scores.__getitem__)
            row.append((scores[at] + channel, at))
        back.append(row)
        best, prev = [x for x, _ in row], options
    k = max(range(len(best)), key=best.__getitem__)
    out = []
    for options, row in zip(reversed([*lattice, *([right] if right else [])]), reversed(back)):
        out.append((options[k][0], options[k][2]))
        k = row[k][1]
    return out[::-1][: len(lattice)]


def _plain(word: str, cost: dict[tuple[str, str], float]) -> tuple[str, float, list[int]] | None:
    """A word of no known form with a sign or single digit among its letters, that sign read as a letter."""
    if len(word) < 4:
        return None
    at = [i for i, ch in enumerate(word) if ch in "@ſ|" or (ch in "0158" and 0 < i)]
    if not at or sum(ch.isdigit() for ch in word) > 1 or sum(ch.isalpha() and ch != "ſ" for ch in word) < len(word) - len(at):
        return None
    if any(word[i].isdigit() for i in at) and (len(word) < 5 or word[-1].isdigit() and len(word) < 6):
        return None
    meant = "".join(SINGLE.get(ch, ch) if i in at else ch for i, ch in enumerate(word))
    return meant, sum(cost[word[i], SINGLE[word[i]]] for i in at if word[i] in SINGLE), at


def restored(token: str, word: str) -> str:
    """A decoded word in the case of its token."""
    if token.lower() == word:
        return token
    if token.isupper() and len(token) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if token[:1].isupper() else word


# ---- page furniture


def unspaced(part: str) -> str:
    return part.replace(" ", "") if re.fullmatch(r"\S(?: \S)+", part) else part


def roman(s: str) -> int | None:
    s = s.lower().replace("1", "i").replace("|", "i")
    if not s or not re.fullmatch(r"c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", s):
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = sum(-value[a] if value[a] < value.get(b, 0) else value[a] for a, b in zip(s, s[1:] + " "))
    return total or None


def printed_number(part: str) -> list[tuple[str, int, bool]]:
    """Readings of a part of a line as a printed page number: style, value, whether anything marks it as one."""
    s = re.sub(r"(?<=\S) (?=\S(?: |$|\W))", "", part) if re.search(r"\d \d|^\W \S", part) else part
    m = re.fullmatch(rf"(?P<a>[\[(\-–—|]*)\s*(?P<w>{NUMBER_WORDS}\.?\s)?\s*(?P<n>[^\W_]+|[|!]+)\s*(?P<of>/\s*[^\W_]+)?\s*(?P<b>[\])\-–—|]*)", s.strip(), re.I)
    if not m:
        return []
    n, marked = m["n"], bool(m["w"] or m["of"] or (m["a"] and m["b"]))
    out = []
    plain = "".join(DIGITS.get(ch, ch) for ch in n)
    if plain.isdigit() and len(plain) < 6 and (re.search(r"\d", n) or len(n) < 4 or marked):
        out.append(("arabic", int(plain), marked))
    if len(n) < 9 and not n.isdigit() and (v := roman(n)):
        out.append(("roman", v, marked))
    return out


def edge_readings(line: str) -> tuple[str, str, list[tuple[str, int, bool]]]:
    """Head text, its style (``caps``, ``wide``, ``plain`` or none) and page number readings of a line."""
    raw = re.split(r"\s{2,}", line.strip())
    parts = [unspaced(p) for p in raw]
    if len(raw) == 1 and (found := printed_number(raw[0]) or printed_number(parts[0])):
        return "", "", found
    number: list[tuple[str, int, bool]] = []
    wide = any(a != b and len(b) > 1 and not re.search(r"\d", b) for a, b in zip(raw, parts))
    if len(parts) > 1:
        for at in (0, -1):
            if found := printed_number(parts[at]):
                number = found
                parts = parts[1:] if at == 0 else parts[:-1]
                break
    text = " ".join(parts)
    letters = re.sub(r"[^\w@]|\d", "", text)
    style = "wide" if wide else "caps" if letters and text.upper() == text and text.lower() != text and len(letters) > 5 else "plain"
    return text, style + ("+" if number else ""), number


def head_key(text: str) -> str:
    return skeleton(re.sub(r"[^\w@|]", "", text.lower()))


def page_lines(row: dict) -> list[tuple[int, int, str]]:
    """Block, line number and text of the lines of a page."""
    return list(zip(row["block_ids"], row["line_nos"], row["lines"].split("\n"))) if row["block_ids"] else []


EDGE = 3


def edge_lines(lines: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str, bool]]:
    """The first and last lines of a page that hold text, with ``top`` or ``bottom`` and whether text flows over them."""
    full = [x for x in lines if x[2].strip()]
    out = []
    for i, x in enumerate(full):
        if i < EDGE:
            out.append((*x, "top", i + 1 < len(full) and full[i + 1][2].lstrip()[:1].islower()))
        elif i >= len(full) - EDGE:
            out.append((*x, "bottom", not re.search(rf"(?:[.!?…:][\"'”’»)\]]*|\d[\W]*|[{SIGNS}])\s*$", full[i - 1][2])))
    return out


# ---- a page


def broken_word(line: str) -> tuple[str, str] | None:
    """Beginning of a word and the sign after it at the end of a line."""
    if line.rstrip()[-1:] not in SIGNS:
        return None
    m = BROKEN.search(line)
    if not m or not m.group(1)[-1:].isalpha() and m.group(1)[-1:] not in "@015":
        return None
    return m.group(1), m.group(2)


def is_split(begin: str, sign: str, end: str, lex: Lexicon) -> bool:
    """Is the sign between two parts of a word no part of it?"""
    if not end or not (end[0].islower() or end[0] in "@015ſ8"):
        return False
    if sign in SOFT:
        return True
    a, b = TOKEN.findall(begin.lower())[-1], end.lower()
    joined, tied = lex.known(a + b), lex.words.get(f"{a}-{b}", 0)
    if joined or tied:
        return joined >= tied
    # neither is known: a tie of two words stays, a piece of a word does not
    return not (lex.words.get(a, 0) > 1 and lex.words.get(b, 0) > 1 and len(b) > 3)


def ended(text: str) -> bool:
    """Does a text end with the end of a sentence, or with what leads to a list?"""
    return text.rstrip().rstrip("\"'”’»)]")[-1:] in ENDS


def tied_word(text: str) -> bool:
    """Does a text end with a letter and a hyphen?"""
    return text[-1:] in ("-", "‐") and text[-2:-1].isalpha()


# Fixed value: what ends a sentence or leads to a list.
ENDS = tuple(".!?…:。！？")


class Line:
    __slots__ = ("block", "no", "text", "gap")

    def __init__(self, block: int, no: int, text: str, gap: bool) -> None:
        self.block, self.no, self.text, self.gap = block, no, text, gap


def running_lines(lines: list[tuple[int, int, str]], furniture: set[tuple[int, int]]) -> list[Line]:
    out, gap, last = [], False, None
    for block, no, text in lines:
        if (block, no) in furniture:
            continue
        if not text.strip():
            gap = True
            continue
        out.append(Line(block, no, text.strip(), gap or (last is not None and last != block)))
        gap, last = False, block
    return out


def needed(lines: list[Line], before: str | None, after: str | None) -> set[tuple[str, str]]:
    """Forms of the words, and of the pairs of words, that the repair of a page can look up."""
    out: set[tuple[str, str]] = set()

    def tied(cut: tuple[str, str], follow: str | None) -> list[str]:
        m = TOKEN.match(follow or "")
        if not m:
            return []
        a, b = TOKEN.findall(cut[0])[-1], m.group()
        joined = [skeleton((a + b).lower()), skeleton(a.lower() + b.lower())]
        out.update((x, "") for x in (*joined, skeleton(a.lower()), skeleton(b.lower()), skeleton(f"{a.lower()}-{b.lower()}")))
        return joined[:1]

    if before is not None and lines and (cut := broken_word(before)):
        tied(cut, lines[0].text)
    for i, line in enumerate(lines):
        forms = [skeleton(t.lower()) for t in TOKEN.findall(line.text)]
        out.update((x, "") for x in forms)
        out.update(zip(forms, forms[1:]))
        if cut := broken_word(line.text):
            k = i + 1
            while k < len(lines) and not re.search(r"[^\W\d_]", lines[k].text):
                k += 1
            for joined in tied(cut, lines[k].text if k < len(lines) else after):
                out.update((x, joined) for x in forms[-2:-1])
    return out


def repaired(lines: list[Line], before: str | None, after: str | None, lex: Lexicon) -> tuple[list[tuple[int, int, str]], list[str], str | None]:
    """Noise of the running lines of a page, its repaired paragraphs, and what stands between the first of them
    and the last of the page before where that one runs on (null: it does not).

    ``before`` and ``after`` are the last and first running lines of the pages
    next to it: a word cut between pages is completed on the page where it
    begins and left out of the one where it ends.
    """
    noise, texts = [], []
    held, cut_before = 0, False  # length of the word's end taken from the beginning of the line by the one before
    if before is not None and lines and (cut := broken_word(before)):
        first = TOKEN.match(lines[0].text)
        if first and is_split(*cut, first.group(), lex):
            held, cut_before = first.end(), True
    for i, line in enumerate(lines):
        text, spans = line.text, [x for m in TOKEN.finditer(line.text) if (x := m.span())[0] >= held]
        tail, cut = "", broken_word(text)
        k = i + 1
        while cut and k < len(lines) and not re.search(r"[^\W\d_]", lines[k].text):
            k += 1
        follow = lines[k].text if k < len(lines) else after
        split = False
        if cut and follow is not None:
            m = TOKEN.match(follow)
            if m and is_split(*cut, m.group(), lex):
                split, tail = True, m.group()
                noise.append((line.block, line.no, "split_word"))
        tokens = [text[a:b] for a, b in spans]
        if split and tokens:
            tokens[-1] += tail
        words = decoded(tokens, lex) if tokens else []
        new, at = [], held
        for (a, b), token, (word, wrong) in zip(spans, tokens, words):
            if not wrong and not (split and b == spans[-1][1]):
                continue  # it stays as it stands
            for w in wrong:
                if a + w < b:
                    noise.append((line.block, line.no, "wrong_char"))
                elif k < len(lines):
                    noise.append((lines[k].block, lines[k].no, "wrong_char"))
            new += [text[at:a], restored(token, word)]
            at = b
        rest = text[at:]
        if split and rest:
            rest = rest.rstrip().rstrip(SIGNS)
        new.append(rest)
        texts.append("".join(new).strip())
        skip = tail if split else None
        held = len(skip) if skip and k == i + 1 else 0
        if skip and k < len(lines) and k > i + 1:
            lines[k].text = lines[k].text[len(skip) :].lstrip()
    parts: list[list[str]] = []
    for line, text in zip(lines, texts):
        if not text:
            continue
        last = parts[-1][-1] if parts else ""
        if parts and (not line.gap or (not ended(last) and text[:1].islower())):
            tied = tied_word(last) and text[:1].islower()
            parts[-1] += ["" if tied or text[:1] in ".,;:!?" else " ", text]
        else:
            parts.append([text])
    paragraphs = ["".join(p) for p in parts]
    glue = None
    if before is not None and lines and not ended(before):
        width = sorted(len(x.text) for x in lines)[len(lines) // 2]
        first = next((t for t in texts if t), "")
        tied = tied_word(before) and first[:1].islower()
        # a heading is short; a line of running text fills its width, whatever follows
        if tied or cut_before or first[:1].islower() or len(before) >= 0.7 * width:
            glue = "" if (tied and not cut_before) or first[:1] in ".,;:!?" else " "
    return sorted(set(noise)), paragraphs, glue


def page_noise_across(lines: list[Line], before: str | None, lex: Lexicon) -> list[tuple[int, int, str]]:
    """Wrong characters at the beginning of a page in a word begun on the page before."""
    cut = broken_word(before) if before is not None else None
    if not cut or not lines:
        return []
    first = TOKEN.match(lines[0].text)
    if not first or not is_split(*cut, first.group(), lex):
        return []
    begin = TOKEN.findall(cut[0])[-1]
    (_, wrong), = decoded([begin + first.group()], lex)
    return [(lines[0].block, lines[0].no, "wrong_char")] if any(w >= len(begin) for w in wrong) else []


# ---- Spark


def _pages(blocks: DataFrame) -> DataFrame:
    """One row a page: file, page, whether the file is scanned, its lines in reading order (each block once) and, if it is not, its blocks."""
    one = blocks.select("block_id", "source_id", "page", "block_no", F.col("text").cast("string").alias("text"), F.col("ocr_confidence").isNotNull().alias("scan")).where("block_id is not null")
    files = one.groupBy("source_id").agg(F.max("scan").alias("scanned"))
    pages = one.groupBy("source_id", "page").agg(F.collect_list(F.struct("block_no", "block_id", "text")).alias("blocks"))
    pages = pages.join(files, pages["source_id"].eqNullSafe(files["source_id"])).select(pages["source_id"], "page", "scanned", "blocks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("blocks")
            flat = column.flatten()
            no, ids, texts = (flat.field(k).to_pylist() for k in range(3))
            ends = np.cumsum([0, *column.value_lengths().to_pylist()]).tolist()
            out: list[list] = [[], [], [], []]
            for (a, b), scanned in zip(zip(ends, ends[1:]), batch.column("scanned").to_pylist()):
                own, nos, lines, done, plain = [], [], [], set(), []
                for k in sorted(range(a, b), key=lambda k: (no[k] is None, no[k] or 0, ids[k], texts[k] is None, texts[k] or "")):
                    if ids[k] in done:
                        continue
                    done.add(ids[k])
                    part = [x.rstrip("\r") for x in (texts[k] or "").split("\n")]
                    own += [ids[k]] * len(part)
                    nos += range(1, len(part) + 1)
                    lines += part
                    if not scanned and texts[k] is not None:
                        plain.append(texts[k])
                for col, value in zip(out, (own, nos, "\n".join(lines), plain)):
                    col.append(value)
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source_id", "page", "scanned")), *map(pa.array, out, kinds)], names=["source_id", "page", "scanned", "block_ids", "line_nos", "lines", "plain"])

    return pages.mapInArrow(cut, "source_id string, page int, scanned boolean, block_ids array<long>, line_nos array<int>, lines string, plain array<string>")


def _furniture(pages: DataFrame) -> DataFrame:
    """Lines of page furniture ``(source_id, page, block_id, line_no, noise_kind)`` of scanned files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                seen: Counter = Counter()
                for block, no, text, side, flows in edge_lines(page_lines(r)):
                    head, style, numbers = edge_readings(text)
                    for kind, value, marked in numbers:
                        rows.append((r["source_id"], r["page"], block, no, "number", f"{kind}:{value - (r['page'] or 0)}", "marked" if kind == "arabic" and (marked or head) else side, side, 0, False))
                    letters = len(re.sub(r"\W|\d", "", head))
                    if head and 4 < letters and len(head) < 90 and not re.search(r"[.,;:]$", head):
                        key = head_key(head)
                        rows.append((r["source_id"], r["page"], block, no, "head", key, style, side, seen[key], flows))
                        seen[key] += 1
            cols = list(zip(*rows)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()))], names=["source_id", "page", "block_id", "line_no", "what", "key", "style", "side", "nth", "flows"])

    shape = "source_id string, page int, block_id long, line_no int, what string, key string, style string, side string, nth int, flows boolean"
    found = checkpointed(pages.where("scanned").select("source_id", "page", *LINES).mapInArrow(read, shape))  # read by its keys, its files and itself
    plain = F.col("style") == "plain"
    keys = found.groupBy("source_id", "what", "key").agg(
        F.countDistinct("page").alias("n_pages"), F.count(F.when(F.col("style") == "marked", 1)).alias("n_marked"), F.count(F.when(~plain, 1)).alias("n_styled"), F.min(F.when(plain, F.col("page"))).alias("first_plain"), F.avg(F.col("flows").cast("int")).alias("flow"), F.countDistinct(F.when(F.col("page") % 2 == 0, F.col("page"))).alias("n_left")
    )
    files = found.groupBy("source_id").agg(F.countDistinct("page").alias("file_pages"), F.count(F.when((F.col("what") == "head") & ~plain, 1)).alias("file_styled"))
    joined = found.join(keys, ["source_id", "what", "key"]).join(files, "source_id")
    enough = F.greatest(F.lit(2.0), F.lit(0.12) * F.col("file_pages"))
    number = (F.col("what") == "number") & ((F.col("n_pages") >= enough) | ((F.col("n_pages") > 1) & (F.col("key").startswith("roman") | (F.col("n_marked") > 1))) | (F.col("style") == "marked"))
    # a name that opens its chapter returns as the head of right-hand pages; the file's title stands on left-hand or all pages
    later_left = F.col("n_left") - F.when(F.col("first_plain") % 2 == 0, 1).otherwise(0)
    first = plain & ~F.col("flows") & (F.col("side") == "top") & (F.col("page") == F.col("first_plain")) & (later_left <= 0)
    opening = first & ((F.col("nth") > 0) | (F.col("n_styled") == 0))
    # plain lines are heads only where the file sets its heads plain; a line that text flows over nearly always is none
    head = (F.col("what") == "head") & ((~plain & (F.col("style") != "plain+")) | ((F.col("style") == "plain+")) | (plain & (F.col("file_styled") < 2) & (F.col("n_pages") > 1) & (F.col("flow") < 0.7) & ~opening))
    return joined.where(number | head).select("source_id", "page", "block_id", "line_no", F.when(F.col("what") == "head", "running_head").otherwise("page_no").alias("noise_kind")).distinct()


def _counted(pages: DataFrame) -> DataFrame:
    """Counts ``(a, b, n)`` of words and ties (``b`` empty) and of pairs of the running text of all files."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            pairs: Counter = Counter()
            for page in batch.column(0).to_pylist():
                cut = False
                for text in page.split("\n"):
                    tokens = TOKEN.findall(text)
                    if not tokens:
                        cut = cut and not text.strip()
                        continue
                    low = [t.lower() for t in tokens]
                    begin, cut = int(cut), text.rstrip()[-1:] in SIGNS and broken_word(text) is not None
                    low = low[begin : len(low) - cut]
                    words.update(low)
                    pairs.update(zip(low, low[1:]))
                    if "-" in text or "‐" in text:
                        body = text[: text.rstrip().rfind(tokens[-1])] if cut else text
                        words.update(m.group().lower().replace("‐", "-") for m in COMPOUND.finditer(body))
            kept = [w for w in words if not w.isdigit()]
            a, b = [*kept, *(k[0] for k in pairs)], [*[""] * len(kept), *(k[1] for k in pairs)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array([*(words[w] for w in kept), *pairs.values()], pa.int64())], names=["a", "b", "n"])

    return pages.select("lines").mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _channel(entries: DataFrame) -> dict[tuple[str, str], float]:
    """The channel of a lexicon ``(fa, fb, a, b, n)`` that is not sent whole; only sums by confusion and letter reach the driver."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            groups = [[(x["a"], x["n"]) for x in g] for g in batch.column(0).to_pylist()]
            for (read, meant), n in Lexicon.evidence([x for x in g if len(x[0]) > 1] for g in groups).items():
                seen[read, meant] += n
            for ch, n in Lexicon.letters(x for g in groups for x in g).items():
                seen["", ch] += n
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["a", "b", "n"])

    groups = entries.where("fb = ''").groupBy("fa").agg(F.collect_list(F.struct("a", "n")).alias("words")).select("words")
    rows = groups.mapInArrow(judge, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return Lexicon.costs(Counter({(r["a"], r["b"]): r["n"] for r in rows if r["a"]}), Counter({r["b"]: r["n"] for r in rows if not r["a"]}))


def _formed(entries: DataFrame) -> DataFrame:
    """Entries ``(fa, fb, a, b, n)`` of a lexicon with the forms of their words."""

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [pa.array([skeleton(w) for w in batch.column(c).to_pylist()], pa.string()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*forms, *batch.columns], names=["fa", "fb", "a", "b", "n"])

    return entries.select("a", "b", "n").mapInArrow(form, "fa string, fb string, a string, b string, n long")


def _lexicon(entries: list[dict], total: int, cost: dict[tuple[str, str], float] | None = None) -> Lexicon:
    return Lexicon({r["a"]: r["n"] for r in entries if not r["b"]}, {(r["a"], r["b"]): r["n"] for r in entries if r["b"]}, total, cost)


def _running(r: dict) -> list[Line]:
    return running_lines(page_lines(r), {(m["block_id"], m["line_no"]) for m in r["marks"] or ()})


def _mended(rows: list[dict], lex: Lexicon | None) -> pa.RecordBatch:
    """Noise and paragraphs of pages; those of files not scanned need no lexicon."""
    out = []
    for r in rows:
        if not r["scanned"]:
            out.append((r["source_id"], r["page"], [], r["plain"], None))
            continue
        run = _running(r)
        across = page_noise_across(run, r["before"], lex)
        noise, paragraphs, glue = repaired(run, r["before"], r["after"], lex)
        out.append((r["source_id"], r["page"], [dict(zip(("block_id", "line_no", "noise_kind"), x)) for x in {*noise, *across}], paragraphs, glue))
    cols = list(zip(*out)) or [[]] * 5
    kind = pa.list_(pa.struct([("block_id", pa.int64()), ("line_no", pa.int32()), ("noise_kind", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), kind, pa.list_(pa.string()), pa.string()))], names=["source_id", "page", "noise", "paragraphs", "glue"])


LINES = ("block_ids", "line_nos", "lines")
MENDED = "source_id string, page int, noise array<struct<block_id:long,line_no:int,noise_kind:string>>, paragraphs array<string>, glue string"


def _fetched(full: DataFrame, entries: DataFrame, total: int) -> DataFrame:
    """Repaired pages where each group of pages fetches the entries of the lexicon that it needs."""
    spark = full.sparkSession
    entries = checkpointed(_formed(entries))
    cost = _channel(entries)
    groups = max(spark.sparkContext.defaultParallelism, -(-full.count() // GROUP))
    full = full.withColumn("g", F.pmod(F.xxhash64("source_id", F.floor(F.col("page") / RUN)), F.lit(groups)))

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list({(r["g"], *k) for r in batch.to_pylist() for k in needed(_running(r), r["before"], r["after"])})
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["g", "fa", "fb"])

    def mend(pages: pa.Table, lexicon: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_mended(pages.to_pylist(), _lexicon(lexicon.to_pylist(), total, cost))])

    keys = full.mapInArrow(need, "g long, fa string, fb string").distinct()
    found = keys.join(entries, ["fa", "fb"]).select("g", "a", "b", "n")
    return full.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(mend, MENDED)


def _repaired(blocks: DataFrame, lexicon_rows: int = LEXICON) -> tuple[DataFrame, DataFrame]:
    pages = checkpointed(_pages(blocks))  # read by the furniture, the lexicon and both repairs
    furniture = checkpointed(_furniture(pages))
    marks = furniture.groupBy("source_id", "page").agg(F.collect_set(F.struct("block_id", "line_no")).alias("marks"))
    known = pages.join(marks, ["source_id", "page"], "left")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lines = _running(r)
                lines = [x for x in lines if re.search(r"[^\W\d_]", x.text)]  # bare numbers carry no word over
                if lines:
                    rows.append((r["source_id"], r["page"] - 1, None, lines[0].text))
                    rows.append((r["source_id"], r["page"] + 1, lines[-1].text, None))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["source_id", "page", "before", "after"])

    sides = known.where("scanned and page is not null").select("source_id", "page", *LINES, "marks").mapInArrow(ends, "source_id string, page int, before string, after string")
    sides = sides.groupBy("source_id", "page").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    full = known.join(sides, ["source_id", "page"], "left")

    counted = checkpointed(_counted(pages))
    total = counted.where("b = ''").agg(F.sum("n")).first()[0] or 0
    entries = counted.where(F.col("n") >= LEAST)
    plain, scans = full.where("not scanned"), full.where("scanned")
    mended = plain.mapInArrow(lambda batches: (_mended(b.to_pylist(), None) for b in batches), MENDED)
    if rows_within(entries, lexicon_rows):
        lex = blocks.sparkSession.sparkContext.broadcast(_lexicon(entries.toArrow().to_pylist(), total))
        scans = scans.mapInArrow(lambda batches: (_mended(b.to_pylist(), lex.value) for b in batches), MENDED)
    else:
        scans = _fetched(scans, entries, total)
    return mended.unionByName(scans), furniture


def scanned_noise(blocks: DataFrame) -> DataFrame:
    """Noise of scanned pages: ``(block_id, line_no, noise_kind)``, one row per block, line and kind.

    Kinds: ``split_word``, ``wrong_char``, ``running_head`` and ``page_no``;
    lines are counted from 1 between line feeds. Input columns: ``block_id``,
    ``source_id``, ``page``, ``block_no``, ``text``, ``ocr_confidence``; a file
    with any confidence is scanned, others are left alone.

    Defined cases: null and blank texts have no noise; repeated rows count
    once; rows without ``block_id`` are ignored; blocks without ``block_no``
    come last on their page, and pages without number have no neighbours; an
    empty table gives no rows; other columns are ignored.
    """
    pages, furniture = _repaired(blocks)
    return pages.select(F.explode("noise").alias("x")).select("x.*").unionByName(furniture.select("block_id", "line_no", "noise_kind")).distinct()


def repaired_paragraphs(blocks: DataFrame) -> DataFrame:
    """Repaired text ``(source_id, page, para_no, text)``, a row a paragraph of a file; blocks of files not scanned come unchanged.

    A paragraph that runs over the ends of pages is one row, with the page it
    begins on and its number there, so rows are in reading order by page and
    number. Cases as in :func:`scanned_noise`; a paragraph is as long as the
    text runs on.
    """
    pages, _ = _repaired(blocks)
    pages = checkpointed(pages.select("source_id", "page", "paragraphs", "glue"))
    # a page that holds no more than a piece of one paragraph passes it on; the others begin one with their last
    flags = pages.where("page is not null").select("source_id", "page", (F.col("glue").isNotNull() & (F.size("paragraphs") < 2)).alias("through"), F.floor(F.col("page") / 1024).alias("bucket"))
    begins = F.when(~F.col("through"), F.col("page"))
    near = flags.withColumn("start", F.max(begins).over(Window.partitionBy("source_id", "bucket").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)))
    # over buckets of pages: few rows even of a file that holds a third of all pages
    far = flags.groupBy("source_id", "bucket").agg(F.max(begins).alias("last"))
    far = far.select(F.col("source_id").alias("s"), F.col("bucket").alias("b"), F.max("last").over(Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    starts = near.join(far, near["source_id"].eqNullSafe(far["s"]) & (near["bucket"] == far["b"])).select("source_id", "page", F.coalesce("start", "earlier").alias("start"))
    starts = starts.toDF("s", "p", "start")
    placed = pages.join(starts, pages["source_id"].eqNullSafe(starts["s"]) & (pages["page"] == starts["p"]), "left").drop("s", "p")
    n, runs_on = F.size("paragraphs"), F.col("glue").isNotNull() & F.col("start").isNotNull()
    pieces = placed.select("source_id", "page", "glue", "start", n.alias("n"), runs_on.alias("runs_on"), F.posexplode("paragraphs").alias("at", "text"))
    edge = (F.col("page").isNotNull()) & ((F.col("runs_on") & (F.col("at") == 0)) | (F.col("at") == F.col("n") - 1))
    inner = pieces.where(~edge).select("source_id", "page", F.col("at").alias("para_no"), "text")
    mine = pieces.where(edge).withColumn("joined", F.col("runs_on") & (F.col("at") == 0))
    parts = mine.groupBy("source_id", F.when(F.col("joined"), F.col("start")).otherwise(F.col("page")).alias("first")).agg(
        F.sort_array(F.collect_list(F.struct("page", "at", F.when(F.col("joined"), F.concat("glue", "text")).otherwise(F.col("text")).alias("text")))).alias("parts"),
        F.max(F.when(~F.col("joined"), F.col("at"))).alias("para_no"),
    )
    whole = parts.select("source_id", F.col("first").alias("page"), F.coalesce("para_no", F.lit(0)).alias("para_no"), F.ltrim(F.array_join("parts.text", "")).alias("text"))
    return inner.unionByName(whole)
