"""One form for texts that look the same.

Arrow text is copied into code-point arrays; every character is replaced by a
gather from lookup tables (expansion lengths and offsets), so full-width forms,
ligatures, look-alike letters, digits, spaces, hyphens, presentation forms and
invisible characters change without any per-row string call. Marks are then
ordered and composed by array rounds over all rows at once.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import checkpointed

TOP = 0x110000
#: Code points handled at once; bounds the memory of a batch, not the length of a text.
WINDOW = 1 << 20

# Letters that look like a Latin letter, by script, as look-alike then Latin.
CYRILLIC = "аaеeоoрpсcуyхxіiѕsјjһhԁdԛqԝwүyАAВBЕEКKМMНHОOРPСCТTУYХXІIЅSЈJԌGԚQԜWҮYӀI"
GREEK = "οoνvρpϲcϳjΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXϹCͿJ"
ARMENIAN = "օoսuոnհhցgզqՏSՕOԼLՍU"
OTHER = "ɑaɡgᴏoꓐBꓓDꓖGꓗKꓙJꓚCꓝFꓟMꓠNꓡLꓢSꓣR"
# Hyphens as short as "-".
HYPHENS = "‐‑‒−˗⁃﹣－"
# Arabic letters and the Persian form of the same letter.
ARABIC = "يیىیكکەهہهھه"
# Characters of category Cf that are seen, and ignorable ones of other categories.
SEEN_CF = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"
IGNORABLE = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
# Decompositions whose two sides do not look the same.
UNLIKE = ("<super>", "<sub>", "<circle>", "<fraction>", "<vertical>")


def _pairs(text: str) -> dict[str, str]:
    return dict(zip(text[::2], text[1::2]))


def look_alikes() -> dict[str, str]:
    return _pairs(CYRILLIC) | _pairs(GREEK) | _pairs(ARMENIAN) | _pairs(OTHER) | _pairs(ARABIC) | dict.fromkeys(HYPHENS, "-")


def _invisible(ch: str) -> bool:
    kind, cp = unicodedata.category(ch), ord(ch)
    return (kind == "Cf" and ch not in SEEN_CF) or (kind == "Cc" and ch not in "\t\n\x0b\x0c\x85") or any(a <= cp <= b for a, b in IGNORABLE)


class Tables:
    """Lookup tables over all code points, built once per process from the Unicode database."""

    def __init__(self) -> None:
        alike = look_alikes()
        self.length = np.ones(TOP, np.uint8)
        single = np.arange(TOP, dtype=np.uint32)
        self.ccc = np.zeros(TOP, np.uint8)
        longer: dict[int, list[int]] = {}
        pairs: dict[tuple[int, int], int] = {}
        chars = [chr(cp) for cp in (*range(0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE1000))]
        parts = {c: d for c in chars if (d := unicodedata.decomposition(c))}

        def spelt(ch: str) -> list[str]:
            if _invisible(ch):
                return []
            if unicodedata.category(ch) == "Zs":
                return [" "]
            if ch in "\x85  ":
                return ["\n"]
            if (digit := unicodedata.decimal(ch, None)) is not None:
                return [str(digit)]
            if (d := parts.get(ch)) and not d.startswith(UNLIKE):
                return [x for p in d.split() if p[0] != "<" for x in spelt(chr(int(p, 16)))]
            return [alike.get(ch, ch)]

        for ch in chars:
            cp = ord(ch)
            self.ccc[cp] = unicodedata.combining(ch)
            got = [ord(x) for x in spelt(ch)]
            if len(got) == 1:
                single[cp] = got[0]
            else:
                self.length[cp] = len(got)
                longer[cp] = got
            d = parts.get(ch, "")
            if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(p, 16) for p in d.split())
                pairs[ord(alike.get(chr(a), chr(a))), b] = ord(alike.get(ch, ch))
        for ch, d in parts.items():  # a composed look-alike, as ё: it must meet its Latin twin
            if d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(p, 16) for p in d.split())
                if chr(a) not in alike:
                    pairs[a, b] = ord(ch)
        self.start = np.zeros(TOP, np.uint32)
        self.start[:] = np.arange(TOP, dtype=np.uint32)
        flat = [single]
        at = TOP
        for cp, got in longer.items():
            self.start[cp] = at
            flat.append(np.array(got, np.uint32))
            at += len(got)
        self.flat = np.concatenate(flat)
        self.plain = (self.length == 1) & (single == np.arange(TOP)) & (self.ccc == 0)
        second = np.zeros(TOP, bool)
        second[[b for _, b in pairs]] = True
        second[0x1161:0x1176] = True
        second[0x11A8:0x11C3] = True
        self.joins = second | (self.ccc > 0)
        code = np.array([a * TOP + b for a, b in pairs], np.int64)
        order = np.argsort(code)
        self.pair, self.whole = code[order], np.array(list(pairs.values()), np.uint32)[order]

    def composed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Composite of each pair, 0 where there is none."""
        code = a.astype(np.int64) * TOP + b
        at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
        out = np.where(self.pair[at] == code, self.whole[at], 0).astype(np.uint32)
        a, b = a.astype(np.int64), b.astype(np.int64)
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b >= 0x11A8) & (b < 0x11C3)
        out = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, out)
        return np.where(lvt, a + b - 0x11A7, out).astype(np.uint32)


@functools.cache
def tables() -> Tables:
    return Tables()


def _compose(cps: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Marks put in canonical order and joined to their starters, all rows at once."""
    joins = t.joins[cps]
    if not joins.any():
        return cps, row
    first = np.empty(len(cps), bool)
    first[0] = True
    first[1:] = row[1:] != row[:-1]
    lead = ~joins | first
    run = np.cumsum(lead) - 1
    ccc = t.ccc[cps]
    if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:])).any():
        part = np.cumsum((ccc == 0) | first)  # marks move only between characters of class 0
        order = np.lexsort((ccc, part))
        cps, ccc = cps[order], ccc[order]
    cps = cps.copy()
    kept = np.ones(len(cps), bool)
    heads = np.flatnonzero(lead)
    sizes = np.diff(np.append(heads, len(cps)))
    long = np.flatnonzero(sizes > 1)
    star = heads.copy()  # place of each run's present starter
    high = np.zeros(len(heads), np.int16)  # class of the mark last kept after it; -1: a class 0 character
    k = 1
    while len(long):
        at = heads[long] + k
        who, cc = star[long], ccc[at].astype(np.int16)
        free = np.where(cc > 0, high[long] < cc, high[long] == 0) & (ccc[who] == 0)
        whole = np.where(free, t.composed(cps[who], cps[at]), 0)
        done = whole > 0
        cps[who[done]] = whole[done]
        kept[at[done]] = False
        rest = ~done
        new = rest & (cc == 0)
        star[long[new]] = at[new]
        high[long[new]] = 0
        marks = rest & (cc > 0)
        high[long[marks]] = cc[marks]
        k += 1
        long = long[sizes[long] > k]
    return cps[kept], row[kept]


def canonical_points(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points in the one form, with the row of each; CR LF counts as one line end."""
    t = tables()
    if t.plain[cps].all() and not (cps == 13).any():
        return cps, row
    cr = cps == 13
    if cr.any():
        lf = np.zeros(len(cps), bool)
        lf[:-1] = (cps[1:] == 10) & (row[1:] == row[:-1])
        cps = np.where(cr, 10, cps)[~(cr & lf)]
        row = row[~(cr & lf)]
    n = t.length[cps].astype(np.int64)
    begin = np.cumsum(n) - n
    place = np.repeat(t.start[cps].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(begin, n)
    cps, row = t.flat[place], np.repeat(row, n)
    return _compose(cps, row, t) if len(cps) else (cps, row)


def arrow_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the number of them before each text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    raw = np.frombuffer(data, np.uint8)
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    cps = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
    return cps, heads[offsets - offsets[0]]


def points_arrow(cps: np.ndarray, counts: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Texts of ``counts`` code points each; null where not ``valid``."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    total = np.concatenate([[0], np.cumsum(size)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    bits = np.packbits(valid, bitorder="little").tobytes()
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(total[ends].astype(np.int64).tobytes()), pa.py_buffer(data), pa.py_buffer(bits)).cast(pa.string())


def _windows(cps: np.ndarray):
    """Bounds of windows that begin before a character nothing joins onto."""
    a = 0
    while a < len(cps):
        b = min(a + WINDOW, len(cps))
        if b < len(cps):
            while b < len(cps) and not (0x20 <= cps[b] < 0x7F):
                b += 1
        yield a, b
        a = b


def canonical_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code points of all texts, and how many each text has."""
    cps, starts = arrow_points(texts)
    outs, counts = [], np.zeros(len(texts), np.int64)
    for a, b in _windows(cps):
        row = np.searchsorted(starts, np.arange(a, b), side="right") - 1 if b - a < 64 else np.repeat(np.arange(len(texts)), np.diff(np.clip(starts, a, b)))
        got, row = canonical_points(cps[a:b], row)
        outs.append(got)
        counts += np.bincount(row, minlength=len(texts))
    return (np.concatenate(outs) if outs else np.zeros(0, np.uint32)), counts


def canonical_batch(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.string())
    valid = np.asarray(texts.is_valid())
    if not valid.all():
        texts = texts.fill_null("")
    return points_arrow(*canonical_arrays(texts), valid)


@functools.cache
def _udf():
    @F.arrow_udf("string")
    def canonical(texts: pa.Array) -> pa.Array:
        return canonical_batch(texts)

    return canonical


def canonical_text(col: Column | str) -> Column:
    """The one form of a text column.

    Texts that look the same get equal results: forms that differ in width,
    encoding, script or ligature, single spaces, short hyphens, digits, and
    Arabic and Persian forms of one letter become one; invisible characters go;
    letters and marks are composed. Case, accents, punctuation, line breaks and
    runs of spaces stay. Null stays null, empty stays empty, and a text of only
    invisible characters becomes empty. Texts may have any length.
    """
    return _udf()(F.col(col) if isinstance(col, str) else col)


def look_alike_classes(documents: DataFrame, *, key: str, text: str) -> DataFrame:
    """Membership ``(form, spelling, key, representative)`` of texts that look like a text stored otherwise.

    ``form`` is the hash of the one form, ``spelling`` that of the stored
    characters, ``representative`` the least key of the spelling; a form counts
    only if it has several spellings. One row a document, however many look
    alike. Null texts are no case; repeated rows and keys count once.
    """
    rows = documents.select(F.col(key).alias("key"), F.md5(canonical_text(F.col(text))).alias("form"), F.md5(text).alias("spelling")).where("form is not null")
    rows = checkpointed(rows)  # hashes only; read twice below
    # forms of many documents are counted map-side: a header page copied all over is one row a task
    several = rows.groupBy("form").agg(F.min("spelling").alias("low"), F.max("spelling").alias("high")).where("low < high").select("form")
    members = rows.join(several, "form", "left_semi").distinct()
    first = members.groupBy("form", "spelling").agg(F.min("key").alias("representative"))
    return members.join(first, ["form", "spelling"])


def look_alike_pairs(documents: DataFrame, *, key: str, text: str) -> DataFrame:
    """Pairs ``(key_a, key_b)``, a before b, of texts that look the same and differ in stored characters; cases as in :func:`look_alike_classes`."""
    return class_pairs(look_alike_classes(documents, key=key, text=text))


def class_pairs(classes: DataFrame) -> DataFrame:
    """Pairs ``(key_a, key_b)``, a before b, of documents of one form and different spellings, from :func:`look_alike_classes`.

    Pairs are made between the spellings of a form, never within one; their
    number is that of the result.
    """
    classes = checkpointed(classes)
    kinds = classes.select("form", "spelling").distinct()
    two = kinds.select("form", F.col("spelling").alias("sa")).join(kinds.select("form", F.col("spelling").alias("sb")), "form").where("sa <> sb")
    left = classes.select("form", F.col("spelling").alias("sa"), F.col("key").alias("key_a"))
    right = classes.select("form", F.col("spelling").alias("sb"), F.col("key").alias("key_b"))
    return two.join(left, ["form", "sa"]).join(right, ["form", "sb"]).where("key_a < key_b").select("key_a", "key_b").distinct()
