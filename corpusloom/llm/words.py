"""Words of many texts at once as 64-bit hashes: the comparison form of passages."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from corpusloom.llm.canonical import CYRILLIC, TOP, canonical_arrays, tables

#: Bytes of text handled at once.
SLICE = 2 << 20


class Folding:
    """Tables for case, word characters and the script of letters that look alike."""

    def __init__(self) -> None:
        self.word = np.zeros(TOP, bool)
        self.cyrillic = np.zeros(TOP, bool)
        self.length = np.ones(TOP, np.uint8)
        flat = [np.arange(TOP, dtype=np.uint32)]
        self.start = np.arange(TOP, dtype=np.uint32)
        at = TOP
        for cp in (*range(0xD800), *range(0xE000, 0x32400)):
            ch = chr(cp)
            self.word[cp] = unicodedata.category(ch)[0] in "LN"
            if (low := ch.casefold()) != ch:
                self.length[cp], self.start[cp] = len(low), at
                flat.append(np.array([ord(x) for x in low], np.uint32))
                at += len(low)
        self.flat = np.concatenate(flat)
        latin = dict(zip(CYRILLIC[1::2], CYRILLIC[::2]))
        self.cyrillic[0x400:0x530] = True
        self.back = np.arange(TOP, dtype=np.uint32)
        for a, b in latin.items():
            self.back[ord(a)] = ord(b)
            for mark in "̆̈̀":
                one, two = unicodedata.normalize("NFC", a + mark), unicodedata.normalize("NFC", b + mark)
                if len(one) == len(two) == 1:
                    self.back[ord(one)] = ord(two)


@functools.cache
def folding() -> Folding:
    return Folding()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hashed(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and length of each word of the code points of several rows."""
    f = folding()
    word = f.word[cps]
    begin = word.copy()
    begin[1:] &= ~word[:-1] | (row[1:] != row[:-1])
    which = np.cumsum(begin)[word] - 1
    if not len(which):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cps, rows = cps[word], row[begin]
    n = which[-1] + 1
    native = np.zeros(n, bool)
    native[which[f.cyrillic[cps]]] = True  # such a word has letters no other script has
    cps = np.where(native[which], f.back[cps], cps)
    length = f.length[cps].astype(np.int64)
    if (length > 1).any():
        place = np.repeat(f.start[cps].astype(np.int64), length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        which = np.repeat(which, length)
        cps = f.flat[place]
    else:
        cps = f.flat[f.start[cps]]
    sizes = np.bincount(which, minlength=n)
    first = np.cumsum(sizes) - sizes
    inside = np.arange(len(which)) - first[which]
    total = np.add.reduceat(mixed(cps.astype(np.uint64) + np.uint64(1)) * _powers(1 << int(sizes.max()).bit_length())[inside], first)
    return mixed(total ^ sizes.astype(np.uint64)), rows, sizes


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and length of every word of every text (null: no words).

    A word is a run of letters and digits of the canonical text without case;
    look-alike letters follow the script of their word.
    """
    tables()
    cps, counts = canonical_arrays(texts.fill_null(""))
    ends = np.cumsum(counts)
    word, out, a = folding().word, [], 0
    while a < len(cps):
        b = min(a + (1 << 20), len(cps))
        while b < len(cps) and word[cps[b]] and word[cps[b - 1]]:
            b += 1
        row = np.repeat(np.arange(len(texts)), np.diff(np.clip(np.concatenate([[0], ends]), a, b)))
        out.append(_hashed(cps[a:b], row))
        a = b
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE`` bytes of text each, one row at least."""
    size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text)])
    part = (np.cumsum(size) - size) // SLICE
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)
