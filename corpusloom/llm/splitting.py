"""Oversized items cut into pieces at natural boundaries.

Balanced targets: the fewest pieces that can keep the limit are found by going
through the boundaries from the end, equal-length targets are placed for that
number, and each is snapped to the strongest boundary near it (paragraph, then
sentence, then word) from which the rest still fits. Pieces are planned with
room for the overlap with the piece before.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks that end a sentence before white space, those that need none, and what may follow them.
FINAL = ".!?…؟۔।॥。！？"
WIDE = "。！？"
CLOSERS = "\"'”’»)]}」』）】〕］》"
BLANK = re.compile(r"(?>\r\n|\n|\r)[^\S\r\n]*(?>\r\n|\n|\r)\s*")
SENTENCE = re.compile(rf"[{re.escape(FINAL)}][{re.escape(FINAL + CLOSERS)}]*\s+|[{WIDE}][{re.escape(FINAL + CLOSERS)}]*")
SPACE = re.compile(r"\s+")
LEVELS = ("paragraph", "sentence", "word", "none")
#: Items cut at once; bounds the memory of their pieces.
ITEMS = 256


class Cuts:
    """Places where a text may be cut at boundaries of one kind and the stronger ones.

    A boundary is the white space between two stretches, from ``begin`` to
    ``end``, and may be cut anywhere in it; pieces begin at ``end`` where they can.
    """

    def __init__(self, text: str, ends: set[int]) -> None:
        self.end = sorted((ends | {len(text) - len(text.lstrip())}).difference((0, len(text))))
        self.begin = []
        for e in self.end:
            while e and text[e - 1].isspace():
                e -= 1
            self.begin.append(e)
        self.tail = len(text.rstrip())

    def first(self, low: int) -> int:
        """The first place to cut at or after ``low``, white space at the text's end included."""
        at = bisect_left(self.end, low)
        return max(low, self.begin[at] if at < len(self.end) else self.tail)

    def near(self, target: int, low: int, high: int) -> int | None:
        """The end of a boundary nearest to ``target`` between ``low`` and ``high``."""
        at = bisect_left(self.end, target)
        return min((e for e in self.end[max(at - 1, 0) : at + 1] if low <= e <= high), key=lambda e: abs(e - target), default=None)


def boundaries(text: str) -> Iterator[Cuts]:
    """Places to cut between paragraphs, sentences and words, each kind with those of the stronger ones."""
    ends: set[int] = set()
    for mark in (BLANK, SENTENCE, SPACE):
        ends |= {m.end() for m in mark.finditer(text)}
        yield Cuts(text, ends)


def latest(cuts: Cuts | None, n: int, limit: int, overlap: int) -> list[int] | None:
    """For each number of pieces from 0 the earliest place from which so many can hold the rest, down to what one first piece holds.

    Pieces but the first leave room for the overlap where a boundary allows
    it. None if a stretch between boundaries exceeds the limit; without cuts
    the text is cut anywhere.
    """
    need, room = [n], limit - overlap if overlap < limit else 1
    while need[-1] > limit:
        last = need[-1]
        at = next((c for size in (room, limit) if (c := cuts.first(last - size)) < last), None) if cuts else last - room
        if at is None:
            return None
        need.append(at)
    return need


def split_text(text: str, limit: int = 2000, overlap: int = 200) -> tuple[str, list[tuple[int, int]]]:
    """The kind of boundary a text is cut at, and the bounds of its pieces.

    Without overlap the pieces are the text; each but the first begins up to
    ``overlap`` characters before the end of the one before, at a word where
    there is one, less where a stretch without boundary leaves no room.
    """
    n, kinds, level = len(text), [], 3
    if n <= limit:
        return "whole", [(0, n)]
    need = None
    for k, cuts in enumerate(boundaries(text)):
        kinds.append(cuts)
        if need is None and (need := latest(cuts, n, limit, overlap)) is not None:
            level = k
    need = need or latest(None, n, limit, overlap)
    m, edges = len(need), [0]
    for k in range(1, m):
        target, reach, low = n * k // m, n // m // 2, max(need[m - k], edges[-1] + 1)
        # the last piece that fits with its overlap, or the only one that fits at all
        high = max(low, edges[-1] + (limit if k == 1 else max(limit - overlap, 1)))
        near = (c.near(min(max(target, low), high), max(low, target - reach), min(high, target + reach)) for c in kinds[: level + 1])
        spot = next((c for c in near if c is not None), None)
        if spot is None:
            spot = next((c for x in kinds[: level + 1] if (c := x.near(min(max(target, low), high), low, high)) is not None), None)
        if spot is None:
            spot = low if level < 3 else min(max(target, low), high)
        edges.append(spot)
    pieces, words = [(0, (edges + [n])[1])], kinds[2].end
    for a, b in zip(edges[1:], [*edges[2:], n]):
        start = a
        if (room := min(overlap, limit - (b - a))) > 0:
            at = bisect_left(words, a - room)
            start = words[at] if at < len(words) and words[at] < a else max(a - room, 0)
        pieces.append((start, b))
    return LEVELS[level], pieces


SHAPE = "piece_no int, start_char int, end_char int, n_pieces int, cut_at string, piece string"


def split_items(items: DataFrame, *, keys: list[str], text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Pieces of the items longer than ``limit`` characters, with the keys given.

    Columns: the keys, ``piece_no`` from 0, ``start_char`` and ``end_char`` in
    the item, ``n_pieces``, ``cut_at`` (``paragraph``, ``sentence``, ``word``
    or ``none``: the strongest kind of boundary that alone keeps every stretch
    within the limit) and the ``piece``.

    Defined cases: an overlap not below the limit leaves one new character a
    piece at least; null, empty and short items give no rows; repeated rows
    give their pieces again; empty tables give none; columns other than the
    keys are ignored. Items are filtered before Python sees them.
    """
    names = [f"k{i}" for i in range(len(keys))]
    src = items.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).cast("string").alias("t")).where(F.length("t") > limit)
    types = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ITEMS):
                part = batch.slice(a, ITEMS)
                rows = []
                for i, t in enumerate(part.column(len(names)).to_pylist()):
                    level, pieces = split_text(t, limit, overlap)
                    rows += [(i, j, x, y, len(pieces), level, t[x:y]) for j, (x, y) in enumerate(pieces)]
                who, *cols = zip(*rows)
                own = [part.column(j).take(pa.array(who, pa.int64())) for j in range(len(names))]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, cols, kinds)], names=[*names, "piece_no", "start_char", "end_char", "n_pieces", "cut_at", "piece"])

    done = src.mapInArrow(cut, f"{types}, {SHAPE}")
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[c.split()[0] for c in SHAPE.split(", ")])
