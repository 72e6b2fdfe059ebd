"""Held-out passages inside a corpus.

Windows of the length of the smallest leak (twelve words; a whole shorter item
counts as none) are fingerprinted on both sides with a weighted SimHash of
their five-word shingles. An index of the items' fingerprints by ``radius + 1``
blocks guarantees every pair within ``radius`` bits; weighted-shingle
similarity of the windows then verifies each candidate, and equal words are
counted apart. Windows are as long as the leaks looked for, not as whole
items: a leaked part of an item is far from the item's own fingerprint.

Documents are read once per pass and never shuffled; the items' windows are
sent to the executors in passes of at most ``pass_windows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.words import mixed, slices, word_hashes

SHINGLE = 5
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Windows fingerprinted at once.
CHUNK = 1 << 15


def shingles(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight (letters in it) of the shingle beginning at each word but the last four."""
    n = len(words) - SHINGLE + 1
    total, weight = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(SHINGLE):
        total = total * STEP + words[k : k + n]
        weight += size[k : k + n]
    return mixed(total), np.minimum(weight, 255).astype(np.int16)


def fingerprints(hashes: np.ndarray, weight: np.ndarray, per: int) -> np.ndarray:
    """SimHash of each window of ``per`` consecutive shingles."""
    n = len(hashes) - per + 1
    out = np.zeros(max(n, 0), np.uint64)
    for a in range(0, n, CHUNK):
        b = min(a + CHUNK, n)
        part = np.ascontiguousarray(hashes[a : b + per - 1]).astype("<u8")
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        signed = (bits.astype(np.int16) * 2 - 1) * weight[a : b + per - 1, None]
        total = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(signed, axis=0, out=total[1:], dtype=np.int32)
        out[a:b] = np.packbits(total[per:] > total[:-per], axis=1, bitorder="little").view("<u8").ravel()
    return out


def windows(texts: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """Row, fingerprint, word hashes, shingle hashes and weights of all windows of the texts."""
    words, row, size = word_hashes(texts)
    per = window - SHINGLE + 1
    if len(words) < window:
        empty = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), empty, empty.reshape(0, window), empty.reshape(0, per), empty.reshape(0, per)
    at = np.flatnonzero(row[window - 1 :] == row[: len(row) - window + 1])
    hashes, weight = shingles(words, size)
    view = np.lib.stride_tricks.sliding_window_view
    return row[at], fingerprints(hashes, weight, per)[at], view(words, window), view(hashes, per), view(weight, per), at


class Index:
    """Fingerprints of the items' windows by block value."""

    def __init__(self, item: np.ndarray, mark: np.ndarray, words: np.ndarray, hashes: np.ndarray, weight: np.ndarray, radius: int) -> None:
        self.item, self.mark, self.words, self.hashes, self.weight, self.radius = item, mark, words, hashes, weight, radius
        self.bits = 64 // (radius + 1)
        self.blocks = []
        for b in range(radius + 1):
            key = self.key(mark, b)
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.blocks.append((order, np.searchsorted(key[order], np.arange((1 << self.bits) + 1)).astype(np.int32)))

    def key(self, mark: np.ndarray, b: int) -> np.ndarray:
        return ((mark >> np.uint64(b * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def near(self, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item window) at most ``radius`` bits apart, each once."""
        left, right = [], []
        for b, (order, first) in enumerate(self.blocks):
            key = self.key(mark, b)
            n = first[key + 1] - first[key]
            who = np.repeat(np.arange(len(mark)), n)
            what = order[np.repeat(first[key] - (np.cumsum(n) - n), n) + np.arange(len(who))]
            close = np.bitwise_count(mark[who] ^ self.mark[what]) <= self.radius
            who, what = who[close], what[close]
            for c in range(b):  # found by an earlier block
                new = self.key(mark[who], c) != self.key(self.mark[what], c)
                who, what = who[new], what[new]
            left.append(who)
            right.append(what)
        return np.concatenate(left), np.concatenate(right)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of paired windows."""
    same = a[:, :, None] == b[:, None, :]
    shared = (same.any(2) * wa).sum(1)
    return shared / np.maximum(wa.sum(1) + wb.sum(1) - (same.any(1) * wb).sum(1), 1)


def _id_type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def leaked_passages(documents: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, passage: str, window: int = 12, radius: int = 3, least: float = 0.8, pass_windows: int = 200_000) -> DataFrame:
    """Documents that hold passages of items: ``(doc_id, item_id, n_near, n_exact)``.

    ``n_near`` counts window pairs with a weighted-shingle similarity of
    ``least`` or more among those at most ``radius`` bits apart, ``n_exact``
    those with the same ``window`` words in a row; pairs with neither are left
    out. ``n_exact`` is complete, ``n_near`` is not: of simulated windows with
    one end word changed and a similarity of 0.8 or more, 3 bits find 22 %
    (mean distance 5.8 bits). Words are compared in canonical form
    without case, punctuation and white space.

    Defined cases: null, blank and short texts and passages match nothing;
    repeated rows of a document give its row again, repeated item rows count
    once; empty tables give no rows; other columns are ignored, whatever their
    names. Texts and passages may have any length.
    """
    spark = documents.sparkSession
    per = window - SHINGLE + 1
    source = items.select(F.col(item_id).alias("i"), F.col(passage).cast("string").alias("t")).where("i is not null and t is not null").distinct()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                got = windows(part.column(1), window)
                if len(got[0]):
                    row, mark, words, hashes, weight, at = got
                    rows = [np.ascontiguousarray(x[at]) for x in (words, hashes, weight)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(mark.view(np.int64)), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in rows)], names=["i", "mark", "words", "hashes", "weight"])

    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    shape = StructType([StructField("i", _id_type(items, item_id)), StructField("mark", LongType()), *(StructField(c, BinaryType()) for c in ("words", "hashes", "weight"))])
    marks = source.mapInArrow(marked, shape).dropDuplicates(["i", "words"])
    passes = max(1, -(-marks.count() // pass_windows))
    docs = documents.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).where("t is not null")
    result = StructType([StructField(doc_id, _id_type(documents, doc_id)), StructField(item_id, _id_type(items, item_id)), StructField("n_near", LongType()), StructField("n_exact", LongType())])
    out = None
    for k in range(passes):
        mine = marks.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == k).toArrow().combine_chunks()
        if not mine.num_rows and k < passes - 1:
            continue
        ids = mine.column("i").combine_chunks()
        wide = [np.frombuffer(b"".join(mine.column(c).to_pylist()), kind).reshape(-1, n) for c, kind, n in (("words", np.uint64, window), ("hashes", np.uint64, per), ("weight", np.int16, per))]
        sent = spark.sparkContext.broadcast((ids.dictionary_encode().dictionary, Index(np.asarray(ids.dictionary_encode().indices), np.asarray(mine.column("mark")).view(np.uint64), *wide, radius)))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, index = sent.value
            for batch in batches:
                for part in slices(batch, 1):
                    got = windows(part.column(1), window)
                    if not len(got[0]) or not len(index.mark):
                        continue
                    row, mark, words, hashes, weight, at = got
                    hits = []
                    for a in range(0, len(mark), CHUNK):
                        who, what = index.near(mark[a : a + CHUNK])
                        if len(who):
                            w = at[who + a]
                            exact = (words[w] == index.words[what]).all(1)
                            near = similarity(hashes[w], weight[w].astype(np.int64), index.hashes[what], index.weight[what].astype(np.int64)) >= least
                            keep = exact | near
                            hits.append(np.stack([row[who + a], index.item[what], near, exact], 1)[keep])
                    if hits and len(hits := np.concatenate(hits)):
                        pair, inverse = np.unique(hits[:, :2], axis=0, return_inverse=True)
                        sums = [np.bincount(inverse.ravel(), hits[:, c]).astype(np.int64) for c in (2, 3)]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(pair[:, 0])), names.take(pa.array(pair[:, 1])), *map(pa.array, sums)], names=result.names)

        found = docs.mapInArrow(search, result)
        out = found if out is None else out.unionByName(found)
    return out if passes == 1 else out.groupBy(doc_id, item_id).agg(F.sum("n_near").alias("n_near"), F.sum("n_exact").alias("n_exact"))
