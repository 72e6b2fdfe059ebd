"""Vector scalars, hash embeddings and exact top-k search in blocks of queries."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import normal_form

#: Queries searched in one pass over the vectors.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column) -> Column:
    """A vector scaled to length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine between -1 and 1; 0 for null, empty, zero or unequally long vectors."""
    n = norm(a) * norm(b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0)
    return F.coalesce(F.when(fits, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))), F.lit(0.0))


def truncated(v: Column, dimensions: int) -> Column:
    """The first dimensions of a nested embedding, scaled to length 1 again."""
    return l2_normalized(F.slice(v, 1, dimensions))


def int8_scale(v: Column) -> Column:
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when(F.size(v) > 0, F.when(top > 0, top).otherwise(F.lit(1.0)) / 127).otherwise(F.lit(1.0))


def int8_values(v: Column) -> Column:
    """Vector in whole steps of its scale, rounded half to even, from -127 to 127."""
    scale = int8_scale(v)
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x.cast("double") / scale).cast("int"))))


def from_int8(values: Column, scale: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double") * scale)


# ---- hash embeddings


@functools.lru_cache(maxsize=1 << 17)
def _slot(feature: str, dimensions: int) -> tuple[int, float]:
    value = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
    return value % dimensions, -1.0 if value >> 63 else 1.0


@functools.lru_cache(maxsize=1 << 16)
def _word(word: str, dimensions: int) -> tuple[tuple[int, float], ...]:
    """Weighted slots of a word: itself at 1, its three- and four-letter pieces at 0.35."""
    own = f"^{word}$"
    pieces = [(f"w:{word}", 1.0)] + [(f"c{n}:{own[i : i + n]}", 0.35) for n in (3, 4) for i in range(len(own) - n + 1)]
    return tuple((i, s * w) for f, w in pieces for i, s in (_slot(f, dimensions),))


def hash_embed(text: str, dimensions: int = 384) -> np.ndarray:
    """Signed feature hashing of words and letter pieces, scaled to length 1."""
    v = np.zeros(dimensions)
    for word in re.findall(r"[\w\-]+", normal_form(text).casefold()):
        for i, w in _word(word, dimensions):
            v[i] += w
    n = np.linalg.norm(v)
    return v / n if n else v


def hash_embedding(col: Column | str, dimensions: int = 384) -> Column:
    """Hash embedding of a text column; null gives null."""
    if dimensions < 32:
        raise ValueError("dimensions must be at least 32")

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else hash_embed(t, dimensions).astype(np.float32) for t in texts.to_pylist()], pa.list_(pa.float32()))

    return run(col)


def embedding(col: Column | str, embed: Callable[[list[str]], list[list[float]]]) -> Column:
    """Embedding by an injected batch function; null gives null."""

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        plain = texts.to_pylist()
        got = iter(embed([t for t in plain if t is not None]))
        return pa.array([None if t is None else list(next(got)) for t in plain], pa.list_(pa.float32()))

    return run(col)


def embedded_once(docs: DataFrame, text: str, out: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Rows with the embedding of their text, each different text embedded once; null gives null."""
    known = docs.select(text).where(F.col(text).isNotNull()).distinct().withColumn(out, embedding(text, embed))
    return docs.join(known, text, "left")


# ---- exact search


def _matrix(lists: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit rows of the vectors of a list column that are not null, empty, zero or of another width."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    if width is None:
        width = int(sizes.max(initial=0))
    at = np.flatnonzero(sizes == width) if width else np.zeros(0, np.int64)
    if not len(at):
        return at, np.zeros((0, width))
    x = np.asarray(lists.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(0.0)).reshape(-1, width)
    n = np.linalg.norm(x, axis=1)
    good = np.isfinite(n) & (n > 0)
    return at[good], x[good] / n[good, None]


#: Rows and queries of one matrix product; bounds memory, not results.
ROW_PART, QUERY_PART = 2048, 512


class Best:
    """The best rows of each of some queries among all a task has seen; ties, told to nine digits, by id."""

    def __init__(self, queries: int, n: int) -> None:
        self.n = n
        self.least = np.zeros(queries)
        self.query, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def offer(self, score: np.ndarray, ids: pa.Array, at: np.ndarray) -> None:
        """Scores of the queries with the rows ``ids[at]``."""
        least = self.least
        if score.shape[1] > 2 * self.n and not least.all():  # early parts: only their own best can stay
            least = np.maximum(least, np.partition(score, -self.n, axis=1)[:, -self.n])
        i, j = np.nonzero((score > 0) & (score >= least[:, None] - 1e-9))
        if not len(i):
            return
        new = ids.take(pa.array(at[j]))
        every = new if self.ids is None else pa.concat_arrays([self.ids, new])
        query, value = np.concatenate([self.query, i]), np.concatenate([self.score, score[i, j]])
        place = np.empty(len(every), np.int64)
        place[np.asarray(pa.compute.sort_indices(every))] = np.arange(len(every))
        order = np.lexsort((place, -value.round(9), query))
        query, value = query[order], value[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.n
        self.query, self.score, self.ids = query[keep], value[keep], every.take(pa.array(order[keep]))
        full = rank[keep] == self.n - 1
        self.least[self.query[full]] = self.score[full]


def top_k(queries: DataFrame, vectors: DataFrame, *, k: int, query_id: str = "query_id", query_vector: str = "vector", id_col: str = "doc_id", vector: str = "vector", keep_self: bool = True) -> DataFrame:
    """The ``k`` rows most similar to each query: ``(query_id, id, score, rank)``, scores above 0, ties by id.

    Queries are sent to the executors in blocks; every row meets every query of
    a block in one matrix product, and only the best ``k`` of a task go on.
    Vectors that are null, empty, zero or of another width are left out.
    """
    spark = vectors.sparkSession
    q_type, d_type = queries.schema[query_id].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v")).where("v is not null")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    rows = vectors.select(F.col(id_col).alias("d"), F.col(vector).alias("v")).where("v is not null")
    out = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()
        at, q = _matrix(mine.column("v"))
        sent = spark.sparkContext.broadcast((mine.column("q").combine_chunks().take(pa.array(at)), q))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            parts = range(0, len(q), QUERY_PART)
            best = [Best(min(QUERY_PART, len(q) - b), k + (not keep_self)) for b in parts]
            for batch in batches if len(q) else ():
                at, x = _matrix(batch.column(1), q.shape[1])
                for a in range(0, len(at), ROW_PART):
                    rows = x[a : a + ROW_PART]
                    for own, b in zip(best, parts):
                        own.offer(q[b : b + QUERY_PART] @ rows.T, batch.column(0), at[a : a + ROW_PART])
            for own, b in zip(best, parts):
                if own.ids is not None:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(own.query + b)), own.ids, pa.array(np.minimum(own.score, 1.0))], names=["q", "d", "score"])

        found = rows.mapInArrow(search, f"q {q_type}, d {d_type}, score double")
        out = found if out is None else out.unionByName(found)
    if not keep_self:
        out = out.where("q <> d")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "d"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("d").alias(id_col), "score", "rank")


def two_stage_top_k(queries: DataFrame, vectors: DataFrame, *, k: int, coarse: int, widen: int = 10, query_id: str = "query_id", id_col: str = "doc_id", vector: str = "vector") -> DataFrame:
    """Candidates by the first ``coarse`` dimensions, ``widen`` times ``k`` of them, reranked by the whole vectors."""
    short = lambda df: df.withColumn("_short", truncated(F.col(vector), coarse))
    near = top_k(short(queries), short(vectors), k=k * widen, query_id=query_id, query_vector="_short", id_col=id_col, vector="_short")
    full = near.select(query_id, id_col).join(vectors.select(id_col, F.col(vector).alias("_d")), id_col).join(queries.select(query_id, F.col(vector).alias("_q")), query_id)
    scored = full.withColumn("score", cosine(F.col("_q"), F.col("_d"))).where("score > 0")
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(query_id, id_col, "score", "rank")


def max_sim(queries: DataFrame, pages: DataFrame, *, k: int, query_id: str = "query_id", id_col: str = "page_id", vectors: str = "vectors") -> DataFrame:
    """Late interaction: mean over a query's vectors of the largest positive cosine with a page's; zeros are kept, ties by id."""
    spark = pages.sparkSession
    q_type, d_type = queries.schema[query_id].dataType.simpleString(), pages.schema[id_col].dataType.simpleString()
    asked = queries.select(F.col(query_id).alias("q"), F.col(vectors).alias("v")).where(F.size("v") > 0)
    blocks = max(1, -(-asked.count() // 512))
    rows = pages.select(F.col(id_col).alias("d"), F.col(vectors).alias("v")).where("d is not null")
    out = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()
        lists = mine.column("v").combine_chunks()
        owner = np.asarray(pa.compute.list_parent_indices(lists))
        at, q = _matrix(lists.flatten())
        sent = spark.sparkContext.broadcast((mine.column("q").combine_chunks(), owner[at], np.asarray(lists.value_lengths()), q))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, owner, sizes, q = sent.value
            for batch in batches:
                lists = batch.column(1)
                parent = np.asarray(pa.compute.list_parent_indices(lists))
                at, x = _matrix(lists.flatten(), q.shape[1]) if len(parent) else (np.zeros(0, np.int64), np.zeros((0, q.shape[1])))
                best = np.zeros((len(q), batch.num_rows))
                if len(at):
                    score = q @ x.T
                    for j, p in enumerate(parent[at]):
                        np.maximum(best[:, p], score[:, j], out=best[:, p])
                total = np.zeros((len(names), batch.num_rows))
                np.add.at(total, owner, best)
                total /= sizes[:, None]
                n = min(k, batch.num_rows)
                if not n or not len(names):
                    continue
                cut = -np.partition(-total, n - 1, axis=1)[:, n - 1 : n] - 1e-9
                i, j = np.nonzero(total >= cut)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), batch.column(0).take(pa.array(j)), pa.array(total[i, j])], names=["q", "d", "score"])

        found = rows.mapInArrow(search, f"q {q_type}, d {d_type}, score double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "d"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("d").alias(id_col), "score", "rank")
