"""The most similar vectors of every vector.

A forest of random-projection trees is searched through one shared priority
queue, and the leaves it yields are reranked exactly. All trees share their
upper levels, which cut the collection into blocks of about ``block_rows`` rows
that fit in one task; below, every block has ``trees`` trees of its own. The
trees are fitted on a bounded sample (each node splits along the line between
two centroids, at the median), so the queue of a query, keyed by the margins
crossed on the way, is known wherever the query is: its leaves of all blocks
and trees compete, and it is sent only to blocks that hold leaves at the top,
``asks`` at most, with the list of those leaves. A query is offered a share
``reach`` of all rows, no less than ``offers`` rows, and no more than half of
the rows of ``asks`` blocks: beyond some ``asks / 2 / reach`` blocks the work
and the copies of a vector are the same however large the collection is. Below
``offers / reach`` rows the search is nearly a scan. Queries take the queue in
bulk: the order in which a queue pops leaves is the order of their keys.

A block much asked for is dealt to several tasks, each with all its rows and a
part of its queries. Rows of equal direction are searched once, by their lowest
id, so a vector repeated by a third of the rows costs one row. Vectors travel
as 32-bit floats: one copy to the block they lie in and one to each other block asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import checkpointed, small_side

#: Rows per matrix product; bounds memory, not results.
PART = 2048


def usable(column: pa.ListArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a batch, and these scaled to length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == dimension)
    if not len(fits):
        return fits, np.zeros((0, dimension), np.float32)
    x = np.asarray(column.take(pa.array(fits)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, dimension)
    big = np.abs(x).max(1)
    good = np.isfinite(big) & (big > 0)
    x = x[good] / big[good, None]
    return fits[good], (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def direction_keys(x: np.ndarray) -> np.ndarray:
    """A 128-bit key of each unit vector rounded to five digits, as bytes."""
    whole = np.rint(x.astype(np.float64) * 1e5).astype(np.int64).view(np.uint64)
    rng = np.random.default_rng(20240229)
    odd = rng.integers(1, 1 << 63, size=(2, x.shape[1]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.stack([(whole * o).sum(1, dtype=np.uint64) for o in odd], 1)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def split_line(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Direction between two centroids of a sample of ``x``, and the median along it."""
    sample = x[rng.choice(len(x), min(len(x), 400), replace=False)]
    a, b = sample[0], sample[-1]
    for _ in range(4):
        right = sample @ (b - a) > 0.5 * (b @ b - a @ a)
        if right.all() or not right.any():
            break
        a, b = sample[~right].mean(0), sample[right].mean(0)
    line = b - a
    norm = float(np.linalg.norm(line))
    line = line / norm if norm > 1e-9 else rng.normal(size=x.shape[1]).astype(np.float32) / math.sqrt(x.shape[1])
    return line.astype(np.float32), float(np.median(x @ line))


class Tree:
    """A random-projection tree fitted on a sample, as arrays: node k has children 2k+1 and 2k+2."""

    def __init__(self, x: np.ndarray, depth: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.lines = np.zeros((2**depth - 1, x.shape[1]), np.float32)
        self.at = np.zeros(2**depth - 1, np.float32)
        parts = [np.arange(len(x))]
        for node in range(2**depth - 1):
            own = parts[node]
            if len(own) > 1:
                self.lines[node], self.at[node] = split_line(x[own], rng)
                side = x[own] @ self.lines[node] > self.at[node]
            else:  # no row of the sample tells how to split: any line will do
                self.lines[node] = rng.normal(size=x.shape[1]) / math.sqrt(x.shape[1])
                side = np.zeros(len(own), bool)
            parts += [own[~side], own[side]]
            parts[node] = own[:0]

    def keys(self, q: np.ndarray) -> np.ndarray:
        """Queue key of every leaf for every query: the squared margins crossed on the way to it."""
        margin = q @ self.lines.T - self.at
        key = np.zeros((len(q), 1), np.float32)
        for d in range(self.depth):
            m = margin[:, 2**d - 1 : 2 ** (d + 1) - 1]
            key = np.stack([key + np.maximum(m, 0) ** 2, key + np.maximum(-m, 0) ** 2], 2).reshape(len(q), -1)
        return key

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf each row lies in."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.lines[node]) > self.at[node])
        return node - (2**self.depth - 1)


class Forest:
    """A router that cuts the collection into blocks, and trees inside each."""

    def __init__(self, sample: np.ndarray, blocks: int, leaves: int, trees: int, seed: int) -> None:
        self.blocks, self.leaves, self.n_trees = blocks, leaves, trees
        self.router = Tree(sample, int(math.log2(blocks)), seed)
        home = self.router.leaf(sample)
        self.trees = [[Tree(sample[home == b], int(math.log2(leaves)), seed + 1 + t) for t in range(trees)] for b in range(blocks)]

    def queue(self, q: np.ndarray, asks: int, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks asked by each query, and which leaves of their trees are among its first ``visits``."""
        near = self.router.keys(q)
        block = np.argpartition(near, asks - 1, axis=1)[:, :asks] if asks < self.blocks else np.broadcast_to(np.arange(asks), near.shape)
        width = self.n_trees * self.leaves
        key = np.empty((len(q), asks, width), np.float32)
        for b in np.unique(block):
            who, slot = np.nonzero(block == b)
            key[who, slot] = near[who, b, None] + np.concatenate([t.keys(q[who]) for t in self.trees[b]], 1)
        key = key.reshape(len(q), -1)
        popped = np.zeros(key.shape, bool)
        if visits < key.shape[1]:
            np.put_along_axis(popped, np.argpartition(key, visits - 1, axis=1)[:, :visits], True, axis=1)
        else:
            popped[:] = True
        return block, popped.reshape(len(q), asks, width)


def queues(forest: Forest, x: np.ndarray, asks: int, visits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks and leaves asked by the queries, some queries at a time."""
    step = max(64, (1 << 24) // (asks * forest.n_trees * forest.leaves))
    for a in range(0, len(x), step):
        yield forest.queue(x[a : a + step], asks, visits)


class Block:
    """The rows of one block in the leaves of its trees."""

    def __init__(self, x: np.ndarray, trees: list[Tree]) -> None:
        self.x, self.leaves = x, []
        for t in trees:
            leaf = t.leaf(x)
            order = np.argsort(leaf, kind="stable")
            self.leaves += np.split(order, np.searchsorted(leaf[order], np.arange(1, 2**t.depth)))

    def search(self, q: np.ndarray, popped: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the best ``k`` rows of the leaves popped for each query (place -1: fewer); ``own`` is left out."""
        best = np.full((len(q), k), -2.0, np.float32)
        place = np.full((len(q), k), -1, np.int64)
        for leaf, rows in enumerate(self.leaves):
            who = np.flatnonzero(popped[:, leaf])
            if not len(who) or not len(rows):
                continue
            data = self.x[rows]
            for a in range(0, len(who), PART):
                some = who[a : a + PART]
                score = q[some] @ data.T
                near = score > best[some, k - 1, None]
                if near.sum() > 2 * k * len(some) and len(rows) > k + 1:  # early leaves: only a leaf's own best can stay
                    near &= score >= np.partition(score, -k - 1, axis=1)[:, -k - 1, None]
                near &= rows[None, :] != own[some, None]
                hit = np.flatnonzero(near.any(1))
                if not len(hit):
                    continue
                i, j = np.nonzero(near[hit])
                self._merge(best, place, some[hit], i, rows[j], score[hit[i], j], k)
        return place, best

    @staticmethod
    def _merge(best: np.ndarray, place: np.ndarray, who: np.ndarray, i: np.ndarray, rows: np.ndarray, score: np.ndarray, k: int) -> None:
        """New candidates ``(i, rows, score)`` put among the best of the queries ``who``; a row counts once."""
        at = np.concatenate([np.repeat(np.arange(len(who)), k), i])
        row = np.concatenate([place[who].ravel(), rows])
        value = np.concatenate([best[who].ravel(), score])
        key = at << 32 | row
        order = np.argsort(key[row >= 0], kind="stable")  # the same row through two trees stays once
        order = np.flatnonzero(row >= 0)[order]
        once = np.ones(len(order), bool)
        once[1:] = key[order[1:]] != key[order[:-1]]
        order = order[once]
        order = order[np.lexsort((-value[order], at[order]))]
        at, row, value = at[order], row[order], value[order]
        first = np.searchsorted(at, np.arange(len(who)))
        rank = np.arange(len(at)) - first[at]
        keep = rank < k
        b, p = np.full((len(who), k), -2.0, np.float32), np.full((len(who), k), -1, np.int64)
        b[at[keep], rank[keep]], p[at[keep], rank[keep]] = value[keep], row[keep]
        best[who], place[who] = b, p


def nearest_vectors(
    vectors: DataFrame,
    *,
    id_col: str,
    fields: list[str],
    dimension: int,
    k: int = 10,
    block_rows: int = 32_768,
    trees: int = 2,
    leaf_rows: int = 128,
    reach: float = 0.22,
    offers: int = 1000,
    asks: int = 32,
    sample_rows: int = 65_536,
    query_rows: int = 262_144,
    least: float | None = None,
) -> DataFrame:
    """The ``k`` most similar rows of every usable row: ``(field_name, id, neighbor, cosine, rank)``.

    Each field is searched by itself; usable vectors have ``dimension`` finite
    components, not all zero. Order is by cosine, then id. The trees are fitted on
    4,096 rows a field or 8 a leaf, about ``sample_rows`` at most, chosen by a
    hash of the id (leaves grow where it allows no more of them); every usable
    row is indexed. A task answers
    about ``query_rows`` queries of a block. ``least`` keeps only neighbours of at
    least that cosine, ranks being those of the whole result.

    Defined cases: null, empty, short, long, zero and non-finite vectors give no
    rows and are nobody's neighbours; a repeated id counts once (by its first
    vector in byte order); equal vectors under several ids are neighbours of
    each other at cosine 1; a lone vector gives no rows; empty tables give none;
    columns other than those named are ignored.
    """
    spark = vectors.sparkSession
    total = vectors.count()
    blocks = 2 ** max(0, math.ceil(math.log2(max(total, 1) / block_rows)))
    kind = vectors.schema[id_col].dataType
    base = vectors.select(F.col(id_col).alias("id"), *[F.col(f).alias(f"v{i}") for i, f in enumerate(fields)]).where("id is not null")
    n_fields = len(fields)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in range(n_fields):
                at, x = usable(batch.column(1 + f), dimension)
                if len(at):
                    h = direction_keys(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f, np.int32)), batch.column(0).take(pa.array(at)), pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), rows_binary(x)], names=["f", "id", "h1", "h2", "x"])

    units = base.mapInArrow(unit, f"f int, id {kind.simpleString()}, h1 long, h2 long, x binary")
    # an id given with several vectors keeps the first; whole rows repeated meet again in their block
    keyed = checkpointed(units.select("f", "id", "h1", "h2"))  # keys alone; the vectors are read once more, for the index
    key = F.struct("h1", "h2")
    torn = keyed.groupBy("f", "id").agg(F.min(key).alias("k"), F.max(key).alias("last")).where("k <> last").select("f", "id", "k.h1", "k.h2")
    if torn.limit(1).count():
        keep = lambda df: df.join(torn.select("f", "id"), ["f", "id"], "left_anti").unionByName(df.join(torn, ["f", "id", "h1", "h2"], "left_semi"))
        units, keyed = keep(units), keep(keyed)
    # rows of one direction, found by key alone
    classes = keyed.groupBy("f", "h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("f", "h1", "h2", "rep")
    members = checkpointed(keyed.join(small_side(classes), ["f", "h1", "h2"]).select("f", "rep", "id").distinct())
    others = members.where("id <> rep")
    index = units.join(small_side(others.select("f", "id")), ["f", "id"], "left_anti")

    most = 2 ** int(math.log2(max(2, sample_rows // 8)))  # leaves a sample can tell apart
    leaves = max(1, min(most, 2 ** max(0, round(math.log2(max(total, 1) / leaf_rows)))) // blocks)
    asks = min(asks, blocks)
    visits = math.ceil(max(reach * blocks * leaves, offers * blocks * leaves / max(total, 1)))
    if asks < blocks:
        visits = max(1, min(visits, asks * leaves // 2))
    elif visits >= blocks * leaves:  # every row is offered: one tree does that
        visits, trees = blocks * leaves, 1
    share = min(1.0, min(sample_rows, max(4096, 8 * blocks * leaves)) / max(total, 1))
    picked = units.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("f", "x").toArrow()
    side = np.asarray(picked.column("f").combine_chunks())
    seen = np.frombuffer(b"".join(picked.column("x").to_pylist()), np.float32).reshape(-1, dimension)
    forests = [Forest(seen[side == f], blocks, leaves, trees, 7 + 100 * f) for f in range(n_fields)]
    # tasks of each block, from the queries of the sample
    loads = [np.bincount(np.concatenate([b[p.any(2)] for b, p in queues(forests[f], seen[side == f], asks, visits)] or [np.zeros(0, np.int64)]), minlength=blocks) / max(share, 1e-9) for f in range(n_fields)]
    deal = np.concatenate([np.maximum(1, np.ceil(x / query_rows)).astype(np.int64) for x in loads])
    parts, width = int(deal.sum()), -(-trees * leaves // 8)
    sent = spark.sparkContext.broadcast((forests, deal, np.concatenate([[0], np.cumsum(deal)]), np.repeat(np.arange(len(deal)), deal)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows for every task: role 0 to be found, 1 also to ask, 2 only to ask; with the leaves asked for."""
        forests, deal, first, _ = sent.value
        for batch in batches:
            side, x = np.asarray(batch.column("f")), binary_rows(batch.column("x"), dimension)
            for f in range(n_fields):
                mine = np.flatnonzero(side == f)
                done = 0
                for block, popped in queues(forests[f], x[mine], asks, visits):
                    own = mine[done : done + len(block)]
                    done += len(block)
                    turn = (direction_keys(x[own])[:, 0] % np.uint64(65_521)).astype(np.int64)  # alike if the task runs again
                    home = forests[f].router.leaf(x[own])
                    bits = np.packbits(popped, axis=2)
                    at, slot = np.nonzero(popped.any(2))
                    place = block[at, slot] + f * blocks
                    there = block[at, slot] == home[at]
                    task = first[place] + turn[at] % deal[place]
                    # asked at home: there the row lies already
                    nth = np.repeat(np.arange(len(own)), deal[home + f * blocks])
                    copy = np.arange(len(nth)) - np.searchsorted(nth, nth)
                    lies = first[home[nth] + f * blocks] + copy
                    asked = np.full(len(own), -1)
                    asked[at[there]] = np.flatnonzero(there)
                    also = (asked[nth] >= 0) & (lies == task[asked[nth]])
                    masks = np.concatenate([np.where(also[:, None], bits[at, slot][asked[nth]], 0), bits[at, slot][~there]])
                    rows = pa.array(np.concatenate([own[nth], own[at[~there]]]))
                    role = np.concatenate([also.astype(np.int32), np.full((~there).sum(), 2, np.int32)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([lies, task[~there]]).astype(np.int32)), pa.array(role), batch.column("id").take(rows), batch.column("x").take(rows), rows_binary(masks)], names=["part", "role", "id", "x", "leaves"])

    placed = index.select("f", "id", "x").mapInArrow(route, f"part int, role int, id {kind.simpleString()}, x binary, leaves binary")
    sorted_rows = placed.repartitionById(parts, F.col("part")).withColumn("asks", (F.col("role") == 2).cast("int")).sortWithinPartitions("part", "asks", "id").drop("asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests, _, _, blocks_of = sent.value
        part, field, kept, found_in, all_ids, last = None, 0, [], None, None, None

        def asked(q: np.ndarray, q_ids: pa.Array, leaves: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(q), 4 * PART):
                popped = np.unpackbits(leaves[a : a + 4 * PART], axis=1).astype(bool)
                place, best = found_in.search(q[a : a + 4 * PART], popped, k, own[a : a + 4 * PART])
                n = (place >= 0).sum(1)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                near = pa.ListArray.from_arrays(ends, all_ids.take(pa.array(place[place >= 0])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), field, np.int32)), q_ids.slice(a, len(place)), near, pa.ListArray.from_arrays(ends, pa.array(best[place >= 0]))], names=["f", "id", "near", "cos"])

        def grow() -> Iterator[pa.RecordBatch]:
            nonlocal found_in, all_ids
            ids, x, role, leaves = (pa.concat_arrays([r[0] for r in kept]), *(np.concatenate([r[c] for r in kept]) for c in (1, 2, 3)))
            once = changes(ids)  # whole rows repeated
            x, all_ids, role, leaves = x[once], ids.filter(pa.array(once)), role[once], leaves[once]
            found_in = Block(x, forests[field].trees[blocks_of[part] % blocks])
            ask = np.flatnonzero(role == 1)
            yield from asked(x[ask], all_ids.take(pa.array(ask)), leaves[ask], ask)

        for batch in batches:
            to, role = np.asarray(batch.column("part")), np.asarray(batch.column("role"))
            cuts = np.flatnonzero((np.diff(to, prepend=-1) != 0) | (np.diff(role // 2, prepend=-1) != 0))
            for a, b in zip(cuts, [*cuts[1:], len(to)]):
                if part != to[a]:
                    if kept and found_in is None:
                        yield from grow()
                    part, field, kept, found_in, last = int(to[a]), int(blocks_of[to[a]]) // blocks, [], None, None
                piece = batch.slice(a, b - a)
                x, leaves = binary_rows(piece.column("x"), dimension), binary_rows(piece.column("leaves"), width, np.uint8)
                if role[a] < 2:
                    kept.append((piece.column("id"), x, role[a:b], leaves))
                    continue
                if kept and found_in is None:
                    yield from grow()
                once = changes(piece.column("id"))
                once[0] &= piece.column("id")[0].as_py() != last
                last = piece.column("id")[-1].as_py()
                if found_in is not None and once.any():
                    yield from asked(x[once], piece.column("id").filter(pa.array(once)), leaves[once], np.full(once.sum(), -1))
        if kept and found_in is None:
            yield from grow()

    lists = sorted_rows.mapInArrow(search, f"f int, id {kind.simpleString()}, near array<{kind.simpleString()}>, cos array<float>")
    pairs = lists.select("f", "id", F.explode(F.arrays_zip("near", "cos")).alias("z")).select("f", "id", F.col("z.near").alias("near"), F.col("z.cos").alias("cos"))
    if least is not None:
        pairs = pairs.where(F.col("cos") >= least)
    if asks > 1 and least is None:
        rank = F.row_number().over(Window.partitionBy("f", "id").orderBy(F.desc("cos"), "near"))
        pairs = pairs.withColumn("r", rank).where(F.col("r") <= k).drop("r")

    # representatives stand for their class: at most k + 1 members of a class can be in one answer
    few = members.withColumn("n", F.row_number().over(Window.partitionBy("f", "rep").orderBy("id"))).where(F.col("n") <= k + 1).select("f", F.col("rep").alias("near"), F.col("id").alias("member"))
    few = small_side(few)
    wide = pairs.join(few, ["f", "near"], "left").select("f", "id", F.coalesce("member", "near").alias("near"), "cos")
    asking = members.select("f", F.col("rep").alias("id"), F.col("id").alias("asker"))
    asked = wide.join(small_side(asking), ["f", "id"], "left").select("f", F.coalesce("asker", "id").alias("id"), "near", "cos")
    inside = members.join(few.withColumnRenamed("near", "rep"), ["f", "rep"]).where("id <> member").select("f", "id", F.col("member").alias("near"), F.lit(1.0).cast("float").alias("cos"))
    ranked = asked.unionByName(inside).withColumn("rank", F.row_number().over(Window.partitionBy("f", "id").orderBy(F.desc("cos"), "near"))).where(F.col("rank") <= k)
    names = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("f") + 1)
    return ranked.select(names.alias("field_name"), "id", F.col("near").alias("neighbor"), F.least(F.lit(1.0), F.col("cos").cast("double")).alias("cosine"), "rank")


def mutual_pairs(neighbors: DataFrame, least: float) -> DataFrame:
    """Pairs ``(field_name, id_a, id_b)``, a before b, each among the other's nearest and at least ``least`` alike."""
    close = neighbors.where(F.col("cosine") >= least)
    pair = close.select("field_name", F.least("id", "neighbor").alias("id_a"), F.greatest("id", "neighbor").alias("id_b"), (F.col("id") < F.col("neighbor")).cast("int").alias("up"))
    return pair.groupBy("field_name", "id_a", "id_b").agg(F.countDistinct("up").alias("n")).where("n = 2").drop("n")


def changes(ids: pa.Array) -> np.ndarray:
    """True where a sorted id differs from the one before."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    out = np.ones(len(ids), bool)
    if len(ids) > 1:
        out[1:] = np.asarray(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)))
    return out


def rows_binary(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def binary_rows(column: pa.Array, width: int, kind: type = np.float32) -> np.ndarray:
    """The ``width`` values of each row of a column of equally long byte strings."""
    if not len(column):
        return np.zeros((0, width), kind)
    size = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], size)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)
