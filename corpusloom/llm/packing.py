"""Texts packed into containers of a fixed number of tokens.

Sizes are whole numbers up to the capacity, so the instance is its histogram,
whatever the number of texts. On it the dominance reduction of Martello and
Toth fixes small sets that no other set with the same item can beat, in bulk;
best-fit decreasing packs what remains, also in bulk, and where that is above
the bound of the sum of sizes, containers filled one by one do if they are
fewer. The plan, a few thousand runs of equal containers, goes back to the
rows, which find their place by their rank among the items of their size. Ranks are taken per size
and salt, so a size that many texts share is no hot group, and the texts
themselves are never shuffled.
"""

from __future__ import annotations

import base64
import functools
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import checkpointed

#: Folder of the public tokenizers; a parameter of every function that counts tokens.
TOKENIZERS = "/opt/tokenizers"


#: Fixed value: the public pattern that cuts a text before its bytes are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(folder: str, name: str) -> bytes:
    """The ranks file of a byte-level BPE; read where the job is planned, executors are sent its bytes."""
    return Path(folder, name).read_bytes()


@functools.lru_cache(maxsize=4)
def tokenizer(ranks: bytes, pattern: str = PATTERN):
    """A byte-level BPE encoder of the bytes of a ranks file."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_counts(texts: DataFrame, *, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken", pattern: str = PATTERN) -> DataFrame:
    """``(key, n_tokens)`` of every row; a null text has no tokens."""
    sent = texts.sparkSession.sparkContext.broadcast(read_ranks(folder, name))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(sent.value, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["k", "n"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(count, f"k {kind}, n long").select(F.col("k").alias(key), F.col("n").alias("n_tokens"))


class Plan:
    """Runs of equal containers: how many, and the sizes in each with their number."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.runs: list[list] = []

    def add(self, count: int, content: list[tuple[int, int]]) -> None:
        self.runs.append([count, content])

    def containers(self) -> int:
        return sum(count for count, _ in self.runs)


def _fit_beside(sizes: list[int], count: np.ndarray, room: int) -> int:
    """How many of the smallest items fit into ``room`` together, 3 standing for more than two."""
    n = 0
    for s in sizes:
        take = min(3 - n, int(count[s]), room // s)
        n, room = n + take, room - take * s
        if n == 3 or take < count[s]:
            break
    return n


def _best_pair(sizes: list[int], count: np.ndarray, room: int) -> tuple[int, int]:
    """The two items, the larger first, with the largest sum that fits ``room``; zeros if no two fit."""
    i, j, best = 0, bisect_left(sizes, room) - 1, (0, 0)
    while i <= j:
        if sizes[i] + sizes[j] > room or (i == j and count[sizes[i]] < 2):
            j -= 1
            continue
        if sizes[i] + sizes[j] > sum(best):
            best = sizes[j], sizes[i]
        i += 1
    return best


def _dominating(w: int, count: np.ndarray, capacity: int) -> list[int] | None:
    """The items that go with an item of size ``w`` (no more counted) in some best packing, or None if that is not proven."""
    sizes = [int(s) for s in np.flatnonzero(count)]
    room = capacity - w
    fit = bisect_left(sizes, room + 1)
    if not fit:
        return []
    mate = sizes[fit - 1]
    if mate == room:
        return [mate]
    beside = _fit_beside(sizes[:fit], count, room)
    if beside == 1:
        return [mate]
    if beside > 2:  # three may go where no pair does: nothing is proven
        return None
    a, b = _best_pair(sizes, count, room)
    if mate >= a + b:
        return [mate]
    if mate == a:
        # {a, b} stands for every single item and for every pair but one of two items larger than b
        above = [s for s in sizes[bisect_left(sizes, b + 1) : fit] for _ in range(min(2, int(count[s])))][:2]
        if len(above) < 2 or sum(above) > room:
            return [a, b]
    return None


def reduce_dominated(count: np.ndarray, plan: Plan) -> None:
    """Fix containers whose set dominates every other that holds the same item; ``count`` keeps the rest.

    After Martello and Toth: nothing fits beside the item; its mate, the
    largest that fits, fills the container or is the only kind of companion;
    where no more than two fit beside it, the mate is as large as any two
    together, or is one of the best two and no other pair has both larger than
    the second. Where three may fit no pair is fixed. Removing items never
    makes such a set lose its dominance, so equal containers are fixed in bulk.
    """
    changed = True
    while changed:
        changed = False
        for w in range(plan.capacity, 0, -1):
            while count[w]:
                count[w] -= 1
                mates = _dominating(w, count, plan.capacity)
                count[w] += 1
                if mates is None:
                    break
                content = Counter([w, *mates])
                n = min(int(count[s]) // k for s, k in content.items())
                for s, k in content.items():
                    count[s] -= n * k
                plan.add(n, sorted(content.items(), reverse=True))
                changed = True


def fullest(count: np.ndarray, room: int) -> list[tuple[int, int]]:
    """Items that fill ``room`` as far as any do, large ones first."""
    reached, steps = 1, []
    mask = (1 << room + 1) - 1
    for s in np.flatnonzero(count[: room + 1])[::-1].tolist():
        n, part = min(int(count[s]), room // s), 1
        while n:
            take = min(part, n)
            steps.append((reached, s, take))
            reached |= reached << s * take & mask
            n, part = n - take, part * 2
        if reached >> room & 1:
            break
    at, used = reached.bit_length() - 1, Counter()
    for before, s, take in reversed(steps):
        if not before >> at & 1:
            at -= s * take
            used[s] += take
    return sorted(used.items(), reverse=True)


def fill_each(count: np.ndarray, plan: Plan) -> None:
    """Containers filled one after the other, each around the largest item left as far as possible, equal ones together."""
    for w in range(plan.capacity, 0, -1):
        while count[w]:
            count[w] -= 1
            content = Counter({w: 1})
            content.update(dict(fullest(count, plan.capacity - w)))
            count[w] += 1
            n = min(int(count[s]) // k for s, k in content.items())
            for s, k in content.items():
                count[s] -= n * k
            plan.add(n, sorted(content.items(), reverse=True))


def best_fit(count: np.ndarray, plan: Plan) -> None:
    """Best-fit decreasing of the items left, equal containers together."""
    rooms: list[int] = []
    open_runs: dict[int, list[list]] = {}

    def keep(run: list, room: int) -> None:
        if room not in open_runs:
            open_runs[room] = []
            insort(rooms, room)
        open_runs[room].append(run)

    for w in range(plan.capacity, 0, -1):
        n = int(count[w])
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                each = plan.capacity // w
                if n >= each:
                    keep([n // each, [(w, each)]], plan.capacity - each * w)
                if n % each:
                    keep([1, [(w, n % each)]], plan.capacity - n % each * w)
                break
            room = rooms[at]
            run = open_runs[room].pop()
            if not open_runs[room]:
                del open_runs[room], rooms[at]
            each = room // w
            if (many := min(run[0], n // each)) > 0:
                keep([many, [*run[1], (w, each)]], room - each * w)
                n -= many * each
                run = [run[0] - many, run[1]]
            elif n:
                keep([1, [*run[1], (w, n)]], room - n * w)
                run = [run[0] - 1, run[1]]
                n = 0
            if run[0]:
                keep(run, room)
        count[w] = 0
    for runs in open_runs.values():
        for many, content in runs:
            plan.add(many, content)


def packing_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Dominance reduction, then best fit of the rest; where that uses more than the fewest containers its sum allows, filling container by container if it uses fewer."""
    fixed, count = Plan(capacity), np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        if size:
            count[size] += n
    reduce_dominated(count, fixed)
    plans = []
    for pack in (best_fit, fill_each):
        plan = Plan(capacity)
        pack(count.copy(), plan)
        plans.append(plan)
        if plan.containers() <= -(-int(count @ np.arange(capacity + 1)) // capacity):
            break
    fixed.runs += min(plans, key=Plan.containers).runs
    return fixed


def plan_arrays(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per run of items of one size: code of its first rank, first container, items a container; sorted by code.

    The code is ``size << 40 | rank``; the last array holds the containers of all runs.
    """
    used: dict[int, int] = {}
    code, base, each, first = [], [], [], 0
    for many, content in plan.runs:
        for size, n in content:
            code.append(size << 40 | used.get(size, 0))
            base.append(first)
            each.append(n)
            used[size] = used.get(size, 0) + many * n
        first += many
    order = np.argsort(code)
    return *(np.array(x, np.int64)[order] for x in (code, base, each)), np.array(first)


def pack_texts(texts: DataFrame, *, key: str, text: str, capacity: int = 1024, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken", salts: int = 64) -> DataFrame:
    """Every text assigned to containers: ``(key, piece_no, start_token, n_tokens, container_id)``.

    A text of more than ``capacity`` tokens is divided into full pieces and a
    rest; others stay whole. Containers are numbered from 0 without gaps.

    Defined cases: null and empty texts have one piece of no tokens in
    container 0; repeated rows are items of their own; texts of equal size are
    placed in the order of a hash and the key; an empty table gives no rows;
    other columns are ignored. Keys may be null or repeated.
    """
    spark = texts.sparkSession
    counts = token_counts(texts, key=key, text=text, folder=folder, name=name)
    pieces = counts.select(F.col(key).alias("k"), "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1))).alias("p"))
    items = checkpointed(pieces.select("k", "p", F.least(F.lit(capacity), F.col("n_tokens") - F.col("p") * capacity).cast("int").alias("size"), F.pmod(F.xxhash64("k", "p"), F.lit(salts)).cast("int").alias("salt")))
    # at most (capacity + 1) * salts rows
    table = items.groupBy("size", "salt").agg(F.count("*").alias("n")).toArrow()
    grid = np.zeros((capacity + 1, salts), np.int64)
    grid[np.asarray(table["size"]), np.asarray(table["salt"])] = np.asarray(table["n"])
    plan = packing_plan(dict(enumerate(grid.sum(1).tolist())), capacity)
    sent = spark.sparkContext.broadcast((grid.cumsum(1) - grid, *plan_arrays(plan)))

    @F.arrow_udf("long")
    def container(size: pa.Array, salt: pa.Array, rank: pa.Array) -> pa.Array:
        offset, code, base, each, _ = sent.value
        s, r = np.asarray(size).astype(np.int64), np.asarray(rank).astype(np.int64)
        place = s << 40 | (r + offset[s, np.asarray(salt)])
        if not len(code):
            return pa.array(np.zeros(len(s), np.int64))
        at = np.maximum(np.searchsorted(code, place, side="right") - 1, 0)
        return pa.array(np.where(s > 0, base[at] + (place - code[at]) // each[at], 0))

    ranked = items.withColumn("rank", (F.row_number().over(Window.partitionBy("size", "salt").orderBy("k", "p")) - 1).cast("long"))
    return ranked.select(F.col("k").alias(key), F.col("p").alias("piece_no"), (F.col("p") * capacity).alias("start_token"), F.col("size").cast("long").alias("n_tokens"), container("size", "salt", "rank").alias("container_id"))
