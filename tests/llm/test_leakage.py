import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import leakage as lk
from corpusloom.llm.canonical import canonical_batch

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def brute(docs, items, n=12):
    split = lambda t: re.findall(r"[^\W_]+", (canonical_batch(pa.array([t])).to_pylist()[0] or "").casefold())
    runs = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    own = [(i, runs(split(p))) for i, p in items]
    return {(d, i) for d, t in docs for i, r in own if r & runs(split(t))}


@pytest.mark.parametrize("seed,limit", [(1, 200_000), (2, 40)])
def test_against_brute_force(spark, seed, limit):
    r = random.Random(seed)
    items = [(i, " ".join(r.choices(WORDS, k=r.randint(5, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "short")]
    items.append((60, items[0][1]))
    docs = []
    for d in range(40):
        own = r.choices(WORDS, k=r.randint(0, 60))
        if r.random() < 0.6:
            p = r.choice(items[:12])[1].split()
            a = r.randint(0, max(0, len(p) - 12))
            own[3:3] = p[a : a + r.randint(9, 20)]
        t = " ".join(own)
        docs.append((d, r.choice([t, t.upper(), t.replace(" ", ", "), t.replace(" ", "\n"), t.replace("a", "а"), t.replace("e", "ｅ")])))
    docs += [(90, None), (91, ""), docs[0]]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, item_id string, i int")
    it = spark.createDataFrame([(i, p, "x") for i, p in items], "item_id long, passage string, doc_id string")
    got = lk.leaked_passages(df, it, doc_id="doc_id", text="text", item_id="item_id", passage="passage", pass_windows=limit)
    assert {(x[0], x[1]) for x in got.where("n_exact > 0").collect()} == brute(docs, items)
    assert got.where("n_near < 0 or n_near + n_exact = 0").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    it = spark.createDataFrame([(1, "a " * 30)], "item_id long, passage string")
    args = dict(doc_id="doc_id", text="text", item_id="item_id", passage="passage")
    assert lk.leaked_passages(df.limit(0), it, **args).count() == 0
    assert lk.leaked_passages(df, it.limit(0), **args).count() == 0
    assert [tuple(x)[:2] for x in lk.leaked_passages(df, it, **args).collect()] == [(1, 1)]


def test_index_finds_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    asked = np.concatenate([marks[:100] ^ np.uint64(0b1000000000000000010000000000000001), marks[100:150], rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
    index = lk.Index(np.arange(300), marks, None, None, None, 3)
    got = set(zip(*map(lambda x: x.tolist(), index.near(asked))))
    want = {(i, j) for i, a in enumerate(asked) for j, b in enumerate(marks) if int(a ^ b).bit_count() <= 3}
    assert got == want and len(got) >= 150


def test_similarity_is_weighted_jaccard():
    a, b = np.array([[1, 2, 3]]), np.array([[2, 3, 4]])
    assert lk.similarity(a, np.array([[1, 2, 3]]), b, np.array([[2, 3, 5]]))[0] == 5 / (6 + 10 - 5)


def test_edited_passages(spark):
    """Windows with their last word changed: those reported are near, and their share is the one stated."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(1, 11)))
    passages = [[word() for _ in range(12)] for _ in range(400)]
    edited = [[*p[:11], word()] for p in passages]
    it = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id long, passage string")
    df = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(edited)], "doc_id long, text string")
    got = lk.leaked_passages(df, it, doc_id="doc_id", text="text", item_id="item_id", passage="passage").collect()
    assert all(x["doc_id"] == x["item_id"] and x["n_near"] == 1 and x["n_exact"] == 0 for x in got)

    def alike(a, b):
        shingles = lambda w: {tuple(w[i : i + 5]): sum(map(len, w[i : i + 5])) for i in range(8)}
        x, y = shingles(a), shingles(b)
        shared = sum(n for s, n in x.items() if s in y)
        return shared / (sum(x.values()) + sum(y.values()) - shared)

    near = {i for i in range(400) if alike(passages[i], edited[i]) >= 0.8}
    assert {x["doc_id"] for x in got} <= near and 0.1 * len(near) < len(got) < 0.4 * len(near)
