from pathlib import Path

import numpy as np
import pytest

from corpusloom.llm import neighbors as nb

SHAPE = "mv_id long, raw_text array<float>, summary array<float>, f int, id string, block int"


def rows(n=400, dim=16, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[1] = x[0] * 3  # one direction under several ids
    x[2] = x[0]
    x[10:40] = x[10]  # more than k equal rows
    x[50] = x[51] + 0.01
    data = [[i, [float(v) for v in x[i]], [float(v) for v in x[n - 1 - i]], 0, "x", 1] for i in range(n)]
    data[60][1], data[61][1], data[62][1] = None, [], [0.0] * dim
    data[63][1] = data[63][1][:-1] + [float("nan")]
    data[64][1] = data[64][1][:-1] + [float("inf")]
    data[65][1] = data[65][1] + [1.0]
    return [*data, data[5], data[51]]


def brute(data, col, k=10, dim=16):
    by = {r[0]: np.array(r[col], float) for r in data if r[col] is not None and len(r[col]) == dim and np.isfinite(r[col]).all() and any(r[col])}
    ids = sorted(by)
    x = np.array([by[i] / np.linalg.norm(by[i]) for i in ids])
    s = x @ x.T
    out = {}
    for a, i in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-round(s[a, j], 4), ids[j]))[:k]
        out[i] = [(ids[j], s[a, j]) for j in order]
    return out


@pytest.mark.parametrize("options", [{}, {"block_rows": 128}, {"block_rows": 64, "leaf_rows": 8, "trees": 3}])
def test_recall(spark, options):
    data = rows()
    df = spark.createDataFrame(data, SHAPE)
    got: dict = {}
    for x in nb.nearest_vectors(df, id_col="mv_id", fields=["raw_text", "summary"], dimension=16, **options).collect():
        got.setdefault((x["field_name"], x["id"]), []).append((x["rank"], x["neighbor"], x["cosine"]))
    for field, col in (("raw_text", 1), ("summary", 2)):
        want = brute(data, col)
        assert {i for f, i in got if f == field} == set(want)
        assert all(len(v) == 10 and len({n for _, n, _ in v}) == 10 for (f, _), v in got.items() if f == field)
        hits = sum(len({n for _, n, _ in got[field, i]} & {n for n, _ in w}) for i, w in want.items())
        assert hits >= 0.9 * 10 * len(want)
    mine = [n for _, n, _ in sorted(got["raw_text", 39])]
    assert mine == list(range(10, 20))  # equal rows: the lowest ids


def test_mutual_pairs(spark):
    data = rows()
    df = spark.createDataFrame(data, SHAPE)
    near = nb.nearest_vectors(df, id_col="mv_id", fields=["raw_text"], dimension=16, least=0.85)
    got = {(x["id_a"], x["id_b"]) for x in nb.mutual_pairs(near, 0.85).collect()}
    want = brute(data, 1)
    pairs = {(a, b) for a, w in want.items() for b, c in w if a < b and c >= 0.85 and any(x == a for x, _ in want[b])}
    assert got == pairs and (0, 1) in got and (0, 2) in got


def test_few_rows(spark):
    df = spark.createDataFrame(rows(), SHAPE)
    args = dict(id_col="mv_id", fields=["raw_text"], dimension=16)
    assert nb.nearest_vectors(df.limit(0), **args).count() == 0
    assert nb.nearest_vectors(df.where("mv_id = 7"), **args).count() == 0
    assert nb.nearest_vectors(df.where("mv_id in (7, 8, 60)"), **args).count() == 2


@pytest.mark.parametrize("blocks", [8, 32, 64])
def test_recall_over_many_blocks(spark, blocks):
    """The share ``reach`` of all rows binds, not the least number of rows offered."""
    path = Path("/root/testdata/sf0.1/multi_vectors.parquet")
    if not path.exists():
        pytest.skip("test tables are not here")
    df = spark.read.parquet(str(path))
    near = nb.nearest_vectors(df, id_col="mv_id", fields=["raw_text"], dimension=96, block_rows=-(-df.count() // blocks), leaf_rows=8, offers=0)
    got: dict = {}
    for x in near.where("id % 20 = 0").collect():
        got.setdefault(x["id"], []).append(x["cosine"])
    table = df.dropDuplicates(["mv_id"]).select("mv_id", "raw_text").toArrow()
    at, x = nb.usable(table.column("raw_text"), 96)
    ids = np.asarray(table.column("mv_id"))[at]
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -2
        tenth = np.sort(score)[-10]
        hits += sum(c >= tenth - 1e-5 for c in got[int(ids[i])])
    assert hits >= 0.9 * 10 * (ids % 20 == 0).sum()


@pytest.mark.parametrize("query_rows", [30, 1000])
def test_blocks_dealt_out_give_the_same(spark, query_rows):
    df = spark.createDataFrame(rows(), SHAPE)
    args = dict(id_col="mv_id", fields=["raw_text"], dimension=16, block_rows=64, leaf_rows=8)
    some = sorted(map(tuple, nb.nearest_vectors(df, query_rows=query_rows, **args).select("id", "neighbor", "rank").collect()))
    assert some == sorted(map(tuple, nb.nearest_vectors(df, **args).select("id", "neighbor", "rank").collect()))


def test_queue_order():
    r = np.random.default_rng(1)
    x = r.normal(size=(512, 8)).astype(np.float32)
    t = nb.Tree(x, 4, 5)
    home = t.leaf(x)
    assert (t.keys(x).argmin(1) == home).all() and {int(n) for n in np.bincount(home)} <= set(range(28, 37))
    forest = nb.Forest(x, 4, 8, 2, 3)
    block, popped = forest.queue(x[:50], 2, 6)
    assert (popped.sum((1, 2)) == 6).all() and (block == forest.router.leaf(x[:50])[:, None]).any(1).all()
    same = np.ones((100, 8), np.float32)
    assert nb.Tree(same, 3, 5).leaf(same).max() < 8
