import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as vec


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(0)
    data = [(i, [float(x) for x in r.normal(size=8)]) for i in range(60)]
    return data + [(60, None), (61, []), (62, [0.0] * 8), (63, [1.0] * 3), (64, data[0][1])]


def test_scalars(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = df.select(vec.l2_normalized(F.col("a")).alias("n"), vec.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert got[0]["n"] == [0.6, 0.8] and got[1]["n"] == [0.0, 0.0]
    assert [round(x["c"], 9) for x in got] == [1.0, 0.0, 0.0, 0.0]


def test_int8_rounds_half_to_even(spark):
    v = [127.0, 0.5, 1.5, -2.5, -127.0]
    got = spark.createDataFrame([(v,), ([],), ([0.0],)], "v array<double>").select(vec.int8_values(F.col("v")).alias("q"), vec.int8_scale(F.col("v")).alias("s")).collect()
    assert got[0]["q"] == [127, 0, 2, -2, -127] and got[0]["s"] == 1.0
    assert got[1]["q"] == [] and got[1]["s"] == 1.0 and got[2]["q"] == [0]


def test_top_k(spark, rows):
    df = spark.createDataFrame(rows, "doc_id int, vector array<double>")
    q = spark.createDataFrame([(i, v) for i, v in rows if i in (0, 5, 62, 60)], "query_id int, vector array<double>")
    got = {(x["query_id"], x["rank"]): (x["doc_id"], x["score"]) for x in vec.top_k(q, df, k=5).collect()}
    good = [(i, np.array(v)) for i, v in rows if v and len(v) == 8 and any(v)]
    for qi in (0, 5):
        qv = np.array(dict(rows)[qi])
        s = sorted(((-float(qv @ v / np.linalg.norm(qv) / np.linalg.norm(v)), i) for i, v in good), key=lambda x: (round(x[0], 9), x[1]))[:5]
        assert [got[qi, r][0] for r in range(1, 6)] == [i for _, i in s]
    assert not any(k[0] in (60, 62) for k in got)
    assert vec.top_k(q, df.where("doc_id < 0"), k=5).count() == 0


def test_two_stage_finds_the_same_on_nested_vectors(spark, rows):
    df = spark.createDataFrame(rows, "doc_id int, vector array<double>")
    q = spark.createDataFrame(rows[:3], "query_id int, vector array<double>")
    a = {(x["query_id"], x["doc_id"]) for x in vec.two_stage_top_k(q, df, k=3, coarse=6, widen=30).collect()}
    assert a == {(x["query_id"], x["doc_id"]) for x in vec.top_k(q, df, k=3).collect()}


def test_max_sim(spark):
    pages = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[1.0, 0.0]]), (3, []), (4, [[-1.0, 0.0]])], "page_id int, vectors array<array<double>>")
    q = spark.createDataFrame([(9, [[1.0, 0.0], [0.0, 2.0]])], "query_id int, vectors array<array<double>>")
    got = [(x["page_id"], x["score"]) for x in vec.max_sim(q, pages, k=4).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.5), (3, 0.0), (4, 0.0)]


def test_hash_embedding(spark):
    df = spark.createDataFrame([("red apple",), ("Red  APPLE",), ("",), (None,)], "t string").select(vec.hash_embedding("t", 64).alias("v"))
    a, b, c, d = [x["v"] for x in df.collect()]
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and not any(c) and d is None
    with pytest.raises(ValueError):
        vec.hash_embedding("t", 8)


def test_texts_are_embedded_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb"), (4, None)], "i int, t string")
    got = {x["i"]: x["v"] for x in vec.embedded_once(df, "t", "v", lambda ts: [[float(len(t))] for t in ts]).collect()}
    assert got == {1: [1.0], 2: [1.0], 3: [2.0], 4: None}
