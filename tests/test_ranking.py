import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as ev
from corpusloom.operators import ranking as rk


def test_fusion(spark):
    lists = spark.createDataFrame([(1, "a", 1, 1.0), (1, "b", 2, 1.0), (1, "b", 1, 2.0), (2, "c", 1, 0.0)], "query_id int, doc_id string, rank int, weight double")
    got = {(x["query_id"], x["doc_id"]): x["fusion"] for x in rk.reciprocal_rank_fusion(lists).collect()}
    top = 1 / 62 + 2 / 61
    assert got[1, "b"] == 1.0 and abs(got[1, "a"] - (1 / 61) / top) < 1e-12 and got[2, "c"] == 0.0
    with pytest.raises(ValueError):
        rk.reciprocal_rank_fusion(lists, k=0)


def test_view_scores_skip_missing_views(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0], None, None)], "a array<double>, b array<double>, c array<double>, d array<double>")
    pairs = {"raw_text": (F.col("a"), F.col("b")), "titles": (F.col("c"), F.col("d"))}
    assert [x[0] for x in df.select(rk.weighted_view_score(pairs)).collect()] == [1.0, 0.0]
    with pytest.raises(ValueError):
        rk.normal_weights({"a": -1.0, "b": 2.0})


def test_policy_is_hard(spark):
    df = spark.createDataFrame([(0.9, 1.0, 0.5), (2.0, None, None), (0.01, -1.0, 1.0), (0.5, 0.0, 7.0)], "s double, f double, t double")
    got = [round(x[0], 9) for x in df.select(rk.policy_score(F.col("s"), F.col("f"), F.col("t"))).collect()]
    assert got == [0.475, 1.0, 0.0, 0.5]


def test_diversity_and_cap(spark):
    v = {"a": [1.0, 0.0], "b": [1.0, 0.01], "c": [0.0, 1.0], "d": None}
    rows = [(1, d, s, sc, v[d]) for d, s, sc in (("a", "s", 0.9), ("b", "s", 0.89), ("c", "t", 0.5), ("d", "s", 0.4))]
    hits = spark.createDataFrame(rows, "query_id int, doc_id string, source_id string, score double, vector array<double>")
    pick = [x["doc_id"] for x in rk.diversified(hits, k=3, balance=0.5, per_source=None).orderBy("position").collect()]
    assert pick == ["a", "c", "d"]
    assert [x["doc_id"] for x in rk.diversified(hits, k=9, balance=1.0, per_source=1).orderBy("position").collect()] == ["a", "c"]
    assert {x["doc_id"] for x in rk.source_capped(hits, 2).collect()} == {"a", "b", "c"}
    assert rk.diversified(hits.limit(0), k=3).count() == 0


def test_reranking_and_calls(spark):
    hits = spark.createDataFrame([(1, "a", 0.5, "q", "x y"), (1, "b", 0.4, "q", "q z")], "query_id int, doc_id string, score double, query string, text string")
    score = rk.callable_score(lambda q, t: [1.0 if a in b else 0.0 for a, b in zip(q, t)], "query", "text")
    assert {x["doc_id"]: x["score"] for x in rk.reranked(hits, score).collect()} == {"a": 0.0, "b": 1.0}
    assert {x["doc_id"]: round(x["score"], 6) for x in rk.reranked(hits, score, blend=0.5, top=1).collect()} == {"a": 0.25, "b": 0.4}
    sims = [x[0] for x in hits.select(rk.term_max_sim("query", "text")).collect()]
    assert sims[1] > 0.99 > sims[0]


def test_learned_rankers(spark, tmp_path):
    rows = [({"semantic": 1.0}, 1.0), ({"semantic": 0.0}, -1.0)] * 5
    m = rk.LinearRanker().fit(rows)
    assert m.weights["semantic"] > 1 and m.label(-0.5) == 0.25 and m.label(3) == 1.0
    m.save(tmp_path / "m.json")
    n = rk.LinearRanker.load(tmp_path / "m.json")
    df = spark.createDataFrame([(1.0,), (0.0,)], "semantic double")
    a, b = [x[0] for x in df.select(n.score({"semantic": F.col("semantic")})).collect()]
    assert a > 0.6 > b and abs(a - rk._sigmoid(m.bias + m.weights["semantic"])) < 1e-9
    p = rk.PairwiseRanker().fit_pairs([({"lexical": 1.0}, {"lexical": 0.2}, 1.0)])
    assert p.weights["lexical"] > 0 and p.bias == 0
    c = rk.PlattCalibrator().fit([(0.9, 1), (0.1, 0)] * 10)
    x, y = [r[0] for r in spark.createDataFrame([(0.9,), (0.1,)], "s double").select(c.predict(F.col("s"))).collect()]
    assert x > 0.5 > y


def test_feedback(spark):
    df = spark.createDataFrame([("A  b", "d", 5.0), ("a b", "d", -0.5), (None, "d", 1.0), ("a b", None, 1.0), ("a b", "e", None)], "query_text string, document_id string, relevance double")
    assert [tuple(x) for x in rk.feedback_scores(df).collect()] == [("a b", "d", 0.25)]


def test_metrics(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "x", 1)], "query_id int, item string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "z"), (2, "y")], "query_id int, item string")
    m = {x["query_id"]: x for x in ev.query_metrics(cases, ev.deduped_ranks(got), rel, k=2).collect()}
    assert (m[1]["precision_at_k"], m[1]["recall_at_k"], m[1]["reciprocal_rank"]) == (0.5, 0.5, 0.5)
    assert abs(m[1]["ndcg_at_k"] - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-12
    assert m[2]["ndcg_at_k"] == m[2]["reciprocal_rank"] == 0 and m[3]["recall_at_k"] == m[3]["ndcg_at_k"] == 1
    assert ev.report(ev.query_metrics(cases, ev.deduped_ranks(got), rel, k=2)).first()["n_cases"] == 3


def test_boundaries_and_citations(spark):
    df = spark.createDataFrame([(1, [10, 20, 30], [11, 30]), (2, [], []), (3, [], [1]), (4, [1], [])], "doc_id int, predicted array<int>, gold array<int>")
    a = {x["doc_id"]: (x["precision"], x["recall"]) for x in ev.boundary_f1(df).collect()}
    b = {x["doc_id"]: (x["precision"], x["recall"]) for x in ev.boundary_f1(df, tolerance=1).collect()}
    assert a[1] == (1 / 3, 0.5) and b[1] == (2 / 3, 1.0) and a[2] == b[2] == (1.0, 1.0) and a[3] == (0.0, 0.0) and a[4] == (0.0, 1.0)
    c = spark.createDataFrame([(["a"], ["a", "b"]), (None, []), (["a"], None)], "c array<string>, r array<string>")
    assert [x[0] for x in c.select(ev.citation_coverage(F.col("c"), F.col("r"))).collect()] == [0.5, 1.0, 1.0]


def test_optimizer_orders_by_objective():
    out = ev.optimize({"largest": [1, 2]}, lambda s: {"recall_at_k": s["largest"] / 2, "ndcg_at_k": 0.0, "reciprocal_rank": 0.0})
    assert list(out["largest"]) == [2, 1] and abs(out["objective"][0] - 0.7) < 1e-9
