import math
from collections import Counter

import pytest

from corpusloom.operators import lexical

DOCS = [(1, "red apple pie", "fruit"), (2, "green apple apple", "fruit"), (3, "ERR-4711 failed in red state", "log"), (4, "", None), (5, None, "log"), (6, "red apple pie", "fruit")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id int, text string, kind string")


def brute(query, k1=1.5, b=0.75):
    words = {i: (t or "").lower().split() for i, t, _ in DOCS}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for q in query.lower().split():
        df = sum(q in w for w in words.values())
        for i, w in words.items():
            if tf := Counter(w)[q]:
                out[i] = out.get(i, 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


@pytest.mark.parametrize("query", ["apple", "red apple apple", "nothing here", ""])
def test_bm25(spark, docs, query):
    q = spark.createDataFrame([(7, query)], "query_id int, query string")
    got = [(x["doc_id"], x["score"]) for x in lexical.bm25(q, docs, fields={"body": "text"}, k=4).orderBy("rank").collect()]
    want = brute(query)[:4]
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want))


def test_allowed_rows_keep_corpus_statistics(spark, docs):
    q = spark.createDataFrame([(7, "apple")], "query_id int, query string")
    all_of = {x["doc_id"]: x["score"] for x in lexical.bm25(q, docs, fields={"body": "text"}).collect()}
    some = lexical.bm25(q, docs, fields={"body": "text"}, allowed=docs.where("doc_id = 2").select("doc_id")).collect()
    assert [(x["doc_id"], x["score"]) for x in some] == [(2, all_of[2])]


def test_fields_add_by_weight(spark, docs):
    q = spark.createDataFrame([(7, "fruit apple")], "query_id int, query string")
    one = {x["doc_id"]: x["score"] for x in lexical.bm25(q, docs, fields={"body": "text"}).collect()}
    two = {x["doc_id"]: x["score"] for x in lexical.bm25(q, docs, fields={"titles": "kind"}).collect()}
    both = {x["doc_id"]: x["score"] for x in lexical.bm25(q, docs, fields={"body": "text", "titles": "kind"}).collect()}
    assert all(abs(s - one.get(i, 0) - 1.8 * two.get(i, 0)) < 1e-9 for i, s in both.items())


def test_exact_terms_inside_queries(spark, docs):
    index = lexical.exact_terms(docs)
    assert [(x["doc_id"], x["term"]) for x in index.collect()] == [(3, "err-4711")]
    q = spark.createDataFrame([(1, "why ERR-4711?"), (2, "err-4712"), (3, "")], "query_id int, query string")
    got = lexical.exact_search(q, index, k=5).collect()
    assert [(x["query_id"], x["doc_id"]) for x in got] == [(1, 3)] and abs(got[0]["score"] - (1 + 8 / 13)) < 1e-9


def test_sparse(spark, docs):
    q = lexical.sparse_terms(spark.createDataFrame([(1, "apple")], "query_id int, query string"), id_col="query_id", text="query")
    got = [(x["doc_id"], round(x["score"], 6)) for x in lexical.sparse_search(q, lexical.sparse_terms(docs), k=9).orderBy("rank").collect()]
    assert got == [(2, round(1 + math.log(2), 6)), (1, 1.0), (6, 1.0)]


def test_many_query_terms(spark, docs, monkeypatch):
    q = spark.createDataFrame([(7, "red apple")], "query_id int, query string")
    few = lexical.bm25(q, docs, fields={"body": "text", "titles": "kind"}).collect()
    monkeypatch.setattr(lexical, "TERMS", 0)
    assert sorted(map(tuple, lexical.bm25(q, docs, fields={"body": "text", "titles": "kind"}).collect())) == sorted(map(tuple, few))


def test_injected_sparse_encoder(spark, docs):
    got = lexical.sparse_encoded(docs, lambda texts: [{len(t): 1.0} if t else {} for t in texts]).collect()
    assert {(x["doc_id"], x["dim"], x["weight"]) for x in got} == {(1, 13, 1.0), (2, 17, 1.0), (3, 28, 1.0), (6, 13, 1.0)}
