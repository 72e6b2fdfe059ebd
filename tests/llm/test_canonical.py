import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import canonical as cn
from corpusloom.llm import words as wd


def slow(text: str) -> str:
    """The same form character by character, composed by the Unicode library."""
    t = cn.tables()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out = "".join(chr(x) for ch in text for x in t.flat[t.start[ord(ch)] : t.start[ord(ch)] + t.length[ord(ch)]])
    return unicodedata.normalize("NFC", out)


MARKED = st.text(alphabet="aeouiциеАИ\r\n " + "゙̧̣̀́̈̆" + "かはﾊﾞｶ한ᄀ각ﬁｅ​­éйёї", max_size=40)


@given(st.lists(st.one_of(MARKED, st.text(max_size=30)), max_size=6))
@settings(deadline=None)
def test_against_one_by_one(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert cn.canonical_batch(pa.array(texts, pa.string())).to_pylist() == [slow(t) for t in texts]


def test_equal_looks_are_equal():
    same = ["Café １-a", "Café 1‐а", "C​afé 1‑a﻿", "Сafé ۱－a"]
    assert len(set(cn.canonical_batch(pa.array(same)).to_pylist())) == 1
    differ = ["Cafe 1-a", "café 1-a", "Café  1-a", "Café\n1-a", "Café 1—a", "Café 1-a."]
    assert len(set(cn.canonical_batch(pa.array([same[0], *differ])).to_pylist())) == 7
    assert cn.canonical_batch(pa.array(["كي", "ﬁn\r\nx"])).to_pylist() == ["کی", "fin\nx"]


def test_idempotent_and_windows(monkeypatch):
    text = ["а́б ｶﾞ " * 50 + "x" + "́" * 40, "", None, "​"]
    once = cn.canonical_batch(pa.array(text))
    assert once.to_pylist()[1:] == ["", None, ""] and cn.canonical_batch(once).to_pylist() == once.to_pylist()
    monkeypatch.setattr(cn, "WINDOW", 16)
    assert cn.canonical_batch(pa.array(text)).to_pylist() == once.to_pylist()
    assert cn.canonical_batch(pa.array([], pa.string())).to_pylist() == []
    assert cn.canonical_batch(pa.array(text).slice(1, 2)).to_pylist() == ["", None]


def test_long_text():
    text = "Ｗｏｒｄ é " * 400_000
    assert cn.canonical_batch(pa.array([text])).to_pylist()[0] == "Word é " * 400_000


def test_words_follow_case_and_script():
    hashes = lambda t: wd.word_hashes(pa.array([t]))[0].tolist()
    assert hashes("Straße, Новый!") == hashes("STRASSE новый")
    assert hashes("dоg") == hashes("DOG") != hashes("dig")
    h, row, size = wd.word_hashes(pa.array(["a b", None, "", "c"]))
    assert row.tolist() == [0, 0, 3] and size.tolist() == [1, 1, 1] and len(np.unique(h)) == 3


def test_column_and_pairs(spark):
    rows = [(1, "Café"), (2, "Café"), (3, "Café"), (4, None), (5, ""), (6, "​"), (7, "x"), (7, "x")]
    df = spark.createDataFrame([(i, t, "f", "s") for i, t in rows], "doc_id long, text string, form string, spelling string")
    got = {tuple(x) for x in cn.look_alike_pairs(df, key="doc_id", text="text").collect()}
    assert got == {(1, 2), (2, 3), (5, 6)}
    assert cn.look_alike_pairs(df.limit(0), key="doc_id", text="text").count() == 0
    assert [x[0] for x in df.orderBy("doc_id").select(cn.canonical_text("text")).collect()][:5] == ["Café", "Café", "Café", None, ""]


def test_classes(spark):
    rows = [(1, "Café"), (2, "Cafe\u0301"), (3, "Café"), (4, None), (7, "x"), (7, "x"), (8, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["key"], x["representative"]) for x in cn.look_alike_classes(df, key="doc_id", text="text").collect()}
    assert got == {(1, 1), (3, 1), (2, 2)}
    assert cn.look_alike_classes(df.limit(0), key="doc_id", text="text").count() == 0
    many = spark.createDataFrame([(i, "page head" + "\u200b" * (i % 40)) for i in range(2000)], "doc_id long, text string")
    assert cn.look_alike_classes(many, key="doc_id", text="text").count() == 2000  # a row a document, not a pair
