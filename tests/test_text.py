import re
import unicodedata

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def test_normal_form():
    assert tx.normal_form("  a\tb \n\n  c  ") == "a b\nc"
    assert tx.normal_form("a\n\n\n\nb", paragraphs=True) == "a\n\nb"
    assert tx.normal_form("كتاب ي ٣ ۴") == "کتاب ی 3 4"
    assert tx.normal_form("می‌شود") == "می‌شود"
    assert tx.normal_form("a\nb", newlines=False) == "a b"
    assert tx.normal_form("سَلام") == "سلام"


@given(st.text(max_size=60))
def test_spans_point_at_their_source(text):
    out, at = tx.normal_form_spans(text)
    assert len(out) == len(at) and at == sorted(at)
    assert all(0 <= i < len(text) for i in at)
    assert out == tx.normal_form(text)


def test_columns(spark):
    df = spark.createDataFrame([(1, "Fix ERR_DB-7312 at https://x.y/z now. Done!\nNext"), (2, None), (3, "")], "id int, t string")
    r = {x["id"]: x for x in df.select("id", tx.token_count(tx.normalized("t")).alias("n"), tx.terms(tx.folded("t")).alias("w"), tx.identifiers(F.col("t")).alias("i"), tx.sentence_parts(F.col("t")).alias("s")).collect()}
    want = re.findall(r"[\w\-]+|[^\w\s]", tx.normal_form("Fix ERR_DB-7312 at https://x.y/z now. Done!\nNext"))
    assert r[1]["n"] == len(want) and r[1]["i"] == ["ERR_DB-7312", "https://x.y/z"]
    assert r[1]["w"][:2] == ["fix", "err_db-7312"] and r[1]["s"] == ["Fix ERR_DB-7312 at https://x.y/z now.", "Done!", "Next"]
    assert r[3]["w"] == [] and r[2]["w"] is None


def test_original_span(spark):
    row = spark.createDataFrame([("  a  b ",)], "t string").select(tx.normalized_spans("t").alias("n"))
    s = row.select(tx.original_span(F.col("n.offsets"), F.lit(2), F.lit(3)).alias("s")).first()["s"]
    assert (s["start"], s["end"]) == (5, 6)
    assert row.select(tx.original_span(F.col("n.offsets"), F.lit(9), F.lit(10)).alias("s")).first()["s"] is None


def test_ids_are_stable():
    a = tx.stable_chunk_id("s", "1", "code", ["x"], "Text", 0)
    assert a == tx.stable_chunk_id("s", "1", "code", ["x"], " text ", 0) != tx.stable_chunk_id("s", "1", "code", ["x"], "Text", 1)
    assert a.startswith("s:chunk:") and len(a) == len("s:chunk:") + 24


def test_each_character_is_normalized_alone():
    text = unicodedata.normalize("NFD", "é") + "ﬁ"
    assert tx.normal_form(text) == unicodedata.normalize("NFD", "é") + "fi"


def test_injected_tokenizer(spark):
    df = spark.createDataFrame([("abcde",), ("",), (None,)], "t string")
    got = df.select(tx.tokenizer_count("t", list).alias("n"), tx.tokenizer_split("t", list, "".join, 2).alias("p"), tx.point_id("t").alias("u")).collect()
    assert [x["n"] for x in got] == [5, 0, 0] and got[0]["p"] == ["ab", "cd", "e"] and got[2]["p"] == []
    assert len(got[0]["u"]) == 36 and got[2]["u"] is None
