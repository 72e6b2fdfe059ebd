import pytest

from corpusloom.llm import scans as sc

TEXT = ["The source archive keeps all table rows for the legal desk.", "After some weeks the policy file rejects broken links.", "The long-lived index counts ratings in every tenant again."]
SHAPE = "block_id long, source_id string, page int, block_no int, text string, ocr_confidence double, noise string, lang string"


def book(source, first, pages=6, conf=0.8, seps="-", crlf=False):
    rows = []
    for p in range(1, pages + 1):
        head = "DENSE INDEX NOTES" if p % 2 else "O l d   g u i d e"
        body = [f"{head}   {p + 10}", "", *(TEXT if p > 1 else ["Dense index notes", *TEXT])]
        rows.append((first + p, source, p, 0, ("\r\n" if crlf else "\n").join(body), conf, "x", "en"))
    return rows


@pytest.fixture(scope="module")
def blocks():
    rows = book("scan", 0) + book("more", 100, crlf=True) + book("digital", 200, conf=None)
    noisy = "\n".join(["OLD GUIDC   l7", "", "The sourcc archive keeps all t@ble ra-", "tings for the legal desk. After some weeks the lon-", "g", "12", "The long-", "lived index forwarcls utf8 links. The poli\xad"])
    rows.append((50, "scan", 7, 0, noisy, 0.7, "x", "en"))
    rows.append((51, "scan", 8, 0, "O l d   g u i d e   18\n\ncy file utf8 links. After utf8 weeks.", None, "x", "en"))
    rows += [(52, "scan", 8, 1, None, 0.7, "x", "en"), (53, "scan", 8, None, "  \n ", 0.7, "x", "en"), (None, "scan", 8, 2, "no id", 0.7, "x", "en"), rows[0]]
    rows += [(300 + i, "words", i + 1, 0, "forwards the utf8 ratings, all ratings, table links for policy files and policy file forwards", None, "x", "en") for i in range(20)]
    return rows


def test_noise(spark, blocks):
    df = spark.createDataFrame(blocks, SHAPE)
    got = {tuple(x) for x in sc.scanned_noise(df).collect()}
    heads = {(b, 1, k) for b in [*range(1, 7), *range(101, 107), 51] for k in ("running_head", "page_no")} | {(50, 1, "running_head"), (50, 1, "page_no")}
    assert {x for x in got if x[2] in ("running_head", "page_no")} == heads
    assert {x for x in got if x[0] == 50 and x[2] == "wrong_char"} == {(50, 3, "wrong_char"), (50, 8, "wrong_char")}
    splits = {x[:2] for x in got if x[2] == "split_word"}
    assert (50, 3) in splits and (50, 8) in splits and (50, 7) not in splits
    assert not any(200 < x[0] < 300 for x in got) and {x[0] for x in got if x[2] == "wrong_char"} == {50}


def test_paragraphs(spark, blocks):
    got = {}
    for x in sc.repaired_paragraphs(spark.createDataFrame(blocks, SHAPE)).orderBy("source_id", "page", "para_no").collect():
        got.setdefault((x["source_id"], x["page"]), []).append(x["text"])
    assert got["scan", 2] == [" ".join(TEXT)] and got["scan", 1][0].startswith("Dense index notes The source")
    assert got["digital", 3][0].startswith("DENSE INDEX NOTES   13\n\n")
    seven = " ".join(got["scan", 7])
    assert "The source archive keeps all table ratings for" in seven and "The long-lived index forwards utf8 links. The policy" in seven
    assert got["scan", 7][-1].endswith("The policy file utf8 links. After utf8 weeks.") and ("scan", 8) not in got  # one paragraph over two pages


def test_paragraph_over_many_pages(spark):
    """A paragraph that fills pages of its own is one row; a heading at a page's end and a sentence's end stop it."""
    page = lambda n, *lines: (n, "s", n, 0, "\n".join(lines), 0.8, "x", "en")
    rows = [
        page(1, "The first text stands here and ends.", "", "The owner of the list should keep"),
        page(2, "all rows of the archive and also"),
        page(3, "the notes of the desk, as the policy"),
        page(4, "asks. Another sentence ends here.", "", "A heading"),
        page(5, "The owner of the list should keep all rows."),
        (6, "s", None, 0, "no page", 0.8, "x", "en"),
        (7, None, 2, 0, "no file, and it goes on with words", 0.8, "x", "en"),
        (8, None, 3, 0, "to the next page of it.", 0.8, "x", "en"),
    ]
    got = {(x["source_id"], x["page"], x["para_no"]): x["text"] for x in sc.repaired_paragraphs(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got["s", 1, 1] == "The owner of the list should keep all rows of the archive and also the notes of the desk, as the policy asks. Another sentence ends here."
    assert got["s", 1, 0] == "The first text stands here and ends." and got["s", 4, 1] == "A heading" and got["s", 5, 0].startswith("The owner") and got["s", None, 0] == "no page"
    assert got[None, 2, 0] == "no file, and it goes on with words" and got[None, 3, 0] == "to the next page of it." and len(got) == 7


def test_empty(spark, blocks):
    df = spark.createDataFrame(blocks, SHAPE).limit(0)
    assert sc.scanned_noise(df).count() == 0 and sc.repaired_paragraphs(df).count() == 0


def test_readings():
    assert sc.printed_number("[12]") == [("arabic", 12, True)] and sc.printed_number("Seite 3")[0][:2] == ("arabic", 3)
    assert ("roman", 4, False) in sc.printed_number("iv") and sc.printed_number("l9/24")[0][:2] == ("arabic", 19)
    assert sc.edge_readings("120   N a ï v e   t a s k")[:2] == ("Naïve task", "wide+")
    assert sc.edge_readings("— 1 2 —")[2][0][:2] == ("arabic", 12) and sc.roman("lc") is None


def test_a_word_that_is_a_word_can_be_misread():
    """The context decides, not a bound on counts; all candidates of a form compete."""
    words = {"the": 400, "old": 60, "tree": 60, "free": 50, "falls": 40, "copy": 60}
    lex = sc.Lexicon(words, {("old", "tree"): 50, ("tree", "falls"): 40, ("free", "copy"): 50, ("the", "free"): 30}, 2000)
    assert [w for w, _ in sc.decoded(["old", "free", "falls"], lex)] == ["old", "tree", "falls"]
    assert [w for w, _ in sc.decoded(["the", "free", "copy"], lex)] == ["the", "free", "copy"]
    many = {f"{a}a{b}": 30 + i for i, (a, b) in enumerate((x, y) for x in ("lo", "io", "l0", "1o", "i0") for y in ("se", "5e", "sc"))}
    lex = sc.Lexicon(many, {}, 1000)
    assert len(lex.options("10a5e")) > 9  # no candidate is left out


def test_channel():
    lex = sc.Lexicon({"forward": 50, "customer": 40, "journal": 9, "size": 30, "utf8": 20}, {}, 1000)
    for read, want in (("forwarcl", "forward"), ("ciistomer", "customer"), ("joumal", "journal"), ("5ize", "size"), ("utf8", "utf8"), ("other", "other")):
        assert sc.decoded([read], lex)[0][0] == want
    assert sc.decoded(["forwarcl"], lex)[0][1] == [6, 7]


def test_rare_words_count_at_every_size_of_the_corpus(spark, blocks):
    rows = [(1, "scan", 1, 0, "The tamwes rejects links.\nThe tarnwes rejects links.\nThe tamwes rejects links.", 0.8, "x", "en")]
    rows += [(10 + i, "long", i, 0, ("links and rows " * 100 + "\n") * 100, None, "x", "en") for i in range(70)]
    df = spark.createDataFrame(rows, SHAPE)
    assert {tuple(x) for x in sc.scanned_noise(df).collect()} == {(1, 2, "wrong_char")}


def test_fetched_entries_repair_as_the_whole_lexicon(spark, blocks, monkeypatch):
    df = spark.createDataFrame(blocks, SHAPE)
    whole = {str(x) for x in sc._repaired(df)[0].collect()}
    monkeypatch.setattr(sc, "GROUP", 2)
    assert {str(x) for x in sc._repaired(df, lexicon_rows=0)[0].collect()} == whole
