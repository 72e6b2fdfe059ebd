import timeit

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import sentences as se

LINES = {
    "en": ["The old log counts all files before noon.", "Project Norvik shows that the index keeps 12 files.", "After 9 weeks the cache drops old rows.", "Readers should copy the table again."],
    "de": ["Der Index prüft die Seiten nach der Prüfung.", "Die Liste zählt alle Wörter am Abend.", "Das Archiv löscht leere Felder in der Nacht."],
    "ru": ["Журнал проверки теряет сноски после аудита.", "Архив хранит длинные абзацы в регионе.", "Индекс сравнивает две редакции ночью."],
    "hi": ["खोज सूचकांक नई संख्या पाता है।", "लेखा अभिलेख प्रकाशन रोकता है।", "प्रवेश कतार लंबे अनुच्छेद रखता है।"],
    "zh": ["搜索索引取得新的编号。", "访问名单推迟了发布。", "章节表丢失了脚注。"],
    "th": ["คิวนำเข้าเก็บย่อหน้ายาว", "ทีมแปลเลื่อนการเผยแพร่", "รายการสิทธิ์ลบเวกเตอร์เก่า"],
}


@pytest.fixture(scope="module")
def model():
    texts = []
    for own in LINES.values():
        for i in range(30):
            a, b, c = (own[(i + k) % len(own)] for k in range(3))
            texts += [f"{a} {b}\n\n{c}", f"{a}\n{b} {c}", f"{a} {b} {c}"]
    return se.fit(texts)


CASES = [
    ["Dr. Smith met J. K. Novak at 9.30 p.m. on Jan. 4.", "It cost $3.50, i.e. too much.", "Was it? ", "Yes!"],
    ['"Is it ready?" asked the man.', "Never mind.", "(See also vol. 9.)", 'The memo (it began "Dear all. Please wait.") came late.'],
    ["„Ist der Auftrag 30 fertig?“, fragte Frau Eps.", "Am 8. Mai wurde Nr. 80 geprüft, z. B. durch Frau Fen.", "Gemeint sind Listen usw. aus Fassung 1.33."],
    ["« Le dossier est-il prêt ? » demanda Mme Pel.", "Voir l'art. 9, p. 92.", "M. Cort répond : « Oui. »", "La suite arrive."],
    ["—¿Quién firma? —preguntó el Sr. Ola.", "El aviso «¡No escanear!» sigue ahí."],
    ["Open index.v9.json or https://docs.example/a.html now.", "Wait... the job runs.", "It was sent to Viks Inc.", "The end."],
]


@pytest.mark.parametrize("parts", CASES)
def test_cases(model, parts):
    parts = [p.strip() for p in parts]
    text = "  " + " ".join(parts) + " "
    assert [text[a:b] for a, b in se.units(text, model)] == parts


@pytest.mark.parametrize("text,want", [
    ("第7版真的结束了吗？！“34号准备好了吗？”操作员问道。章节表丢失了脚注。", ["第7版真的结束了吗？！", "“34号准备好了吗？”操作员问道。", "章节表丢失了脚注。"]),
    ("小组写道：“第9版已过期。”标签上的“禁止重扫！”字样很醒目。等等……还有39件。", ["小组写道：“第9版已过期。”", "标签上的“禁止重扫！”字样很醒目。", "等等……还有39件。"]),
    ("（第7章を参照。）資料は番号を受け取ります。「51番ですか。」と担当者が尋ねた。", ["（第7章を参照。）", "資料は番号を受け取ります。", "「51番ですか。」と担当者が尋ねた。"]),
    ("खोज सूचकांक नई संख्या पाता है।डॉ. वेलन ने संस्करण 8.66 देखा।", ["खोज सूचकांक नई संख्या पाता है।", "डॉ. वेलन ने संस्करण 8.66 देखा।"]),
    ("ทีมแปลรุ่น 1.33 MB แจ้งหัวข้อ คิวนำเข้าลบเวกเตอร์", ["ทีมแปลรุ่น 1.33 MB แจ้งหัวข้อ", "คิวนำเข้าลบเวกเตอร์"]),
    ("«من راجع القسم 19؟» هذا سؤال المدقق. حجم الملف 22.27 ميغابايت.", ["«من راجع القسم 19؟» هذا سؤال المدقق.", "حجم الملف 22.27 ميغابايت."]),
    ("The old log ends.The new one starts. Open index.V9 now. Edition 6.84.\n6. Next item", ["The old log ends.", "The new one starts.", "Open index.V9 now.", "Edition 6.84.", "6. Next item"]),
    ('He said, "It ended." 章节表丢失了脚注。"Is it ready?" asked Ann.', ['He said, "It ended."', "章节表丢失了脚注。", '"Is it ready?" asked Ann.']),
    ("Some heading\n- The first item\n2. The second item\n\nThe old log counts\nall files.", ["Some heading", "- The first item", "2. The second item", "The old log counts\nall files."]),
])
def test_scripts(model, text, want):
    assert [text[a:b] for a, b in se.units(text, model)] == want


def test_unmarked_lines(model):
    text = "After 9 weeks the cache drops old rows\nReaders should copy the table again\nDer Index prüft die Seiten nach der Prüfung\nDie Liste zählt alle Wörter am Abend"
    assert len(se.units(text, model)) == 4


def test_blank(model):
    assert se.units("", model) == se.units(" \n\n\t", model) == []
    assert se.fit([]).weight == {}


def test_long_text(model):
    text = "The old log counts all files. " * 20_000
    assert len(se.units(text, model)) == 20_000


@pytest.mark.parametrize("part", ['He said "it works. It does," and left (see fig. 3). “Quoted. Text.” ', "A. B. ", "((( . a. ", "的。", "\n1. a", "(]", "a.B "])
def test_time_grows_with_length(part):
    empty, took = se.Model(), []
    for n in (20_000, 160_000):
        text = (part * (n // len(part) + 1))[:n]
        took.append(min(timeit.repeat(lambda: se.units(text, empty), number=1, repeat=3)))
    assert took[1] < 24 * took[0] + 0.05  # eight times as long; quadratic work would take 64 times


def test_no_window_on_words(model):
    long = "a" * 300
    text = f"The {long}. Readers should copy it again."
    assert [text[a:b] for a, b in se.units(text, model)] == [f"The {long}.", "Readers should copy it again."]
    o = se.Outline(f"x {long}" + " " * 200 + "Word")
    assert o.first_word(302) == "Word" and o.last_word(302) == long


def test_every_place_is_decoded(model):
    """Against all rules, strong enough evidence moves a boundary: no tag is fixed before decoding."""
    text = "The old log counts all files. Readers should copy it again."
    other = se.Model()
    other.weight = dict(model.weight) | {"rule1": -100.0}
    assert len(se.units(text, model)) == 2 and len(se.units(text, other)) == 1


def test_quotes_of_two_kinds_in_a_paragraph(model):
    text = "小组写道：“第9版已过期。” Eps schrieb: „Die Liste zählt alle Wörter.“ Der Index prüft die Seiten."
    assert [text[a:b] for a, b in se.units(text, model)] == ["小组写道：“第9版已过期。”", "Eps schrieb: „Die Liste zählt alle Wörter.“", "Der Index prüft die Seiten."]


def test_spark(spark):
    rows = [(str(i), "The old log counts all files. Readers should copy it again.", "x", 1) for i in range(5)]
    df = spark.createDataFrame([*rows, ("n", None, "x", 1), ("e", "", "x", 1), rows[0]], "id string, text string, sentence string, k int")
    got = se.sentence_units(df, key="id", text="text")
    assert got.count() == 12 and got.distinct().count() == 10
    assert got.where(F.length("sentence") != F.col("end_char") - F.col("start_char")).count() == 0
    assert se.sentence_units(df.limit(0), key="id", text="text").count() == 0


def _break_rows():
    """Distinct texts of several languages, and one text repeated often."""
    known = [(f"k{i}", f"{own[i % len(own)]} {own[(i + 1) % len(own)]}\n{own[(i + 2) % len(own)]} {i}.", "x", 1) for own in LINES.values() for i in range(12)]
    return known + [("dup", "Some text. And more.", "x", 1)] * 60


def test_counts_cover_all_distinct_texts(spark):
    df = spark.createDataFrame(_break_rows(), "id string, text string, sentence string, k int")
    model = se.fit_sample(df, key="id", text="text", sample_rows=1)
    texts = sorted({r[1] for r in _break_rows()})
    want = se.Model().load(se._local(se.tally(texts)[0]))
    assert model.starts == want.starts and model.ends == want.ends and model.inside == want.inside
    assert abs(se._entries(se._texts(df, "text"))[1] - se.wrap_share(want, se.tally(texts)[0]["b"])) < 1e-9


def test_fetched_counts_cut_as_the_whole(spark):
    df = spark.createDataFrame(_break_rows(), "id string, text string, sentence string, k int")
    whole, fetched = ({tuple(x) for x in se.sentence_units(df, key="id", text="text", count_rows=n).collect()} for n in (10**9, 0))
    assert whole == fetched and len(whole) > 100
