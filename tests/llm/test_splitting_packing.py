import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing as pk
from corpusloom.llm import splitting as sp

TEXT = st.text(alphabet="ab.!? \n。的\r", max_size=400)


@given(TEXT, st.integers(5, 60), st.integers(0, 4))
@settings(deadline=None, max_examples=300)
def test_pieces(text, limit, overlap):
    level, pieces = sp.split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert b - overlap <= c <= b < d
    assert all(0 < b - a <= limit or not text for a, b in pieces)
    assert (level == "whole") == (len(text) <= limit)
    if level not in ("whole", "none"):
        anywhere = set(list(sp.boundaries(text))[2].end)  # white space at the end of a stretch may not fit beside it
        assert all(b in anywhere or text[b].isspace() or text[b - 1].isspace() for _, b in pieces[:-1])


def stretches(text, level):
    mark = (sp.BLANK, sp.SENTENCE, sp.SPACE)
    ends = sorted({m.end() for k in range(level + 1) for m in mark[k].finditer(text)} | {0, len(text)})
    return max((len(text[a:b].strip()) for a, b in zip(ends, ends[1:])), default=0)


@given(TEXT, st.integers(5, 60), st.integers(0, 4))
@settings(deadline=None, max_examples=300)
def test_level_is_the_strongest_that_keeps_the_limit(text, limit, overlap):
    if len(text) > limit:
        want = next((k for k in range(3) if stretches(text, k) <= limit), 3)
        assert sp.split_text(text, limit, overlap)[0] == sp.LEVELS[want]


@given(st.lists(st.integers(1, 30), min_size=20, max_size=80), st.integers(40, 60))
@settings(deadline=None, max_examples=200)
def test_fewest_pieces_with_room_for_the_overlap(words, limit):
    text, overlap = " ".join("x" * n for n in words), 8
    level, pieces = sp.split_text(text, limit, overlap)
    if level == "whole":
        return
    assert level == "word"
    ends, reached, k = [m.end() for m in sp.SPACE.finditer(text)] + [len(text)], 0, 0
    while reached < len(text):  # the furthest cut each time needs the fewest
        reached, k = max(e for e in ends + [m.start() for m in sp.SPACE.finditer(text)] + [reached] if e <= reached + limit - (overlap if k else 0)), k + 1
    assert len(pieces) == k
    assert all(c < b for (_, b), (c, _) in zip(pieces, pieces[1:]))  # every piece repeats something


def test_levels():
    para = "word " * 300
    assert sp.split_text((para.strip() + "\n \r\n") * 3)[0] == "paragraph"
    assert sp.split_text(("word " * 300).strip() + ". " + para)[0] == "sentence"
    assert sp.split_text("\r\n".join(["word " * 20] * 40))[0] == "word"  # one line end is no blank line
    assert sp.split_text("\r\n \r\n".join(["word " * 20] * 40))[0] == "paragraph"
    assert sp.split_text("的" * 1500 + "。" + "的" * 1500)[0] == "sentence"
    assert sp.split_text(para * 3)[0] == "word" and sp.split_text("x" * 5000)[0] == "none"
    assert len(sp.split_text("x" * 200_000)[1]) == 111


def test_balanced():
    _, pieces = sp.split_text("word " * 1000)
    sizes = [b - a for a, b in pieces]
    assert len(pieces) == 3 and max(sizes) - min(sizes) < 250


def test_split_items(spark):
    rows = [("page", 1, "a " * 1500, "x"), ("page", 2, None, "x"), ("page", 3, "", "x"), ("page", 4, "s" * 2000, "x"), ("page", 1, "a " * 1500, "x")]
    df = spark.createDataFrame(rows, "item_kind string, item_id long, text string, piece string")
    got = sp.split_items(df, keys=["item_kind", "item_id"], text="text")
    assert {x["item_id"] for x in got.collect()} == {1} and got.count() == 4 and got.distinct().count() == 2
    assert sp.split_items(df.limit(0), keys=["item_id"], text="text").count() == 0
    one = sorted(got.distinct().collect(), key=lambda x: x["piece_no"])
    assert one[0]["piece"] + one[1]["piece"][one[0]["end_char"] - one[1]["start_char"] :] == "a " * 1500


@pytest.mark.parametrize("seed", range(40))
def test_plans_pack_everything(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 10, 50, 1024])
    have = {r.randint(1, capacity): r.randint(1, 40) for _ in range(r.randint(0, 30))}
    plan, got = pk.packing_plan(have, capacity), {}
    for many, content in plan.runs:
        assert many > 0 and sum(s * n for s, n in content) <= capacity
        for s, n in content:
            got[s] = got.get(s, 0) + many * n
    assert got == have
    bins, total = sum(m for m, _ in plan.runs), sum(s * n for s, n in have.items())
    large = sum(n for s, n in have.items() if 2 * s > capacity)
    assert max(large, -(-total // capacity)) <= bins <= 1.7 * max(large, total / capacity) + 1


def best(items, capacity):
    """Fewest bins by search, for a handful of items."""
    items = sorted(items, reverse=True)
    low = len(items)

    def go(i, bins):
        nonlocal low
        if len(bins) >= low:
            return
        if i == len(items):
            low = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                go(i + 1, [*bins[:b], bins[b] + items[i], *bins[b + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return low


@pytest.mark.parametrize("seed", range(400))
def test_reduction_keeps_the_optimum(seed):
    r = random.Random(100 + seed)
    capacity = r.choice([10, 12, 20, 30])
    low, high = (1, capacity) if seed % 2 else (max(1, capacity // 6), capacity * 2 // 3)
    items = [r.randint(low, high) for _ in range(r.randint(3, 9))]
    count = pk.np.zeros(capacity + 1, pk.np.int64)
    for s in items:
        count[s] += 1
    plan = pk.Plan(capacity)
    pk.reduce_dominated(count, plan)
    rest = [s for s in range(capacity + 1) for _ in range(count[s])]
    assert plan.containers() + best(rest, capacity) == best(items, capacity)
    assert best(items, capacity) <= pk.packing_plan(dict(Counter(items)), capacity).containers() <= best(items, capacity) + 1


def test_no_pair_is_fixed_where_three_fit():
    have = {10: 1, 8: 2, 4: 1, 3: 3}
    count = pk.np.zeros(21, pk.np.int64)
    for s, n in have.items():
        count[s] = n
    plan = pk.Plan(20)
    pk.reduce_dominated(count, plan)
    assert not plan.runs and pk.packing_plan(have, 20).containers() == 2


def test_reduction_fixes_what_dominates():
    for have, capacity, fixed in (({7: 2, 3: 2}, 10, [(7, 1), (3, 1)]), ({8: 1, 5: 1}, 10, [(8, 1)]), ({6: 1, 3: 1, 2: 1}, 10, [(6, 1), (3, 1)]), ({10: 1, 5: 1, 4: 1}, 20, [(10, 1), (5, 1), (4, 1)])):
        count = pk.np.zeros(capacity + 1, pk.np.int64)
        for s, n in have.items():
            count[s] = n
        plan = pk.Plan(capacity)
        pk.reduce_dominated(count, plan)
        assert fixed in [content for _, content in plan.runs]


def test_pack_texts(spark):
    words = "the quick brown fox jumps over a lazy dog and runs away".split()
    r = random.Random(0)
    rows = [(i, " ".join(r.choices(words, k=r.choice([3, 20, 60, 400])))) for i in range(120)] + [(500, None), (501, ""), (502, "word " * 2500), (3, "again"), (None, "no key")]
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, size int, salt string")
    got = pk.pack_texts(df, key="doc_id", text="text", capacity=256).collect()
    sums: dict = {}
    for x in got:
        sums[x["container_id"]] = sums.get(x["container_id"], 0) + x["n_tokens"]
    assert max(sums.values()) <= 256 and sorted(sums) == list(range(len(sums)))
    encode = pk.tokenizer(pk.read_ranks(pk.TOKENIZERS, "byte_bpe_50k.tiktoken")).encode_ordinary
    assert sum(sums.values()) == sum(len(encode(t or "")) for _, t in rows)
    long = sorted((x["piece_no"], x["start_token"], x["n_tokens"]) for x in got if x["doc_id"] == 502)
    assert [p for p, _, _ in long] == list(range(len(long))) and all(s == 256 * p for p, s, _ in long) and len(long) > 1
    assert all(sum(1 for x in got if x["doc_id"] == i and x["piece_no"] == 0) == (2 if i == 3 else 1) for i, _ in rows)
    assert {x["container_id"] for x in got if x["doc_id"] in (500, 501)} == {0}
    assert len(sums) <= sum(sums.values()) / 256 * 1.15 + 2
    assert pk.pack_texts(df.limit(0), key="doc_id", text="text").count() == 0
