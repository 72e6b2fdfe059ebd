import random
from datetime import datetime, timedelta

import pytest

from corpusloom.operators.orphans import orphan_references, orphan_report

REFS = "feedback_id long, document_id string, created_at timestamp_ntz, id int, r string, k string"
DOCS = "id string, created_at timestamp_ntz, deleted_at timestamp_ntz, document_id string"
NAMES = dict(ref_id="feedback_id", ref_key="document_id", ref_time="created_at", target_key="id", target_from="created_at", target_to="deleted_at")
T0 = datetime(2025, 1, 1)


def brute(refs, docs):
    out = set()
    for fid, key, at, *_ in refs:
        k = (key or "").strip().lower()
        if not k:
            continue
        own = [(s, e) for d, s, e, _ in docs if (d or "").strip().lower() == k]
        if not own:
            out.add((fid, "missing", at and at.strftime("%Y-%m")))
        elif at is not None and not any(s and s <= at and (e is None or at < e) for s, e in own):
            out.add((fid, "deleted" if any(s and s <= at for s, _ in own) else "late", at.strftime("%Y-%m")))
    return out


def rows(seed):
    r = random.Random(seed)
    day = lambda: T0 + timedelta(days=r.randint(0, 90), hours=r.randint(0, 3))
    keys = ["a", "b", "c", "D ", "e"]
    docs = []
    for _ in range(r.randint(0, 25)):
        s = day()
        docs.append((r.choice(keys), r.choice([s, s, s, None]), r.choice([None, s + timedelta(days=r.randint(-3, 40))]), "x"))
    refs = [(i, r.choice([*keys, " A\t", "d", "zz", "", " ", None]), r.choice([day(), day(), day(), None]), 1, "r", "k") for i in range(60)]
    refs += [(100 + i, "a", day(), 1, "r", "k") for i in range(60)]  # a hot key
    return refs + refs[:5], docs


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"heavy_share": 1.1}), (3, {"heavy_share": 0.05}), (4, {"max_spans": 0}), (5, {"max_spans": 1, "heavy_share": 0.05}), (6, {"broadcast_rows": 0})])
def test_against_brute_force(spark, seed, options):
    refs, docs = rows(seed)
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(docs, DOCS), **NAMES, **options).collect()
    assert len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == brute(refs, docs)


def test_heavy_keys_are_decided_one_by_one(spark):
    """A heavy key with many lifetimes is salted by itself; another heavy key is still not shuffled."""
    day = lambda n: T0 + timedelta(days=n)
    docs = [("a", day(2 * i), day(2 * i + 1), "x") for i in range(40)] + [("b", day(0), day(30), "x")]
    refs = [(i, "a", day(i % 90) + timedelta(hours=i % 24), 1, "r", "k") for i in range(300)] + [(1000 + i, "b", day(i % 90), 1, "r", "k") for i in range(300)]
    refs += [(2000 + i, "zz", day(i % 90), 1, "r", "k") for i in range(300)] + [(3000 + i, f"n{i}", day(i % 90), 1, "r", "k") for i in range(20)]
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(docs, DOCS), **NAMES, heavy_share=0.1, max_spans=8)
    assert sorted(map(tuple, got.collect())) == sorted(brute(refs, docs))


def test_empty_tables(spark):
    refs, docs = rows(7)
    none_r, none_d = spark.createDataFrame([], REFS), spark.createDataFrame([], DOCS)
    assert orphan_references(none_r, spark.createDataFrame(docs, DOCS), **NAMES).count() == 0
    assert orphan_references(none_r, none_d, **NAMES).count() == 0
    got = orphan_references(spark.createDataFrame(refs, REFS), none_d, **NAMES)
    assert {x["orphan_kind"] for x in got.collect()} == {"missing"}


def test_report(spark):
    refs, docs = rows(8)
    found = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(docs, DOCS), **NAMES)
    rep = orphan_report(found, "f.d").collect()
    assert sum(x["n_orphans"] for x in rep) == found.count() and {x["table_name"] for x in rep} == {"f.d"}
