import random
import re

import pytest

from dnsq.llm import decontaminate as D

from .helpers import FOLD, prose, table

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, length=13):
    found = []
    phrases = []
    for item, text in items:
        w = WORDS.findall((text or "").translate(FOLD))
        n = min(length, len(w))
        phrases += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    for i, text in docs:
        w = WORDS.findall((text or "").translate(FOLD))
        hit, ids = set(), set()
        for item, p in phrases:
            for at in range(len(w) - len(p) + 1):
                if tuple(w[at : at + len(p)]) == p:
                    hit.update(range(at, at + len(p)))
                    if item is not None:
                        ids.add(str(item))
        found.append((i, len(w), len(hit), sorted(ids)))
    return found


def run(spark, docs, items, **how):
    frame = table(spark, [(i, t, "en", "s", 0) for i, t in docs], clash=True)
    item_frame = spark.createDataFrame(items, "item_id long, text string")
    got = D.find(spark, D.build_index(frame), item_frame, **how).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=repr)


@pytest.fixture
def small_segments(monkeypatch):
    monkeypatch.setattr(D, "SEGMENT_WORDS", 300)


def awkward():
    items = [(1, prose(1, 30)), (2, "tiny Item"), (3, prose(2, 13)), (4, None), (5, ""), (6, "!!! ..."), (7, prose(1, 30)),
             (8, "a a a a a a a a a a a a a a a"), (None, prose(9, 14)), (2, "other words here")]
    passage = items[0][1].split()
    r = random.Random(3)
    docs = [(0, None), (1, ""), (2, "Tiny, item!"), (3, " ".join(passage)), (4, " ".join(passage[:12])),
            (5, prose(50, 40) + " " + " ".join(passage[5:20]).upper() + "; " + prose(51, 20)),
            (6, "a " * 40), (7, prose(2, 13) + "\n" + prose(2, 13)), (7, prose(2, 13)), (None, prose(2, 13)),
            (8, prose(9, 14)), (9, prose(60, 5000) + " tiny item " + " ".join(passage)), (10, "?! ,,"), (11, "tiny")]
    docs += [(100 + i, prose(100 + i, 60) + (" " + " ".join(passage[r.randrange(10) :]) if i % 3 == 0 else "")) for i in range(40)]
    return docs, items


def test_like_brute_force(spark, small_segments):
    docs, items = awkward()
    assert run(spark, docs, items) == sorted(brute(docs, items), key=repr)


def test_items_in_blocks(spark, small_segments, monkeypatch):
    monkeypatch.setattr(D, "ITEMS_PER_GROUP", 2)
    docs, items = awkward()
    assert run(spark, docs, items) == sorted(brute(docs, items), key=repr)


def test_proximity(spark):
    docs = [(1, "alpha x beta gamma"), (2, "alpha beta x x x gamma"), (3, "gamma beta alpha"), (4, "alpha beta gamma"), (5, "alpha beta")]
    hits = {r[0] for r in run(spark, docs, [(1, "alpha beta gamma")], slop=1) if r[2]}
    assert hits == {1, 4}
    assert {r[0] for r in run(spark, docs, [(1, "alpha beta gamma")], slop=0) if r[2]} == {4}
    assert {r[0] for r in run(spark, docs, [(1, "alpha beta gamma")], slop=4) if r[2]} == {1, 2, 3, 4}


def test_empty_tables(spark):
    docs, items = awkward()
    assert run(spark, [], items) == []
    assert all(r[2] == 0 and r[3] == [] for r in run(spark, docs, []))


def test_contaminated_documents_go(spark):
    docs, items = awkward()
    frame = table(spark, [(i, t, "en", "s", 0) for i, t in docs], clash=True)
    kept = D.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    bad = {i for i, n, hit, _ in brute(docs, items) if hit and 20 * hit >= n}
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in docs if i not in bad), key=repr)
