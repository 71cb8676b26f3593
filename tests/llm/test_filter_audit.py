from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dnsq.llm import filter_audit as A

from .helpers import CLASHING, SCHEMA, prose

LABELS = "doc_id long, quality int, toxic int, part string, row long"
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(docs, labels):
    """Every order walked row by row."""
    good = {i for i, q, t, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, q, t, *_ in labels if t == 1 and i is not None}
    fails = []
    for i, text, source in docs:
        t = text or ""
        w = words(t)
        same = [j for j, x, _ in docs if (x or "") == t and j is not None and i is not None and j < i]
        fails.append({f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            any(c in t for c in "#$%&*|"), bool(same))) if bad})
    out = {}
    for part in {s or "" for _, _, s in docs}:
        mine = [(i, f) for (i, _, s), f in zip(docs, fails) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                shapley[f] += len(gone)
                failing = sum(f in x for _, x in mine)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(x == {f} for _, x in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, docs, labels, parts=3):
    rows = [(i, t, "en", s, 0, "x", 1, None, 2, "y", None, "r", 3, "h") for i, t, s in docs]
    table = spark.createDataFrame(rows, SCHEMA + CLASHING).repartition(parts)
    marked = A.with_labels(A.failing(table), spark.createDataFrame(labels, LABELS), {
        "good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    got = A.audit(A.posting_lists(marked, [*A.FILTERS, "good", "toxic"]), list(A.FILTERS), ["good", "toxic"])
    rows = got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
                      "shapley").collect()
    out = {(r[0], r[1], r[2]): tuple(r[3:]) for r in rows}
    assert len(out) == len(rows)
    return out


DOCS = [(0, prose(1, 300), "a"), (1, prose(1, 300), "b"), (2, prose(2, 300, 20), "a"), (3, "SHORT # text", "a"), (4, None, None),
        (5, "", ""), (6, None, "b"), (7, prose(3, 250) + " " + "ABC " * 60, "b"), (8, "wort wort \x85x é|" * 90, "c"),
        (9, "word " * 400_000, "c"), (9, "word " * 400_000, "c"), (None, "SHORT # text", "a"), (10, "SHORT # text", None)]
MARKED = [(0, 1, 0, "x", 1), (1, None, 1, "x", 1), (2, 1, None, "x", 1), (3, 0, 1, "x", 1), (3, 1, 0, "x", 1), (7, 1, 1, "x", 1),
          (99, 1, 1, "x", 1), (None, 1, 1, "x", 1)]


def test_like_walking_every_order(spark, monkeypatch):
    want = brute(DOCS, MARKED)
    assert run(spark, DOCS, MARKED) == want
    monkeypatch.setattr(A, "RANGE", 4)  # parts of several ranges
    assert run(spark, DOCS, MARKED, parts=1) == want


def test_one_part_and_no_labels(spark):
    docs = [(i, prose(i % 7, 220) if i % 3 else "A b", "s") for i in range(60)]
    assert run(spark, docs, []) == brute(docs, [])


def test_empty_table(spark):
    assert run(spark, [], MARKED) == {}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = (" \n".join(f"w{i % 37}" for i in range(500)) + "\t").encode()
    whole = A._words(text)
    monkeypatch.setattr(A, "_PIECE", 16)
    assert A._words(text) == whole == (500, 37)
    assert A._words(b"x" * 100) == (1, 1)


@pytest.mark.parametrize("seed", range(20))
def test_lists(seed):
    r = np.random.default_rng(seed)
    a, b = (np.unique(r.integers(0, 60, r.integers(0, n))) for n in (8, 80))
    for x, y in ((a, b), (b, a)):
        assert A.inside(x, y).tolist() == [v in set(y.tolist()) for v in x.tolist()]
        assert A.merged(x, y).tolist() == sorted({*x.tolist(), *y.tolist()})
