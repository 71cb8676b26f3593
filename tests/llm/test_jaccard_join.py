import random

from dnsq.llm import common
from dnsq.llm import jaccard_join as J
from dnsq.llm.components import components

from .helpers import groups, prose, table


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    base, common = prose(1, 120, 5000), prose(2, 40, 5000)
    texts = [None, "", "  \n", "one", "ONE", "one two three", "one two  three", "a b c d e", "A b c d e", "a b c d f"]
    texts += [prose(10 + i, 80, 5000) for i in range(30)]
    texts += [edited(base, i % 4, i) for i in range(40)]  # one large group of near copies
    texts += [base + " " + prose(500 + i, 12 + 3 * i, 5000) for i in range(12)]  # around the threshold
    texts += [common + " " + prose(700 + i, 60, 5000) for i in range(25)]  # a passage that many share
    texts += [common + " " + prose(800 + i, i, 5000) for i in range(1, 16)]  # little but that passage
    texts += [prose(11, 80, 5000), prose(900, 4000, 9000), edited(prose(900, 4000, 9000), 60, 5)]
    chain = prose(40, 100, 5000).split()
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 40, 5)]  # each like the next, ends unlike
    return texts


def check(spark, texts, **how):
    got = J.linked_groups(table(spark, texts, **how)).collect()
    want, sizes = groups(texts)
    assert sorted(tuple(r) for r in got) == [(i, sizes[i], want[i]) for i in range(len(texts))]


def test_like_brute_force(spark):
    check(spark, corpus(), clash=True)


def test_long_lists_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(J, "SHORT_LIST", 2)
    monkeypatch.setattr(J, "FLUSH", 700)
    monkeypatch.setattr(common, "SMALL_KEYS", 0)  # no broadcast
    check(spark, corpus())


def test_repeated_rows_null_ids_and_empty_table(spark):
    a, b = prose(1, 30), prose(2, 30)
    data = [(5, a), (5, a), (7, a), (None, a), (None, b), (3, b.upper()), (None, prose(3, 20)), (9, None), (9, None)]
    got = J.linked_groups(table(spark, [(i, t, "en", "s", 0) for i, t in data])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted(
        [(5, 5), (5, 5), (7, 5), (None, 5), (None, 3), (3, 3), (None, None), (9, 9), (9, 9)], key=repr)
    assert J.linked_groups(table(spark, [])).count() == 0


def test_one_of_each_group(spark):
    texts = corpus()
    df = table(spark, texts, clash=True)
    kept = J.one_of_each_group(df)
    want, sizes = groups(texts)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if want[i] == i]
    a = prose(1, 30)
    data = [(5, a), (5, a), (None, a), (4, a.upper()), (4, a), (None, prose(3, 20)), (9, None)]
    left = J.one_of_each_group(table(spark, [(i, t, "en", "s", 0) for i, t in data])).collect()
    assert sorted((r.doc_id for r in left), key=repr) == [4, 9, None]
    assert J.one_of_each_group(table(spark, [])).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (6, 6), (6, 10), (8, 9), (5, 1), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in components(df).collect()} == {
        (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8), (7, 7), (6, 6), (10, 6)}
    assert components(df.limit(0)).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in components(chain).collect()} == {0}
