"""Bounded search against comparing every pair."""

import random

import numpy as np
import pytest

from dnsq.functions.search import List, levenshtein_batch
from dnsq.functions.similarity import jaro_batch, ratio_batch
from dnsq.operators import matching as M


def names(seed, n):
    r = random.Random(seed)
    ends = [".com", ".org", ".example.com", ""]
    out = ["".join(r.choice("abcdefgh-") for _ in range(r.randrange(1, 14))) + r.choice(ends) for _ in range(n)]
    return out + ["", "a", "zz", "日本.com", "aaa.com", "aaa.com"]


def edits(listed, seed, n):
    r = random.Random(seed)
    out = []
    for t in r.sample(listed, n):
        i = r.randrange(len(t) + 1)
        out.append(t[:i] + t[i + 1 :] if r.random() < 0.5 else t[:i] + "x" + t[i:])
    return list(dict.fromkeys([*out, "", "zz", listed[0], "日本.con", "qqq" * 20]))


def grams(x):
    return {x[i : i + 3] for i in range(len(x) - 2)}


def linear(target, query):
    union = grams(target) | grams(query)
    jaccard = len(grams(target) & grams(query)) / len(union) if union else 0
    far = levenshtein_batch([target], [query])[0] / max(len(target), len(query), 1)
    return 0.5 * jaro_batch([target], [query])[0] + 0.2 * jaccard + 0.3 * (1 - far)


def test_levenshtein():
    def by_hand(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            new = [i + 1]
            for j, d in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
            row = new
        return row[-1]

    a, b = names(1, 60), names(2, 60)
    assert levenshtein_batch(a, b).tolist() == [by_hand(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("k", [1, 5, 50, 10_000])
def test_most_alike(k):
    listed = names(3, 300)
    queries = edits(listed, 4, 40)
    prepared = List(listed)
    place, score = prepared.most_alike(queries, k)
    for i, q in enumerate(queries):
        ratios = ratio_batch(listed, [q] * len(listed))
        want = sorted(range(len(listed)), key=lambda t: (-round(ratios[t], 12), t))[:k]
        assert place[i][place[i] >= 0].tolist() == want
        assert score[i, : len(want)].tolist() == ratios[want].tolist()


def test_best_linear_and_floor():
    listed = names(5, 250)
    queries = edits(listed, 6, 40)
    place, score = List(listed).best_linear(queries)
    high, _ = List(listed).best_linear(queries, 0.9)
    for i, q in enumerate(queries):
        near = {t: linear(name, q) for t, name in enumerate(listed) if name != q}
        want = min(near, key=lambda t: (-round(near[t], 12), t))
        assert place[i, 0] == want and score[i, 0] == pytest.approx(near[want])
        assert high[i, 0] == (want if near[want] >= 0.9 else -1)


def test_few_pairs_are_compared():
    r = random.Random(7)
    listed = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(6, 16))) + ".com" for _ in range(3000)]
    queries = [t[:3] + t[4:] for t in listed[::30]]
    prepared = List(listed)
    prepared.best_linear(queries, 0.8)
    assert prepared.compared < 0.002 * len(queries) * len(listed)
    prepared.compared = 0
    prepared.most_alike(queries, 50)
    assert prepared.compared < 0.2 * len(queries) * len(listed)


@pytest.mark.parametrize("size,broadcast", [(4096, 64), (40, 64), (40, 0)])
def test_same_result_over_slices(spark, monkeypatch, size, broadcast):
    listed = list(dict.fromkeys(names(8, 150)))
    queries = edits(listed, 9, 60)
    monkeypatch.setattr(M, "SLICE", size)
    monkeypatch.setattr(M, "BROADCAST_SLICES", broadcast)
    monkeypatch.setattr(M, "BLOCK", 16)
    q = spark.createDataFrame([(x,) for x in [*queries, *queries[:5], None]], "qname string")
    p = spark.createDataFrame([(x, i) for i, x in enumerate(listed)], "domain string, position bigint")
    place, score = List(listed).most_alike(queries, 7)
    want = {(n, int(t), j + 1) for n, ts in zip(queries, place) for j, t in enumerate(ts)}
    assert {(r.qname, r.position, r.cand_no) for r in M.top_candidates(q, p, 7).collect()} == want
    own = {r.qname: r for r in M.best_match(q, p).collect()}
    every = {r.qname: r for r in M.best_match(q, p, M.linear_scorer).collect()}
    assert set(own) == set(every) == set(queries)
    for n in queries:
        assert (own[n].target, own[n].predicted_class) == (every[n].target, every[n].predicted_class)
        assert own[n].score == pytest.approx(every[n].score)
    far = {r.qname: r for r in M.best_match(q, p, least=0.85).collect()}
    for n in queries:
        if every[n].score >= 0.85:
            assert far[n].target == every[n].target
        else:
            assert far[n].target is None and far[n].score == 0


def test_no_names(spark):
    p = spark.createDataFrame([("a.com", 0)], "domain string, position bigint")
    q = spark.createDataFrame([], "qname string")
    assert M.best_match(q, p).count() == 0 and M.top_candidates(q, p).count() == 0
    assert np.all(List(["a"]).best_linear(["a"])[0] == -1)
