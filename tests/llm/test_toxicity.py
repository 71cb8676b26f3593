import random

import numpy as np

from dnsq.llm import toxicity as T

from .helpers import prose, table


def letters(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def corpus():
    r = random.Random(4)
    data, labels = [], []
    for i in range(400):
        words = letters(i, 60).split()
        toxic = i % 8 == 0
        if toxic:
            words[r.randrange(60)] = r.choice(["Zidiot,", "zmoron", "zvilest", "zvilen"])
        data.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(toxic)))
    return data, labels


def test_scores_follow_the_labels(spark):
    data, labels = corpus()
    train = spark.createDataFrame([x for x in labels if x[0] % 5] + [(7, 0), (None, 1), (3, None)], "doc_id long, toxic long")
    df = table(spark, data, clash=True)
    got = {r.doc_id: r.score for r in T.score(df, T.train(df, train)).collect()}
    held = [(got[i], y) for i, y in labels if i % 5 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())


def test_awkward_texts_and_tables(spark):
    data, labels = corpus()
    model = T.train(table(spark, data), spark.createDataFrame(labels, "doc_id long, toxic long"))
    odd = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "12 !!", "en", "s", 0), (None, "zmoron " + letters(9, 20_000), "en", "s", 0),
           (4, "ZMORON", "en", "s", 0), (4, "ZMORON", "en", "s", 0)]
    got = T.score(table(spark, odd), model).collect()
    assert len(got) == len(odd)
    plain = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(plain) == 1 and plain.pop() < 0.5 and all(r.score > 0.5 for r in got if r.doc_id == 4)
    assert T.score(table(spark, []), model).count() == 0
    none = T.train(table(spark, data), spark.createDataFrame([], "doc_id long, toxic long"))
    assert {r.score < 0.5 for r in T.score(table(spark, [prose(1, 5)]), none).collect()} == {True}


def test_label_model_weighs_copied_voters_down():
    r = np.random.default_rng(1)
    truth = r.random(600) < 0.2
    said = lambda right: np.where(r.random(600) < right, truth, ~truth)
    copied = np.where(said(0.7), 1, -1)
    votes = np.column_stack([copied, copied, copied, np.where(said(0.85), 1, -1), np.where(said(0.85), 1, -1), np.where(said(0.95), 1, -1)])
    post, weight = T.label_model(votes.astype(float))
    assert weight[:3].max() < 0.4 < weight[3:].min()
    assert np.mean((post > 0.5) == truth) > 0.93
