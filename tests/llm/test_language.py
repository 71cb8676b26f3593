import random

import numpy as np
import pytest

from dnsq.llm import language as L

from .helpers import table

SYLLABLES = {"aa": "ka lo mi tu ne sa ri po".split(), "bb": "schr ung ver keit eln ach ößt ie".split(),
             "cc": "ção ñu llo quei ará êm uy zo".split()}


def text(lang, words, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(words))


def model(spark):
    data = [(i, text(lang, 60, i), lang, "s", 0) for i in range(40) for lang in SYLLABLES]
    data += [(900, None, "aa", "s", 0), (901, "x", None, "s", 0), (902, "", "bb", "s", 0)]
    return L.train(table(spark, data))


def test_predictions_and_awkward_texts(spark):
    m = model(spark)
    assert m[0] == ["aa", "bb", "cc"]
    data = [(i, text(lang, 30, 1000 + i), lang, "s", 0) for i in range(10) for lang in SYLLABLES]
    data += [(50, None, "aa", "s", 0), (51, "", "aa", "s", 0), (52, "123 !!\0 ٣", "aa", "s", 0), (None, "kalomi", "aa", "s", 0),
             (53, text("aa", 60, 5) + "\n" + text("bb", 40, 6), None, "s", 0), (54, text("cc", 60_000, 7), "cc", "s", 0)]
    got = L.predict(table(spark, data, clash=True), m).collect()
    assert len(got) == len(data)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert sorted(r.lang_pred for i in range(10) for r in by_id[i]) == ["aa"] * 10 + ["bb"] * 10 + ["cc"] * 10
    assert [(by_id[i][0].lang_pred, by_id[i][0].score) for i in (50, 51, 52)] == [("und", 0.0)] * 3
    assert by_id[None][0].lang_pred == "aa" and by_id[54][0].lang_pred == "cc"
    mixed = by_id[53][0]
    assert mixed.lang_pred == "aa" and set(mixed.shares) == {"aa", "bb"} and abs(mixed.shares["bb"] - 0.4) < 0.1


def test_one_language_is_chosen_for_pure_texts(spark):
    _, logs = model(spark)
    share = L.shares([text("bb", 80, s) for s in range(20)], logs)
    assert (np.count_nonzero(share, axis=1) == 1).mean() > 0.9
    assert np.allclose(share.sum(axis=1), 1)


def test_filter_and_empty_tables(spark):
    m = model(spark)
    df = table(spark, [(1, text("aa", 20, 1), "x", "s", 0), (2, "... 12", "x", "s", 0), (3, None, "x", "s", 0)], clash=True)
    kept = L.identified(df, m)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]
    empty = L.train(table(spark, []))
    assert empty[0] == [] and L.predict(table(spark, ["some text"]), empty).first().lang_pred == "und"
    assert L.predict(table(spark, []), m).count() == 0 and L.identified(table(spark, []), m).count() == 0


def test_sets_grow_while_that_fits_better():
    """Six languages of letters of their own: a text of all six has six shares, whatever else is in its batch."""
    rng = np.random.default_rng(1)
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    words = [["".join(rng.choice(list(alphabet), 6)) for _ in range(300)] for alphabet in letters]
    logs = np.zeros((6, L.CELLS))
    for i, own in enumerate(words):
        cells, _, _ = L.trigrams([" ".join(own)])
        logs[i] = np.bincount(cells, minlength=L.CELLS)
    logs = np.log((logs + 0.1) / (logs + 0.1).sum(axis=1, keepdims=True)).astype(np.float32)
    mixed = " ".join(w for ws in words for w in ws[:50])
    got = L.shares([mixed, " ".join(words[2]), ""], logs)
    assert (got[0] > 0.1).all() and got[0].sum() == pytest.approx(1)
    assert (got[1] > 0).tolist() == [False, False, True, False, False, False] and not got[2].any()
    assert L.shares([mixed], logs)[0] == pytest.approx(got[0])
