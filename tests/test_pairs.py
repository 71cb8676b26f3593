import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from dnsq.functions import pairs, similarity
from dnsq.operators import matching as M

names = st.text(alphabet="abc.-1é", max_size=12)


def jaro_by_hand(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    left = [None] * len(b)
    seq_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if left[j] is None and b[j] == c:
                left[j] = c
                seq_a.append(c)
                break
    seq_b = [c for c in left if c is not None]
    if not seq_a:
        return 0.0
    m, t = len(seq_a), sum(x != y for x, y in zip(seq_a, seq_b)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def lcs_by_hand(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, c in enumerate(a):
        for j, d in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if c == d else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(names, names), min_size=1, max_size=8))
def test_kernels_match_definitions(rows):
    a, b = [r[0] for r in rows], [r[1] for r in rows]
    assert similarity.jaro_batch(a, b) == pytest.approx([jaro_by_hand(x, y) for x, y in rows])
    assert list(similarity.lcs_batch(a, b)) == [lcs_by_hand(x, y) for x, y in rows]
    j = similarity.jaro_batch(a, b)
    assert np.all((j >= 0) & (j <= 1 + 1e-12))


def test_long_names():
    a = ["x" * 300 + "abc", "q"]
    b = ["abc" + "x" * 300, "q" * 253]
    assert list(similarity.lcs_batch(a, b)) == [300, 1]


def pair(spark, t, q, build=pairs.pair_features):
    df = spark.createDataFrame([(t, q)], "t string, q string")
    return df.select(*[c.alias(k) for k, c in build(F.col("t"), F.col("q")).items()]).first().asDict()


def test_pair_features(spark):
    f = pair(spark, "abcdef", "bcadef")
    assert f["jaro_similarity"] == pytest.approx(jaro_by_hand("abcdef", "bcadef"))
    assert f["levenshtein"] == 2 and f["length_diff"] == 0 and f["prefix_match"] == 0 and f["suffix_match"] == 1
    f = pair(spark, "google.com", "goo-gle1.co")
    assert f["length_diff"] == -1 and f["hyphen_count"] == 1 and f["dot_count"] == 1 and f["tld_match"] == 0
    assert f["digit_ratio"] == pytest.approx(1 / 11)
    assert pair(spark, "a", "b")["jaro_similarity"] == 0
    assert pair(spark, "ab", "ab")["jaccard_similarity"] == 0
    assert pair(spark, "same.com", "same.com")["jaro_similarity"] == 1
    empty = pair(spark, "abc", "")
    assert empty["digit_ratio"] is None and empty["jaro_similarity"] == 0
    assert list(f) == pairs.PAIR_FEATURES


def test_binary_features(spark):
    f = pair(spark, "short", "longer-name", pairs.binary_pair_features)
    assert f["length_diff"] == 6 and list(f) == pairs.BINARY_PAIR_FEATURES


def _list(spark, domains):
    return spark.createDataFrame(list(zip(domains, range(len(domains)))), "domain string, position bigint")


@pytest.mark.parametrize("size,broadcast", [(256, 64), (3, 64), (3, 0)])
def test_matching_is_the_same_for_any_slicing(spark, monkeypatch, size, broadcast):
    """One slice, several broadcast slices and several salted ones give the same matches."""
    domains = ["alpha.com", "alphas.com", "beta.org", "gamma.net", "delta.io", "alpha.com.org", "zz"]
    queries = [("alpha.co",), ("betta.org",), ("gama.net",), ("zz",), ("qqq",), ("alpha.co",)]
    monkeypatch.setattr(M, "SLICE", size)
    monkeypatch.setattr(M, "BROADCAST_SLICES", broadcast)
    q, p = spark.createDataFrame(queries, "qname string"), _list(spark, domains)
    got = {r.qname: [] for r in q.collect()}
    for r in M.top_candidates(q, p, 2).orderBy("qname", "cand_no").collect():
        got[r.qname].append(r.target)
    for name, found in got.items():
        ratio = [2 * lcs_by_hand(d, name) / (len(d) + len(name)) for d in domains]
        want = sorted(range(len(domains)), key=lambda i: (-ratio[i], i))[:2]
        assert found == [domains[i] for i in want]
    best = {r.qname: (r.target, r.predicted_class) for r in M.best_match(q, p).collect()}
    assert best["alpha.co"] == ("alpha.com", "omission")
    assert best["betta.org"] == ("beta.org", "addition")
    assert best["qqq"] == (None, None)
    # The name itself scores in the class `none`, which never matches.
    assert best["zz"][0] != "zz"


def test_empty_list_is_an_error(spark):
    with pytest.raises(ValueError):
        M.best_match(spark.createDataFrame([("a",)], "qname string"), spark.createDataFrame(
            [], "domain string, position bigint"))
