import random

import pytest
from pyspark.sql import functions as F

from dnsq.operators import datasets as D, delays as DL, metrics as ME, ranking as R


def domains(spark, n):
    return spark.createDataFrame([(f"d{i}.example.com",) for i in range(n)], "domain string")


def test_variants(spark):
    got = {(r.query_domain, r.classification) for r in D.typo_variants(domains(spark, 1)).collect()}
    names = {q for q, _ in got}
    assert ("d0a.example.com", "addition") not in got  # the label before the last one is changed
    assert ("d0.example0.com", "addition") in got and ("d0.exmple.com", "omission") in got
    assert ("d0.xeample.com", "transposition") in got and ("d0.ex.ample.com", "subdomain") in got
    assert ("d0.3xample.com", "replacement") in got and ("d0.exannple.com", "homoglyph") in got
    assert "d0.example.com" not in names and len(names) == len(got)


def test_variants_of_plain_names(spark):
    got = D.typo_variants(spark.createDataFrame([("ab",), ("a",)], "domain string"))
    assert {r.query_domain for r in got.filter("classification = 'transposition'").collect()} == {"ba"}
    assert got.filter("query_domain = ''").count() == 0


@pytest.mark.parametrize("n", [46, 47])
def test_negative_pairs(spark, n):
    rows = D.negative_pairs(domains(spark, n), 1000).collect()
    pairs = {frozenset((r.target_domain, r.query_domain)) for r in rows}
    assert len(rows) == 1000 and len(pairs) == 1000 and all(len(p) == 2 for p in pairs)


def test_too_few_pairs(spark):
    with pytest.raises(ValueError):
        D.negative_pairs(domains(spark, 44), 1000)


def test_all_pairs_can_be_drawn(spark):
    for n in (6, 7):
        total = n * (n - 1) // 2
        rows = D.negative_pairs(domains(spark, n), total).collect()
        assert len({frozenset((r.target_domain, r.query_domain)) for r in rows}) == total


def test_negative_samples(spark):
    listed = domains(spark, 60)
    targets = listed.limit(5)
    # Every target has a variant that is itself listed.
    clash = targets.select(F.col("domain").alias("target_domain"), F.lit("d50.example.com").alias("query_domain"))
    rows = D.negative_samples(targets, listed, clash, 40).collect()
    by = {}
    for r in rows:
        by.setdefault(r.target_domain, []).append(r.query_domain)
    for t, q in by.items():
        assert len(q) == len(set(q)) == 40 and t not in q
        assert "d50.example.com" not in q
    assert len(by) == 5
    # A short list gives what there is.
    few = D.negative_samples(targets, listed.limit(10), clash.limit(0), 40)
    assert few.groupBy("target_domain").count().filter("count > 9").count() == 0


def labelled(spark, n=500, seed=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.choice("aab")) for i in range(n)], "k bigint, c string")


def test_hash_rank_is_a_permutation(spark):
    got = sorted(r.rank for r in R.hash_rank(labelled(spark), [], "k", 1).collect())
    assert got == list(range(500))


def test_split_and_folds(spark):
    df = labelled(spark)
    sizes = {r.c: r.n for r in D.class_counts(df, "c").collect()}
    tests = {r.c: r["count"] for r in D.stratified_split(df, "c", "k").filter("is_test").groupBy("c").count().collect()}
    assert tests == {c: round(n * 0.2) for c, n in sizes.items()}
    folds = D.kfold(df, "c", "k").groupBy("c", "fold").count().collect()
    for c, n in sizes.items():
        counts = [r["count"] for r in folds if r.c == c]
        assert sum(counts) == n and max(counts) - min(counts) <= 1 and len(counts) == 5


def test_downsample(spark):
    out = {r.c: r.n for r in D.class_counts(D.class_downsample(labelled(spark), "c", "k", "a", 50), "c").collect()}
    assert out["a"] == 50 and out["b"] == labelled(spark).filter("c = 'b'").count()


def test_scale_constant_column(spark):
    out = D.standard_scale(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double"), ["x", "y"])
    assert sorted((r.x_scaled, r.y_scaled) for r in out.collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_label_codes(spark):
    codes = {r.c: r.code for r in D.label_codes(labelled(spark), "c").collect()}
    assert codes == {"a": 0, "b": 1}


@pytest.mark.parametrize("spread", [5, 10**6, 10**14])
def test_pick_ranks(spark, spread):
    rng = random.Random(spread)
    values = [rng.randrange(spread) for _ in range(301)]
    got = {r.name: r.value for r in R.pick_ranks(
        spark.createDataFrame([(v,) for v in values], "v bigint"), "v", DL.PERCENTILES).collect()}
    ordered = sorted(values)
    assert got == {k: ordered[int(300 * p)] for k, p in DL.PERCENTILES.items()}


def test_pick_ranks_of_nothing(spark):
    assert R.pick_ranks(spark.createDataFrame([], "v bigint"), "v", {"p": 0.5}).count() == 0


def auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("levels", [2, 7, 1000])
def test_auc_with_ties(spark, levels):
    rng = random.Random(levels)
    rows = [(rng.randint(0, 1), rng.randrange(levels) / levels) for _ in range(400)]
    got = ME.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first().roc_auc
    assert got == pytest.approx(auc(rows))


def test_auc_of_one_class(spark):
    assert ME.roc_auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first().roc_auc is None


def test_report_of_unseen_prediction(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b")], "y string, p string")
    got = {r.label: r for r in ME.classification_report(df, "y", "p").collect()}
    assert got["a"].recall == 0.5 and got["c"].support == 0 and got["c"].precision == 0
    assert got["accuracy"].f1 == pytest.approx(2 / 3) and got["weighted avg"].support == 3
    wide = {r.y: r for r in ME.confusion_pivot(df, "y", "p", ["a", "b", "c"]).collect()}
    assert (wide["a"].a, wide["a"].c, wide["b"].b) == (1, 1, 1)


def test_binary_metrics_without_hits(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    assert list(ME.binary_metrics(df, "y", "p").first()) == [0.5, 0.0, 0.0, 0.0]


def test_salted_join_equals_broadcast(spark, monkeypatch):
    from dnsq import session

    monkeypatch.setattr(session, "HOT_ROWS", 20)
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k bigint, v bigint")
    small = spark.createDataFrame([(i, i * 10) for i in range(0, 300, 2)] + [(1, 11)], "k bigint, w bigint")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, session.attach(big, small, ["k"], how).collect()), key=str)
        got = sorted(map(tuple, session.attach(big, small, ["k"], how, rows=10**9).collect()), key=str)
        assert got == want
