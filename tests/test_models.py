import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dnsq.functions import lexical
from dnsq.operators import alerts as A, forests as FR, formulas as FO, models as MO
from dnsq.plans import jobs, training as TR


@pytest.fixture(scope="module")
def domains(spark):
    rng = random.Random(5)
    words = ["shop", "news", "cloud", "river", "table", "green", "house", "paper"]
    rows = [(f"l{i}", "".join(rng.sample(words, 2)) + f".{i % 3}.com", "legit") for i in range(150)]
    rows += [(f"d{i}", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(12, 24))) + ".net", "DGA")
             for i in range(150)]
    return spark.createDataFrame(rows, "row_key string, Domain string, class string")


SMALL = {"Logistic Regression": {"kind": "lr"}, "Random Forest": {"kind": "rf", "trees": 10},
         "Gradient Boosting": {"kind": "gbt", "rounds": 5}}


@pytest.fixture(scope="module")
def trained(domains):
    return TR.train_dga(domains, SMALL, folds=0, depth=5)


def test_dga_models(trained):
    for r in trained.reports["test_metrics"].collect():
        assert r.f1 > 0.9, r.model
    assert trained.bundles["Random Forest"].labels == ["dga", "legit"]


def test_forests_grow_beyond_the_former_depth(domains):
    mixed = domains.withColumn("class", F.when(F.xxhash64("row_key") % 2 == 0, "legit").otherwise("dga"))  # hard to split
    forest = TR.train_dga(mixed, {"Random Forest": {"kind": "rf", "trees": 5}}, folds=0).bundles["Random Forest"]
    assert max(tree.depth for tree in forest.classifier.trees) > 8


def test_overfitting_report(domains):
    out = TR.train_dga(domains, {"Random Forest": {"kind": "rf", "trees": 5}}, folds=2, depth=4).reports["overfitting"].first()
    assert out.cv_f1_mean > 0.9 and out.f1_gap_train_minus_test == pytest.approx(out.train_f1 - out.test_f1)


def test_store_and_score(spark, trained, tmp_path):
    names = spark.createDataFrame([("cloudnews.com",), ("x9q7z2k4v8b1m3c6.net",), ("cloudnews.com",)], "qname string")
    from dnsq.functions import lexical

    for name, bundle in trained.bundles.items():
        MO.save(bundle, f"{tmp_path}/{name}")
        again = MO.load(f"{tmp_path}/{name}")
        assert (again.labels, again.feature_columns) == (bundle.labels, bundle.feature_columns)
        a = {r.qname: r.scores for r in MO.score_names(names, bundle, lexical.dga_features).collect()}
        b = {r.qname: r.scores for r in MO.score_names(names, again, lexical.dga_features).collect()}
        assert a == b and len(a) == 2
        assert a["x9q7z2k4v8b1m3c6.net"]["dga"] > a["cloudnews.com"]["dga"]
        assert sum(a["cloudnews.com"].values()) == pytest.approx(1)


def test_scaling_uses_population_deviation(spark):
    df = spark.createDataFrame([(0.0, "a"), (2.0, "b"), (0.5, "a"), (2.5, "b")], "x double, y string")
    bundle = MO.fit(df, "y", ["x"], "lr")
    out = bundle.model.transform(MO.with_vector(df, ["x"])).select("x", "scaled").collect()
    mean, dev = 1.25, (sum((v - 1.25) ** 2 for v in (0, 2, 0.5, 2.5)) / 4) ** 0.5
    for r in out:
        assert r.scaled[0] == pytest.approx((r.x - mean) / dev)


def test_dga_alerts_end_to_end(spark, trained):
    lines = spark.createDataFrame([
        ("[1704067200] info: 10.0.0.1 x9q7z2k4v8b1m3c6.net. A IN",), ("[1704067201] info: 10.0.0.1 cloudnews.com. A IN",),
        ("info: 10.0.0.2 x9q7z2k4v8b1m3c6.net. A IN",), ("noise",)], "value string")
    got = jobs.dga_detection(lines, trained.bundles["Random Forest"], F.lit("2024-01-01 00:00:05").cast("timestamp"), 0.8)
    rows = sorted(got.collect(), key=lambda r: str(r.unbound_logged_at))
    assert [r.detection_delay_seconds for r in rows] == [5.0, None]
    assert {r.domain for r in rows} == {"x9q7z2k4v8b1m3c6.net"} and set(rows[0].scores) == {"dga", "legit"}


def test_pair_models(spark):
    ranked = spark.createDataFrame([(i, f"{w}{i}.com") for i, w in enumerate(
        ["google", "amazon", "wikipedia", "netflix", "example", "weather"] * 4)], "rank bigint, domain string")
    rows = jobs.typo_dataset(ranked, 8, 20, homoglyph_cap=60)
    assert rows.filter("classification = 'homoglyph'").count() == 60
    rows = rows.withColumn("row_key", F.concat_ws("|", "target_domain", "query_domain"))
    report = {r.label: r for r in TR.train_pairs(rows, trees=10, depth=8).reports["report"].collect()}
    assert report["accuracy"].f1 > 0.5 and report["none"].recall > 0.9
    typo = rows.withColumn("classification", F.when(F.col("classification") == "none", "none").otherwise("typo"))
    report = {r.label: r for r in TR.train_pairs(typo, binary=True, trees=5, depth=6, limit=400).reports["report"].collect()}
    assert report["typo"].recall > 0.8


def test_tunnel_models_and_scoring(spark):
    rng = random.Random(2)
    rows = [(i, "f", "tcp" if i % 2 else "udp", float(rng.randint(0, 50) + (100 if i % 3 == 0 else 0)), rng.random(),
             "Malicious" if i % 3 == 0 else "Benign") for i in range(240)]
    flows = spark.createDataFrame(rows, "row_key bigint, flow_id string, protocol string, size double, noise double, label string")
    specs = {"Logistic Regression": {"kind": "lr", "balanced": True}, "Random Forest": {"kind": "rf", "trees": 10, "balanced": True},
             "Gradient Boosting": {"kind": "gbt", "rounds": 5}}
    out = TR.train_tunnel(flows, specs, depth=4)
    assert all(r.roc_auc > 0.95 for r in out.reports["auc"].collect())
    assert out.reports["importance"].first().feature == "size"
    bundle = out.bundles["Random Forest"]
    codes = {c: [(r.value, r.code) for r in t.orderBy("code").collect()] for c, t in bundle.text_codes.items()}
    assert codes == {"protocol": [("tcp", 0), ("udp", 1)]} and "flow_id" not in bundle.feature_columns
    # A table read from text without one column: numbers are read, the missing column is 0 and reported.
    table = spark.createDataFrame([("1", "tcp", "140"), ("2", "other", "")], "flow_id string, protocol string, size string")
    result = jobs.tunnel_scoring(table, bundle)
    assert result["missing_feature_columns"] == ["noise"]
    assert list(result["summary"].first()) == [2, 1, 0.5]
    assert {r.flow_id: r.predicted_label for r in result["scored"].collect()}["1"] == "Malicious"


def test_numeric_rule(spark):
    df = spark.createDataFrame([("1.5", float("nan")), ("not a dns flow", 2.0), (None, None)], "t string, d double")
    got = [tuple(r) for r in df.select(MO.numeric(df, "t"), MO.numeric(df, "d"), MO.numeric(df, "gone")).collect()]
    assert got == [(1.5, -1.0, 0.0), (-1.0, 2.0, 0.0), (-1.0, -1.0, 0.0)]


def test_attack_class():
    assert A.attack_class(["Benign", "Malicious"]) == 1 and A.attack_class(["attack", "x"]) == 0
    assert A.attack_class(["tunnel", "dns_tunneling"]) == 1 and A.attack_class(["tunnel", "dns_tunneling"], batch=True) == 0
    assert A.attack_class(["a", "b"]) == 1 and A.attack_class(["a", "b", "c"]) is None


def test_hard_labels(spark):
    """A model without probabilities alerts on the label alone, with score 1; a batch score stays 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC

    df = spark.createDataFrame([(float(i), "Malicious" if i > 5 else "Benign") for i in range(10)], "x double, label string")
    rows = MO.with_vector(df, ["x"]).withColumn("code", (F.col("x") > 5).cast("double"))
    bundle = MO.Bundle(Pipeline(stages=[LinearSVC(labelCol="code")]).fit(rows), ["Benign", "Malicious"], ["x"])
    live = MO.score_flows(df, bundle, batch=False)
    assert live.filter("malicious_score = 1").count() == df.filter("x > 5").count()
    assert MO.score_flows(df, bundle).filter("malicious_score > 0").count() == 0
    now = F.lit("2024-01-01 00:00:01").cast("timestamp")
    hit = A.tunnel_alerts(live.withColumn("row_index", F.col("x").cast("bigint")), now, now, hard_labels=True).first()
    assert (hit.label, hit.score, hit.src_ip, hit.unbound_logged_at) == ("Malicious", 1.0, "", None)


def test_typo_alerts_with_and_without_model(spark):
    protected = spark.createDataFrame([("google.com", 0), ("amazon.com", 1)], "domain string, position bigint")
    lines = spark.createDataFrame([("[1704067200] 1.2.3.4 gogle.com. A IN",), ("[1704067200] 1.2.3.4 zzzz.net. A IN",)], "value string")
    at = F.lit("2024-01-01 00:00:02").cast("timestamp")
    got = jobs.typo_detection(lines, protected, detected_at=at, threshold=0.8).collect()
    assert [(r.domain, r.target, r.predicted_class, r.detection_delay_seconds) for r in got] == [
        ("gogle.com", "google.com", "omission", 2.0)]
    ranked = spark.createDataFrame([(i, f"{w}.com") for i, w in enumerate(["google", "amazon", "example", "weather", "netflix"])],
                                   "rank bigint, domain string")
    rows = jobs.typo_dataset(ranked, 5, 4, None).withColumn("row_key", F.concat_ws("|", "target_domain", "query_domain"))
    bundle = TR.train_pairs(rows, trees=10, depth=6).bundles["Random Forest"]
    for top_n in (None, 1):
        got = jobs.typo_detection(lines, protected, bundle, top_n, at, threshold=0.3).filter("domain = 'gogle.com'").collect()
        assert [(r.domain, r.target) for r in got] == [("gogle.com", "google.com")]


def test_reports(spark):
    lines = spark.createDataFrame([("[100] 1.1.1.1 A.org. A IN",), ("[50] 1.1.1.1 a.org. A IN",), ("[70] 1.1.1.1 b.org. A IN",), ("x",)],
                                  "value string")
    alerts = spark.createDataFrame([
        ("dns_tunneling", "A.ORG.", "1970-01-01T00:01:10"), ("DNS_TUNNELING", "b.org.", "1970-01-01T00:01:00"),
        ("DGA", "b.org.", "1970-01-01T00:02:00"), ("DNS_TUNNELING", "", "1970-01-01T00:02:00"), ("DNS_TUNNELING", "c.org", "soon")],
        "detector string, dns_domain_name string, detected_at string")
    out = jobs.delay_report(lines, alerts)
    assert [(r.domain, r.first_seen_to_detected_seconds) for r in out["rows"].collect()] == [("a.org", 20.0)]
    assert list(out["overlap"].first()) == [2, 2, 2]
    assert list(out["log_totals"].first()) == [4, 3]
    s = out["summary"].first()
    assert (s.domains_with_valid_delay, s.p50, s["max"]) == (1, 20.0, 20.0)
    assert [r.domain for r in jobs.domain_report(lines, base=True, min_count=2).collect()] == ["a.org"]


def test_names_are_scored_once_and_not_per_line(spark):
    """A filter on the scores stays above the distinct and on its side of the join with the lines."""
    bundle = MO.Bundle(FO.Linear([[0.1] * 11], [-0.5]), ["dga", "legit"], lexical.DGA_FEATURES)
    lines = spark.createDataFrame([(f"[100] 1.1.1.1 {n}.org. A IN",) for n in ("a", "a", "x7q9z2k4w8")], "value string")
    hits = jobs.dga_detection(lines, bundle, F.col("logged_at"), threshold=0.2)
    assert "EXP(" not in hits._jdf.queryExecution().optimizedPlan().toString()
    names = MO.score_names(lines.select(F.col("value").alias("qname")), bundle, lexical.dga_features)
    over = names.filter(F.col("scores")["dga"] >= 0.2)
    assert "Aggregate" not in over._jdf.queryExecution().optimizedPlan().toString()
    want = {r.qname for r in names.collect() if r.scores["dga"] >= 0.2}
    assert {r.qname for r in over.collect()} == want


@pytest.mark.parametrize("repeats, distinct", [(40, 24), (1, 600)])
def test_forests_over_many_rows(spark, tmp_path, monkeypatch, repeats, distinct):
    """Rows that repeat are counted and drawn by their counts, others are fitted in blocks: the forest is that of the rows."""
    rows = spark.createDataFrame(
        [(float(i % 6), float(i), "b" if (i % 6 > 3) != (i % 11 == 0) else "a") for i in range(distinct)] * repeats,
        "x double, y double, label string")
    at_once = MO.fit(rows, "label", ["x", "y"], "rf", balanced=True, trees=20, depth=8)
    monkeypatch.setattr(MO, "MANY_ROWS", 0)
    monkeypatch.setattr(MO, "BLOCK_TREES", 8)
    bundle = MO.fit(rows, "label", ["x", "y"], "rf", balanced=True, trees=20, depth=8)
    other = MO.fit(rows.repartition(7), "label", ["x", "y"], "rf", balanced=True, trees=20, depth=8)

    def scores(b):
        return {r.y: r.scores["b"] for r in MO.score(rows.distinct(), b).collect()}

    want, got = scores(at_once), scores(bundle)
    assert len(bundle.classifier.trees) == 20 and sum(abs(want[y] - got[y]) for y in want) / len(want) < 0.1
    if repeats > 1:  # the draws do not depend on partitions
        assert scores(other) == pytest.approx(got, abs=1e-9)
    a, b = at_once.classifier.featureImportances.toArray(), bundle.classifier.featureImportances.toArray()
    assert sum(b) == pytest.approx(1) and abs(a[0] - b[0]) < 0.15
    MO.save(bundle, f"{tmp_path}/forest")
    assert scores(MO.load(f"{tmp_path}/forest")) == got
    assert scores(MO.as_formula(bundle)) == pytest.approx(got, abs=1e-9)


def test_equal_rows_are_drawn_by_their_counts(spark):
    rows = spark.range(3000).select(F.array((F.col("id") % 3).cast("double")).alias("features"), F.lit(0.0).alias("code"),
                                    F.lit(1.0).alias("weight"))
    got = MO.drawn_counts(rows, 400, 1).collect()
    assert [r.n for r in got] == [1000] * 3 and len({tuple(r.draws) for r in got}) == 3
    for r in got:
        mean = sum(r.draws) / 400
        assert abs(mean - 1000) < 8 and 800 < sum((v - mean) ** 2 for v in r.draws) / 399 < 1250


def test_tunnel_flows_are_computed_once(spark):
    """The split reads the flow table several times; it is kept before."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def size(i):
        read.add(1)
        return float(i % 50)

    flows = spark.range(300).repartition(2).select(F.col("id").alias("row_key"), size("id").alias("size")).withColumn(
        "label", F.when(F.col("size") > 20, "Malicious").otherwise("Benign"))
    TR.train_tunnel(flows, {"Random Forest": {"kind": "rf", "trees": 3}}, depth=3).reports["auc"].collect()
    assert read.value == 300


def test_stored_forests(spark, tmp_path, monkeypatch):
    """A forest of more nodes than the driver may hold stays in parts, with the scores and importances of the whole."""
    rows = spark.createDataFrame(
        [(float(i % 97), float(i % 13), "b" if (i % 97 > 40) != (i % 7 == 0) else "a") for i in range(800)],
        "x double, y double, label string")
    monkeypatch.setattr(MO, "MANY_ROWS", 0)
    whole = MO.fit(rows, "label", ["x", "y"], "rf", trees=3, depth=6)
    monkeypatch.setattr(FR, "NODES_AT_ONCE", 50)
    stored = MO.fit(rows, "label", ["x", "y"], "rf", trees=3, depth=6)
    assert len(stored.model.paths) > 1 and stored.model.trees == 3

    def scores(b):
        return {(r.x, r.y): (r.predicted_label, r.scores["a"], r.scores["b"]) for r in MO.score(rows.distinct(), b).collect()}

    want, got = scores(whole), scores(stored)
    assert want.keys() == got.keys() and all(
        want[k][0] == got[k][0] and got[k][1:] == pytest.approx(want[k][1:], abs=1e-9) for k in want)
    assert [r.importance for r in MO.feature_importance(stored, spark).collect()] == pytest.approx(
        sorted(whole.classifier.featureImportances.toArray(), reverse=True), abs=1e-9)
    MO.save(stored, f"{tmp_path}/forest")
    again = MO.load(f"{tmp_path}/forest")
    assert scores(again) == got and again.model.importances == stored.model.importances
    # The blocks of Spark ML are stored alike.
    monkeypatch.setattr(MO, "TASK_ROWS", 0)
    monkeypatch.setattr(MO, "BLOCK_TREES", 2)
    blocks = MO.fit(rows, "label", ["x", "y"], "rf", trees=3, depth=6)
    other = scores(blocks)
    assert len(blocks.model.paths) > 1 and sum(p.getNumTrees for p in blocks.model.parts()) == 3
    assert sum(abs(want[k][1] - other[k][1]) for k in want) / len(want) < 0.15


def test_a_forest_takes_few_jobs(spark, monkeypatch):
    """The driver notes every job: their number must not grow with the trees or their depth."""
    rows = spark.range(3000).select((F.col("id") % 300).cast("double").alias("x"), F.when(
        F.xxhash64("id") % 2 == 0, "a").otherwise("b").alias("label"))
    monkeypatch.setattr(MO, "MANY_ROWS", 0)
    sc = spark.sparkContext

    def jobs(trees):
        sc.setJobGroup(f"forest-{trees}", "")
        MO.fit(rows, "label", ["x"], "rf", trees=trees, depth=20)
        sc.setJobGroup(None, None)
        return len(sc.statusTracker().getJobIdsForGroup(f"forest-{trees}"))

    assert jobs(16) <= jobs(4) + 5


def test_grown_tree_is_the_best_greedy_one():
    """Splits, gains and pruning against brute force over the bins."""
    rng = np.random.default_rng(3)
    x, code = rng.integers(0, 6, (200, 3)).astype("uint8"), rng.integers(0, 2, 200)
    w, drawn = rng.choice([0.5, 2.0], 200), rng.integers(0, 4, 200)
    t = FR.grown(x, code, w, drawn, 2, 6, 4, 3, rng)

    def gini(rows):
        s = np.array([(w * drawn)[rows & (code == c)].sum() for c in (0, 1)])
        return (s.sum() - (s ** 2).sum() / s.sum() if s.sum() else 0.0), s

    def check(i, rows):
        mass, s = gini(rows)
        assert t["stats"][i] == pytest.approx(s) and t["raw"][i] == drawn[rows].sum()
        if t["left"][i] < 0:
            return
        gains = [mass - gini(rows & (x[:, f] <= c))[0] - gini(rows & (x[:, f] > c))[0] for f in range(3) for c in range(5)]
        assert t["gain"][i] == pytest.approx(max(gains) / s.sum())
        low = x[:, t["feature"][i]] <= t["cut"][i]
        a, b = t["left"][i], t["left"][i] + 1
        assert t["left"][a] >= 0 or t["left"][b] >= 0 or t["prediction"][a] != t["prediction"][b]
        check(a, rows & low)
        check(b, rows & ~low)

    check(0, np.ones(200, bool))
    assert len(t["left"]) > 5
