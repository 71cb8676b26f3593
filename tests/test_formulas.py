import duckdb
import pytest
from pyspark.sql import functions as F

from dnsq.functions import lexical
from dnsq.operators import alerts as A, formulas as FO, models as MO
from dnsq.plans import jobs
from dnsq.sources.readers import parse_alerts
from dnsq.streaming import jobs as SJ
from dnsq.workload import fixed_models as FM
from tests.test_models import SMALL, domains, trained  # noqa: F401


@pytest.mark.parametrize("name", list(SMALL))
def test_formula_equals_the_fitted_model(spark, domains, trained, name):  # noqa: F811
    fitted = trained.bundles[name]
    rows = domains.withColumns(lexical.dga_features(F.col("Domain"))).withColumn(
        "entropy", F.when(F.xxhash64("row_key") % 9 != 0, F.col("entropy")))  # missing values too
    want = {r.row_key: r for r in MO.score(rows, fitted).collect()}
    formula = MO.as_formula(fitted)
    again = MO.Bundle(FO.from_table(FO.to_table(spark, formula.model)), fitted.labels, fitted.feature_columns)
    for bundle in (formula, again):
        got = MO.score(rows, bundle).collect()
        assert len(got) == len(want)
        for r in got:
            assert r.predicted_label == want[r.row_key].predicted_label
            assert r.scores == pytest.approx(want[r.row_key].scores, abs=1e-9)
    names = fitted.feature_columns
    values = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in names], "row_key").toPandas()
    con = duckdb.connect()
    con.register("v", values)
    for key, p in con.execute(f"select row_key, {FO.sql(formula.model, names)[0]} from v").fetchall():
        assert p == pytest.approx(want[key].scores["dga"], abs=1e-9)


def test_three_classes_and_a_column_without_spread(spark):
    df = spark.createDataFrame([(float(i % 3), float(i % 5), 4.0, "abc"[i % 3]) for i in range(60)], "x double, y double, z double, label string")
    fitted = MO.fit(df, "label", ["x", "y", "z"], "lr")
    want = [(r.predicted_label, r.scores) for r in MO.score(df, fitted).orderBy("x", "y").collect()]
    got = [(r.predicted_label, r.scores) for r in MO.score(df, MO.as_formula(fitted)).orderBy("x", "y").collect()]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] == pytest.approx(w[1], abs=1e-9) for g, w in zip(got, want))


def test_ties_hard_labels_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None)], "row_index bigint, x double")
    tie = MO.Bundle(FO.Linear([[0.0]], [0.0]), ["Benign", "Malicious"], ["x"])
    assert {(r.predicted_label, r.scores["Malicious"]) for r in MO.score(df, tie).collect()} == {("Benign", 0.5)}
    hard = MO.Bundle(FO.Linear([[1.0], [-1.0]], [0.0, 0.0], hard=True), ["attack", "benign"], ["x"])
    got = {r.row_index: (r.predicted_label, r.malicious_score) for r in MO.score_flows(df, hard, batch=False).collect()}
    assert got == {1: ("attack", 1.0), 2: ("attack", 1.0), 3: ("benign", 0.0)}
    assert {r.malicious_score for r in MO.score_flows(df, hard).collect()} == {0.0}
    assert FO.from_table(FO.to_table(spark, hard.model)).hard
    assert MO.score(df.limit(0), tie).count() == 0
    assert FO.from_table(FO.to_table(spark, FM.BOOSTED)) == FM.BOOSTED and FM.BOOSTED.boosting and not FM.FOREST.boosting


def test_findings_of_a_batch_run(spark):
    df = spark.createDataFrame([("f1", 4.0, None), ("f2", -4.0, "a")], "flow_id string, x double, src_ip string")
    bundle = MO.Bundle(FO.Linear([[1.0]], [0.0]), ["Benign", "Malicious"], ["x", "gone"])
    out = jobs.tunnel_scoring(df, bundle)
    (hit,) = out["alerts"].collect()
    assert (hit.predicted_label, hit.malicious_score, hit.src_ip, hit.dst_ip) == ("Malicious", 0.982014, "", "")
    assert out["missing_feature_columns"] == ["gone"]
    assert A.tunnel_findings(MO.score_flows(df, bundle).withColumn("row_index", F.lit(1)), 0.0).count() == 2


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i)) for i in range(4)], "id bigint, x double")
    rows.write.parquet(f"{tmp_path}/in")
    steps = {"double": lambda b: b.withColumn("x", F.col("x") * 2), "large": lambda b: b.filter("x >= 4")}
    for i in range(2):  # progress is lost once, so the same files are read as batch 0 again
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        SJ.start_chain(stream, steps, f"{tmp_path}/out", f"{tmp_path}/cp{i}", None).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/double").count() == 4
    assert sorted(r.x for r in spark.read.parquet(f"{tmp_path}/out/large").collect()) == [4.0, 6.0]


def test_alert_logs_keep_both_forms_of_a_row_index(spark):
    lines = spark.createDataFrame([('{"detector": "DNS_TUNNELING", "row_index": 7}',), ('{"detector": "DNS_TUNNELING", "row_index": "file1:7"}',)],
                                  "value string")
    assert [r.row_index for r in parse_alerts(lines).collect()] == ["7", "file1:7"]
