"""Training and evaluation jobs of the three detectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexical, pairs
from ..operators import datasets as D, metrics as ME, models as MO
from ..session import cut_lineage
from .jobs import pair_model_rows

# Settings of the established models.
DGA_SPECS = {
    "Logistic Regression": {"kind": "lr"},
    "Random Forest": {"kind": "rf", "trees": 100},
    "Gradient Boosting": {"kind": "gbt", "rounds": 200},
}
TUNNEL_SPECS = {
    "Logistic Regression": {"kind": "lr", "balanced": True},
    "Random Forest": {"kind": "rf", "trees": 200, "balanced": True},
    "Gradient Boosting": {"kind": "gbt", "rounds": 300},
}


@dataclass
class Trained:
    """Fitted bundles by model name and the report tables."""

    bundles: dict[str, MO.Bundle]
    reports: dict[str, DataFrame]


def _split(rows: DataFrame, label: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """80/20 per label. Rows need a unique `row_key`; the split is kept, as every model reads it."""
    marked = cut_lineage(D.stratified_split(rows, label, "row_key", 0.2, seed))
    return marked.filter(~F.col("is_test")), marked.filter("is_test")


def train_dga(labelled: DataFrame, specs: dict[str, dict] | None = None, folds: int = 5, depth: int = MO.DEEPEST) -> Trained:
    """`row_key`, `Domain`, `class`: fit the models, compare train, test and cross-validation.

    Labels are folded to lower case, and `dga` is the positive class.
    """
    specs = specs or DGA_SPECS
    columns = lexical.DGA_FEATURES
    rows = cut_lineage(labelled.select("row_key", "Domain", F.lower("class").alias("domain_class")).withColumns(
        lexical.dga_features(F.col("Domain"))))
    train, test = _split(rows, "domain_class")
    folded = D.kfold(rows, "domain_class", "row_key", folds) if folds else None
    bundles, tr, te, cv = {}, [], [], []
    for name, spec in specs.items():
        bundles[name] = MO.fit(train, "domain_class", columns, depth=depth, **spec)
        tr.append(MO.evaluate(train, "domain_class", bundles[name], "dga", name))
        te.append(MO.evaluate(test, "domain_class", bundles[name], "dga", name))
        if folded is not None:
            cv.append(MO.cross_validate(folded, "domain_class", columns, "dga", name, depth=depth, **spec))
    reports = {"test_metrics": D.stack(te), "train_metrics": D.stack(tr)}
    if cv:
        reports["overfitting"] = ME.overfitting_report(D.stack(tr), D.stack(te), D.stack(cv))
    return Trained(bundles, reports)


def train_pairs(labelled: DataFrame, binary: bool = False, trees: int = 100, depth: int = MO.DEEPEST,
                limit: int | None = None) -> Trained:
    """`row_key`, target, query, class: the balanced forest over the classes, or the plain binary one.

    `limit` reads the first rows in key order only (the binary job's row limit).
    """
    if limit is not None:
        labelled = labelled.orderBy("row_key").limit(limit)
    rows = pair_model_rows(labelled, binary)
    train, test = _split(rows, "classification")
    columns = pairs.BINARY_PAIR_FEATURES if binary else pairs.PAIR_FEATURES
    bundle = MO.fit(train, "classification", columns, "rf", balanced=not binary, trees=trees, depth=depth)
    scored = MO.score(test, bundle)
    return Trained({"Random Forest": bundle}, {
        "report": ME.classification_report(scored, "classification", "predicted_label"),
        "confusion": ME.confusion_matrix(scored, "classification", "predicted_label"),
    })


def train_tunnel(flows: DataFrame, specs: dict[str, dict] | None = None, depth: int = MO.DEEPEST) -> Trained:
    """Labelled flow table (`row_key`, `label`, features): fit, report, rank features."""
    specs = specs or TUNNEL_SPECS
    # The split reads its rows several times, the reports the scores.
    rows = cut_lineage(D.drop_non_model_columns(flows))
    columns = [c for c, t in rows.dtypes if c not in ("row_key", "label", "flow_uid")
               and not t.startswith(("array", "map", "struct", "timestamp", "date"))]
    train, test = _split(rows, "label")
    bundles, reports, aucs = {}, {}, []
    for name, spec in specs.items():
        bundles[name] = MO.fit(train, "label", columns, depth=depth, **spec)
        scored = cut_lineage(MO.score(test, bundles[name]).select("label", "predicted_label", "scores"))
        reports[f"report {name}"] = ME.classification_report(scored, "label", "predicted_label")
        second = bundles[name].labels[1]
        auc = ME.roc_auc(scored.withColumn("s", F.col("scores")[second]), "label", "s", positive=second)
        aucs.append(auc.select(F.lit(name).alias("model"), "roc_auc"))
        if spec["kind"] == "rf":
            reports["confusion"] = ME.confusion_matrix(scored, "label", "predicted_label")
            reports["importance"] = MO.feature_importance(bundles[name], flows.sparkSession, 15)
    reports["auc"] = D.stack(aucs)
    return Trained(bundles, reports)
