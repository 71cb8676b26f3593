"""Spark ML models of the three detectors: training, storage, scoring."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import attach, cut_lineage
from . import forests as FR, formulas as FO
from .alerts import attack_class, hard_label_score
from .datasets import class_weights
from .metrics import METRICS, binary_metrics

DEEPEST = 30  # the largest depth that Spark ML takes; the established forests have no bound
# Up to so many rows Spark ML fits the whole forest at once, and the driver holds all of its nodes.
MANY_ROWS = 100_000
# Counted rows, of a byte per feature and 17 more, up to which every tree is grown within a task.
TASK_ROWS = 4_000_000
# Beyond: a distinct row that is drawn by its count costs about as much as three rows.
COUNTED_COST = 3
BLOCK_TREES = 50  # trees of many rows that do not repeat: a row holds two numbers per tree of the block
FITS_AT_ONCE = 8


@dataclass
class Bundle:
    """A fitted model, or a formula, with what scoring needs: label names by code, feature columns in
    order, and the codes of text columns."""

    model: PipelineModel | FO.Formula | FR.StoredForest
    labels: list[str]
    feature_columns: list[str]
    text_codes: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def classifier(self):
        return self.model.stages[-1]


def missing_columns(columns: list[str], present: list[str]) -> list[str]:
    return [c for c in columns if c not in present]


def numeric(df: DataFrame, name: str) -> Column:
    """A model input: 0.0 when the table lacks the column, -1.0 where it holds no number."""
    if name not in df.columns:
        return F.lit(0.0)
    value = F.col(name).try_cast("double") if dict(df.dtypes)[name] == "string" else F.col(name).cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(-1.0)).otherwise(value)


def with_inputs(df: DataFrame, columns: list[str], text_codes: dict[str, DataFrame] | None = None) -> DataFrame:
    """The array `features` beside the columns. Text columns with codes are looked up; a text without a code is -1.0."""
    coded = {c: t for c, t in (text_codes or {}).items() if c in df.columns}
    rows = df
    for i, (c, table) in enumerate(coded.items()):
        key = f"_text{i}"
        side = table.select(F.col("value").alias(key), F.col("code").cast("double").alias(f"_code{i}"))
        rows = attach(rows.withColumn(key, F.col(c).cast("string")), side, [key], "left")
    at = {c: F.coalesce(F.col(f"_code{i}"), F.lit(-1.0)) for i, c in enumerate(coded)}
    inputs = F.array(*[at[c] if c in at else numeric(df, c) for c in columns])
    return rows.withColumn("features", inputs).select(*df.columns, "features")


def with_vector(df: DataFrame, columns: list[str], text_codes: dict[str, DataFrame] | None = None) -> DataFrame:
    """`with_inputs` with a vector as the learners take it."""
    return with_inputs(df, columns, text_codes).withColumn("features", array_to_vector("features"))


def text_codes(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """`value` and `code` of the text columns among `columns` that hold something else than numbers: their
    distinct values in sorted order, numbered from 0, however many there are.

    The values are sorted in ranges; the counts of the ranges give the number that each starts from.
    """
    texts = [c for c, t in df.dtypes if c in columns and t == "string"]
    if not texts:
        return {}
    other = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts]).first()
    out = {}
    for c in texts:
        if other[c] == 0:
            continue  # numbers that were read as text
        values = df.select(F.col(c).alias("value")).filter(F.col(c).isNotNull()).distinct()
        ranged = cut_lineage(values.repartitionByRange("value").withColumn("_range", F.spark_partition_id()))
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
        starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
            "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        place = F.row_number().over(Window.partitionBy("_range").orderBy("value")) - 1
        out[c] = cut_lineage(ranged.withColumn("_place", place).join(starts, "_range").select(
            "value", (F.col("_start") + F.col("_place")).alias("code")))
    return out


def drawn_counts(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """Equal rows (`features` as an array, `code`, `weight`) as one, with `n` and `draws`: how often each tree draws them.

    A bootstrap draws every row a Poisson(1) number of times, so n equal rows Poisson(n) times. The draws depend on
    the row and the seed alone, not on partitions.
    """
    @F.pandas_udf("array<int>")
    def draws(key: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng((seed, k % 2**64)).poisson(c, trees).astype("int32") for k, c in zip(key, n)])

    counted = cut_lineage(rows.groupBy("features", "code", "weight").agg(F.count(F.lit(1)).alias("n")))
    return counted.withColumn("draws", draws(F.xxhash64("features", "code"), F.col("n")))


def _joined(forests: list[RandomForestClassificationModel], classes: int) -> RandomForestClassificationModel:
    """One forest of the trees of several."""
    sc = SparkSession.getActiveSession().sparkContext
    jvm = sc._jvm.org.apache.spark.ml.classification
    trees = [tree for f in forests for tree in f._java_obj.trees()]
    array = sc._gateway.new_array(jvm.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    first = forests[0]
    model = RandomForestClassificationModel(
        jvm.RandomForestClassificationModel(f"{first.uid}_joined", array, first.numFeatures, classes))
    return model._set(numTrees=len(trees), maxDepth=first.getMaxDepth())


def _forest(rows: DataFrame, size: int, labels: list[str], trees: int, depth: int,
            seed: int) -> RandomForestClassificationModel | FR.StoredForest:
    """The forest of many rows (`features` as an array, `code`, `weight`).

    Spark ML passes over all rows and trees once per level, and the driver keeps every node and what it notes of every job. So rows
    are counted in bins, and every tree is grown within a task over the counted rows. Where even these are too many for a
    task, Spark ML fits blocks of trees, which are written and dropped one after the other.
    """
    cuts = FR.thresholds(rows, size)
    counted = FR.binned_counts(rows, cuts)
    subset = "sqrt" if trees > 1 else "auto"
    if len(labels) <= 256 and counted.count() <= TASK_ROWS:  # a code is a byte there
        nodes = FR.grow(counted, cuts, len(labels), trees, depth, math.ceil(math.sqrt(size)) if trees > 1 else size, seed)
        return FR.stored(nodes, size, len(labels), {
            "labelCol": "code", "weightCol": "weight", "maxDepth": depth, "featureSubsetStrategy": subset, "seed": seed})
    return _forest_in_blocks(rows, size, labels, trees, depth, seed, subset)


def _forest_in_blocks(rows: DataFrame, size: int, labels: list[str], trees: int, depth: int, seed: int,
                      subset: str) -> RandomForestClassificationModel | FR.StoredForest:
    """Blocks of trees. Where rows repeat, every tree is fitted over the distinct rows with the counts it draws; else the rows
    remember their nodes. A block has at most `BLOCK_TREES` trees, fewer where those before had many nodes."""
    def inputs(df: DataFrame, *others) -> DataFrame:
        # The widths are given, so that no fit looks for them, and a tree that draws no row of a class still knows of it.
        return df.select(
            array_to_vector("features").alias("features", metadata={"ml_attr": {"num_attrs": size}}),
            F.col("code").alias("code", metadata={"ml_attr": {"type": "nominal", "vals": labels}}), "weight", *others)

    settings = {"labelCol": "code", "weightCol": "weight", "maxDepth": depth, "featureSubsetStrategy": subset}
    counted = drawn_counts(rows, trees, seed)
    n, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    repeated = n >= MANY_ROWS + COUNTED_COST * distinct
    kept = inputs(counted, "draws") if repeated else inputs(rows)
    kept = kept.repartition(1 + (distinct if repeated else n) // 100_000).persist()

    def grow(i: int) -> RandomForestClassificationModel:
        times = F.col("draws")[i]
        mine = kept.filter(times > 0).withColumn("weight", F.col("weight") * times)
        return RandomForestClassifier(numTrees=1, bootstrap=False, seed=seed + i, **settings).fit(mine)

    def block(start: int, end: int) -> RandomForestClassificationModel:
        if not repeated:
            return RandomForestClassifier(numTrees=end - start, seed=seed + start, cacheNodeIds=True, **settings).fit(kept)
        with ThreadPool(min(FITS_AT_ONCE, end - start)) as pool:
            grown = pool.map(inheritable_thread_target(rows.sparkSession)(grow), range(start, end), chunksize=1)
        return _joined(grown, len(labels))

    place, paths, nodes, shares, done = FR.new_place(rows.sparkSession), [], 0, np.zeros(size), 0
    try:
        kept.count()
        while done < trees:
            # The first tree tells how many a block may have.
            fit_now = 1 if not done else max(1, min(BLOCK_TREES, FR.NODES_AT_ONCE * done // nodes))
            end = min(trees, done + fit_now)
            part = block(done, end)
            nodes += part.totalNumNodes
            shares += part.featureImportances.toArray() * (end - done)
            part.write().save(f"{place}/part{len(paths)}")
            paths.append(f"{place}/part{len(paths)}")
            del part
            done = end
    finally:
        kept.unpersist()
    stored = FR.StoredForest(paths, (shares / (shares.sum() or 1.0)).tolist(), trees)
    return stored if nodes > FR.NODES_AT_ONCE else _joined(list(stored.parts()), len(labels))


def _estimator(kind: str, trees: int | None, rounds: int | None, depth: int, seed: int, weighted: bool):
    weight = {"weightCol": "weight"} if weighted else {}
    if kind == "lr":
        return LogisticRegression(featuresCol="scaled", labelCol="code", maxIter=1000, **weight)
    if kind == "rf":
        return RandomForestClassifier(labelCol="code", numTrees=trees or 100, maxDepth=depth, seed=seed, **weight)
    if kind == "gbt":
        return GBTClassifier(labelCol="code", maxIter=rounds or 200, maxDepth=6, stepSize=0.1,
                             subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, **weight)
    raise ValueError(f"unknown kind of model: {kind}")


def fit(train: DataFrame, label: str, columns: list[str], kind: str, balanced: bool = False,
        trees: int | None = None, rounds: int | None = None, depth: int = DEEPEST, seed: int = 42) -> Bundle:
    """Fit one model. kind: 'lr' (scaled inputs), 'rf', 'gbt' (two classes).

    `balanced` weights every row by n / (classes * rows of its class); a random forest with it
    is the balanced forest: every tree sees all classes with equal weight.
    """
    labels = sorted(str(r[0]) for r in train.select(label).distinct().collect())
    codes = text_codes(train, columns)
    names = F.array(*[F.lit(x) for x in labels])
    rows = with_inputs(train, columns, codes).withColumn(
        "code", (F.array_position(names, F.col(label).cast("string")) - 1).cast("double"))
    if balanced:
        weights = class_weights(train, label).select(label, "weight")
        rows = attach(rows, weights, [label], rows=len(labels))
    if kind == "rf" and train.count() > MANY_ROWS:
        weighted = rows.select("features", "code", F.col("weight") if balanced else F.lit(1.0).alias("weight"))
        forest = _forest(weighted, len(columns), labels, trees or 100, depth, seed)
        model = forest if isinstance(forest, FR.StoredForest) else PipelineModel([forest])
        return Bundle(model, labels, list(columns), codes)
    keep = ["code", *(["weight"] if balanced else [])]
    rows = rows.select(array_to_vector("features").alias("features"), *keep).persist()
    try:
        stages = []
        if kind == "lr":
            n = rows.count()
            # The scaler divides by the sample deviation; the factor turns it into the population's.
            factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
            stages = [
                StandardScaler(inputCol="features", outputCol="sampled", withMean=True, withStd=True),
                ElementwiseProduct(scalingVec=Vectors.dense([factor] * len(columns)),
                                   inputCol="sampled", outputCol="scaled"),
            ]
        model = Pipeline(stages=[*stages, _estimator(kind, trees, rounds, depth, seed, balanced)]).fit(rows)
    finally:
        rows.unpersist()
    return Bundle(model, labels, list(columns), codes)


def save(bundle: Bundle, path: str) -> None:
    """The model and, beside it, its label names, feature columns and the codes of text columns."""
    for i, table in enumerate(bundle.text_codes.values()):
        table.write.mode("overwrite").parquet(f"{path}/codes{i}")
    side = {"labels": bundle.labels, "feature_columns": bundle.feature_columns, "text_columns": list(bundle.text_codes)}
    if isinstance(bundle.model, FR.StoredForest):
        for i, part in enumerate(bundle.model.parts()):
            part.write().overwrite().save(f"{path}/model/part{i}")
        side["stored"] = {"parts": len(bundle.model.paths), "importances": bundle.model.importances, "trees": bundle.model.trees}
    else:
        bundle.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def as_formula(bundle: Bundle) -> Bundle:
    """The same model as an expression."""
    model = bundle.model
    if isinstance(model, FR.StoredForest):  # a formula is held whole
        model = PipelineModel([_joined(list(model.parts()), len(bundle.labels))])
    return Bundle(FO.from_fitted(SparkSession.getActiveSession(), model), bundle.labels, bundle.feature_columns,
                  bundle.text_codes)


def load(path: str) -> Bundle:
    spark = SparkSession.getActiveSession()
    side = json.loads(spark.read.text(f"{path}/about").first()["value"])
    if "stored" in side:
        own = side["stored"]
        model = FR.StoredForest([f"{path}/model/part{i}" for i in range(own["parts"])], own["importances"], own["trees"])
    else:
        model = PipelineModel.load(f"{path}/model")
    return Bundle(model, side["labels"], side["feature_columns"],
                  {c: spark.read.parquet(f"{path}/codes{i}") for i, c in enumerate(side["text_columns"])})


def score(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Input columns with `predicted_label` and `scores` (class to probability).

    `scores` is NULL for a model without probabilities.
    """
    names = F.array(*[F.lit(x) for x in bundle.labels])
    if isinstance(bundle.model, FR.StoredForest):
        rows = bundle.model.scores(with_vector(df, bundle.feature_columns, bundle.text_codes))
        return rows.select(*df.columns, F.get(names, FO.best(F.col("_scores"))).alias("predicted_label"),
                           F.map_from_arrays(names, "_scores").alias("scores"))
    if not isinstance(bundle.model, PipelineModel):
        rows = FO.scores(bundle.model, with_inputs(df, bundle.feature_columns, bundle.text_codes), "features")
        by_label = F.lit(None).cast("map<string,double>") if bundle.model.hard else F.map_from_arrays(names, "_scores")
        return rows.select(*df.columns, F.get(names, FO.best(F.col("_scores"))).alias("predicted_label"),
                           by_label.alias("scores"))
    out = bundle.model.transform(with_vector(df, bundle.feature_columns, bundle.text_codes))
    label = F.get(names, F.col("prediction").cast("int"))
    if "probability" in out.columns:
        probabilities = F.slice(vector_to_array("probability"), 1, len(bundle.labels))
        scores = F.map_from_arrays(names, probabilities)
    else:
        scores = F.lit(None).cast("map<string,double>")
    return out.select(*df.columns, label.alias("predicted_label"), scores.alias("scores"))


def score_names(queries: DataFrame, bundle: Bundle, features) -> DataFrame:
    """Score each distinct `qname` once: `features(qname)` builds the model's input columns.

    The scores are kept. Else a filter on them, which depends on the name alone, would move below the distinct, and through a
    join by name to its other side: every line would be scored.
    """
    names = queries.select("qname").distinct()
    scored = score(names.withColumns(features(F.col("qname"))), bundle)
    return cut_lineage(scored.select("qname", "predicted_label", "scores"))


def join_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries with the scored names they ask for. `hits` (unique on `qname`) is kept, so nothing is
    scored twice; a name may be behind a large share of the queries. Where a filter chose the hits by an expression of the
    name, the scores are to be kept before it (see `score_names`)."""
    return attach(queries, cut_lineage(hits), ["qname"])


def score_flows(flows: DataFrame, bundle: Bundle, batch: bool = True) -> DataFrame:
    """Flows with `predicted_label` and `malicious_score`.

    The attack class is chosen from the label names. A batch run scores 0 where there is none;
    a live run has no alerts then. Without probabilities, a live run scores 1 for an attack label.
    """
    scored = score(flows, bundle)
    at = attack_class(bundle.labels, batch)
    if "scores" in scored.columns and _has_probabilities(bundle):
        value = F.lit(0.0) if at is None else F.col("scores")[bundle.labels[at]]
    else:
        value = F.lit(0.0) if batch else hard_label_score(F.col("predicted_label"))
    return scored.withColumn("malicious_score", value).drop("scores")


def _has_probabilities(bundle: Bundle) -> bool:
    if not isinstance(bundle.model, PipelineModel):
        return not bundle.model.hard
    return bundle.classifier.hasParam("probabilityCol")


def score_summary(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("rows_total"),
                      F.count_if(F.col("malicious_score") >= threshold).alias("alerts"),
                      F.lit(float(threshold)).alias("threshold"))


def feature_importance(bundle: Bundle, spark: SparkSession, top: int | None = None) -> DataFrame:
    """Importance per feature, highest first. One row per model column."""
    values = [float(v) for v in bundle.classifier.featureImportances.toArray()]
    rows = list(zip(bundle.feature_columns, values))
    ranked = spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")
    return ranked.limit(top) if top else ranked


def evaluate(df: DataFrame, label: str, bundle: Bundle, positive: str, model: str) -> DataFrame:
    """Binary metrics of a model on labelled rows, one row."""
    scored = score(df, bundle)
    return binary_metrics(scored, label, "predicted_label", positive=positive).select(
        F.lit(model).alias("model"), *METRICS)


def cross_validate(folded: DataFrame, label: str, columns: list[str], positive: str, model: str,
                   **options) -> DataFrame:
    """Metrics per fold: fit on the other folds, score the fold. `folded` has a column `fold`."""
    out = None
    for (i,) in sorted(folded.select("fold").distinct().collect()):
        bundle = fit(folded.filter(F.col("fold") != i), label, columns, **options)
        one = evaluate(folded.filter(F.col("fold") == i), label, bundle, positive, model)
        out = one if out is None else out.unionByName(one)
    return out
