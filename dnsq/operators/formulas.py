"""Models as tables of numbers: linear weights or tree nodes, evaluated as one built-in expression.

The expression is SQL text without functions of an engine's own, so the same model runs in Spark (`Column`),
in Spark SQL and in other databases, and a scoring job needs no model library. Its size grows with the model,
not with the data: forests of many thousand nodes are better scored by the fitted model itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.feature import ElementwiseProduct, StandardScalerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

SCHEMA = "tree int, node int, feature int, threshold double, below int, above int, factor double, leaf array<double>"
LINEAR = -1  # `tree` of the rows of a linear model


def number(v: float) -> str:
    """A double in SQL text; without an exponent it would be a decimal."""
    text = repr(float(v))
    return f"({text})" if "e" in text else f"({text}e0)"


@dataclass(frozen=True)
class Linear:
    """Weights per class (one row for two classes: the odds of the second). `hard` models give labels only."""

    weights: list[list[float]]
    intercepts: list[float]
    hard: bool = False

    def raw(self, inputs: Sequence[str]) -> list[str]:
        return [" + ".join([number(b), *(f"{number(w)} * {x}" for w, x in zip(row, inputs))])
                for row, b in zip(self.weights, self.intercepts)]

    def probabilities(self, raw: Sequence[str]) -> list[str]:
        if len(raw) == 1:
            return [f"1e0 / (1e0 + exp({raw[0]}))", f"1e0 / (1e0 + exp(-({raw[0]})))"]
        top = f"greatest({', '.join(raw)})"
        powers = [f"exp({m} - {top})" for m in raw]
        return [f"{p} / ({' + '.join(powers)})" for p in powers]

    def rows(self) -> list[tuple]:
        return [(LINEAR, i, None, b, None, None, float(self.hard), [float(w) for w in row])
                for i, (row, b) in enumerate(zip(self.weights, self.intercepts))]


@dataclass(frozen=True)
class Node:
    """An inner node (inputs up to the threshold go `below`) or a leaf with its values."""

    feature: int | None = None
    threshold: float | None = None
    below: int | None = None
    above: int | None = None
    leaf: tuple[float, ...] = ()


@dataclass(frozen=True)
class Trees:
    """Trees with a factor each. A leaf holds the share of every class (forest, averaged) or one number
    (boosting: half the log odds of the second of two classes, summed)."""

    trees: list[dict[int, Node]]
    factors: list[float]
    hard: bool = False

    @property
    def boosting(self) -> bool:
        return all(len(n.leaf) <= 1 for tree in self.trees for n in tree.values())

    def _case(self, tree: dict[int, Node], at: int, inputs: Sequence[str], place: int) -> str:
        n = tree[at]
        if n.feature is None:
            return number(n.leaf[place])
        below, above = (self._case(tree, i, inputs, place) for i in (n.below, n.above))
        return f"case when {inputs[n.feature]} <= {number(n.threshold)} then {below} else {above} end"

    def raw(self, inputs: Sequence[str]) -> list[str]:
        places = max(len(n.leaf) for tree in self.trees for n in tree.values())
        return [" + ".join(f"{number(f)} * {self._case(tree, 0, inputs, p)}" for tree, f in zip(self.trees, self.factors))
                for p in range(places)]

    def probabilities(self, raw: Sequence[str]) -> list[str]:
        if self.boosting:
            return [f"1e0 / (1e0 + exp(2e0 * ({raw[0]})))", f"1e0 / (1e0 + exp(-2e0 * ({raw[0]})))"]
        return [f"({m}) / {number(sum(self.factors))}" for m in raw]

    def rows(self) -> list[tuple]:
        return [(t, i, n.feature, n.threshold if n.feature is not None else float(self.hard), n.below, n.above, f,
                 [float(v) for v in n.leaf])
                for t, (tree, f) in enumerate(zip(self.trees, self.factors)) for i, n in tree.items()]


Formula = Linear | Trees


def scores(model: Formula, rows: DataFrame, inputs: str) -> DataFrame:
    """`rows` with `_scores`: an array, one score per class, from the array column `inputs`."""
    size = max((len(w) for w in model.weights), default=0) if isinstance(model, Linear) else 1 + max(
        (n.feature for t in model.trees for n in t.values() if n.feature is not None), default=-1)
    raw = model.raw([f"{inputs}[{i}]" for i in range(size)])
    # The margins are a column of their own, so that a large model is written once and not once per class.
    with_raw = rows.withColumn("_raw", F.expr(f"array({', '.join(raw)})"))
    parts = model.probabilities([f"_raw[{i}]" for i in range(len(raw))])
    return with_raw.withColumn("_scores", F.expr(f"array({', '.join(parts)})")).drop("_raw")


def best(values: Column) -> Column:
    """Position of the largest value from 0, the first of equal ones."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def sql(model: Formula, inputs: Sequence[str]) -> list[str]:
    """SQL text of the score of every class; `inputs` are the texts of the feature columns in model order,
    doubles without NULL."""
    return model.probabilities([f"({m})" for m in model.raw(inputs)])


def to_table(spark: SparkSession, model: Formula) -> DataFrame:
    """A line per class of a linear model or per node of a tree."""
    return spark.createDataFrame(model.rows(), SCHEMA)


def from_table(table: DataFrame) -> Formula:
    """The model of `to_table`. The lines of one model come to the driver, as those of any model do."""
    lines = sorted(table.collect(), key=lambda r: (r.tree, r.node))
    if lines and lines[0].tree == LINEAR:
        return Linear([list(r.leaf) for r in lines], [r.threshold for r in lines], bool(lines[0].factor))
    trees, factors, hard = {}, {}, False
    for r in lines:
        inner = r.feature is not None
        hard = hard or (not inner and bool(r.threshold))
        trees.setdefault(r.tree, {})[r.node] = (
            Node(r.feature, r.threshold, r.below, r.above) if inner else Node(leaf=tuple(r.leaf)))
        factors[r.tree] = r.factor
    return Trees([trees[t] for t in sorted(trees)], [factors[t] for t in sorted(factors)], hard)


def _nodes(spark: SparkSession, model, shares: bool) -> list[dict[int, Node]]:
    """The trees as the stored model lists their nodes."""
    place = f"{shared_dir(spark)}/formula-{uuid.uuid4().hex}"
    model.write().save(place)
    n = F.col("nodeData")
    lines = spark.read.parquet(f"{place}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["prediction"].alias("value"), n["impurityStats"].alias("stats"),
        n["leftChild"].alias("below"), n["rightChild"].alias("above"), n["split"]["featureIndex"].alias("feature"),
        n["split"]["numCategories"].alias("categories"), n["split"]["leftCategoriesOrThreshold"].alias("at")).collect()
    trees: dict[int, dict[int, Node]] = {}
    for r in lines:
        if r.below < 0:
            total = sum(r.stats)
            node = Node(leaf=tuple(v / total for v in r.stats) if shares else (r.value,))
        elif r.categories >= 0:
            raise ValueError("splits by category have no threshold")
        else:
            node = Node(r.feature, r["at"][0], r.below, r.above)
        trees.setdefault(r.tree, {})[r.id] = node
    return [trees[t] for t in sorted(trees)]


def from_fitted(spark: SparkSession, pipeline: PipelineModel) -> Formula:
    """The formula of a fitted model of `models.fit`: scaling is folded into the weights."""
    model = pipeline.stages[-1]
    if isinstance(model, RandomForestClassificationModel):
        return Trees(_nodes(spark, model, True), list(model.treeWeights))
    if isinstance(model, GBTClassificationModel):
        return Trees(_nodes(spark, model, False), list(model.treeWeights))
    if not isinstance(model, LogisticRegressionModel):
        raise TypeError(f"no formula for {type(model).__name__}")
    weights = model.coefficientMatrix.toArray()
    intercepts = model.interceptVector.toArray()
    for stage in reversed(pipeline.stages[:-1]):
        if isinstance(stage, ElementwiseProduct):
            weights = weights * stage.getScalingVec().toArray()
        elif isinstance(stage, StandardScalerModel):
            # A column without spread is scaled to 0, so it has no weight.
            spread = stage.std.toArray()
            weights = weights * [1 / v if v > 0 else 0.0 for v in spread]
            intercepts = intercepts - weights @ stage.mean.toArray()
        else:
            raise TypeError(f"no formula for {type(stage).__name__}")
    return Linear(weights.tolist(), intercepts.tolist())
