"""Forests over many rows.

A learner that keeps whole forests on the driver and passes over all rows once per level and tree needs memory there for every
node and for every job. Here rows are counted in bins, as Spark ML bins them, every tree is grown within a task over the
counted rows, and the nodes are written by the tasks in the form in which Spark ML stores its forests. The driver sees
thresholds and counts.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_dir

BINS = 32  # of Spark ML's learners
NODES_AT_ONCE = 100_000  # nodes that the driver holds at a time
LEVEL_NODES = 1 << 13  # nodes whose histograms a task holds at a time


@dataclass
class StoredForest:
    """A forest whose nodes are too many for the driver: folders of Spark ML forests, which are used one after the other."""

    paths: list[str]
    importances: list[float]
    trees: int

    hard = False

    @property
    def stages(self) -> list[StoredForest]:
        return [self]

    @property
    def featureImportances(self) -> _Values:  # noqa: N802, as Spark ML names it
        return _Values(self.importances)

    def parts(self) -> Iterator[RandomForestClassificationModel]:
        for path in self.paths:
            yield RandomForestClassificationModel.load(path)

    def scores(self, rows: DataFrame) -> DataFrame:
        """Rows (with the vector `features`) with `_scores`: the mean of the trees' probabilities. The rows are kept after
        each part, so that one part is in memory at a time."""
        out = rows.withColumn("_sum", F.lit(None).cast("array<double>"))
        for part in self.parts():
            found = part.transform(out).withColumn("_raw", vector_to_array("rawPrediction"))
            total = F.when(F.col("_sum").isNull(), F.col("_raw")).otherwise(F.zip_with("_sum", "_raw", lambda a, b: a + b))
            out = cut_lineage(found.select(*rows.columns, total.alias("_sum")))
        mass = F.aggregate("_sum", F.lit(0.0), lambda a, b: a + b)
        return out.withColumn("_scores", F.transform("_sum", lambda v: v / mass)).drop("_sum")


class _Values(list):
    def toArray(self) -> np.ndarray:  # noqa: N802
        return np.array(self)


def new_place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"


def opened(paths: list[str], importances: list[float], nodes: int, trees: int):
    """The forest as one Spark ML model where the driver can hold it, else in its parts."""
    if len(paths) == 1 and nodes <= NODES_AT_ONCE:
        return RandomForestClassificationModel.load(paths[0])
    return StoredForest(paths, importances, trees)


def thresholds(rows: DataFrame, size: int) -> list[list[float]]:
    """Per feature the values at which it may be split, fewer than `BINS`: between all its values where they are few, else
    at quantiles."""
    wide = rows.select(*[F.col("features")[i].alias(f"x{i}") for i in range(size)])
    about = wide.agg(*[F.approx_count_distinct(c).alias(c) for c in wide.columns]).first()
    few = [c for c in wide.columns if about[c] <= 2 * BINS]
    many = [c for c in wide.columns if c not in few]
    out = {}
    if few:
        for c, values in wide.agg(*[F.collect_set(c).alias(c) for c in few]).first().asDict().items():
            if len(values) <= BINS:
                v = np.sort(np.array(values, "float64"))
                out[c] = np.unique(v[:-1] + (v[1:] - v[:-1]) / 2).tolist()
            else:
                many.append(c)
    if many:
        places = [i / BINS for i in range(1, BINS)]
        for c, values in zip(many, wide.approxQuantile(many, places, 0.001)):
            out[c] = sorted(set(values))
    return [out[c] for c in wide.columns]


def binned_counts(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """Rows (`features` as an array, `code`, `weight`) that fall into the same bins as one, with `n`. `bins` has a byte per feature."""
    limits = [np.array(c, "float64") for c in cuts]

    @F.pandas_udf("binary")
    def bins(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        x = np.stack(features.to_numpy())
        coded = np.stack([np.searchsorted(t, x[:, i]) for i, t in enumerate(limits)], 1).astype("uint8")
        return pd.Series([r.tobytes() for r in coded])

    binned = rows.select(bins("features").alias("bins"), "code", "weight")
    return cut_lineage(binned.groupBy("bins", "code", "weight").agg(F.count(F.lit(1)).alias("n")))


def _gini(stats: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Impurity times weight."""
    return total - np.divide((stats ** 2).sum(-1), total, out=np.zeros_like(total), where=total > 0)


def _best_splits(x, code, weight, at, stats, chosen, width):
    """Per node the gain, feature and bin of its best split among the chosen features; no gain where there is none."""
    nodes, classes = stats.shape
    total = stats.sum(1)
    impure = _gini(stats, total)
    gain, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, "int64")
    for j in range(chosen.shape[1]):
        value = x[np.arange(len(at)), chosen[at, j]]
        cells = np.bincount((at * width + value) * classes + code, weight, nodes * width * classes)
        left = cells.reshape(nodes, width, classes).cumsum(1)[:, :-1]
        right = stats[:, None, :] - left
        lw, rw = left.sum(2), right.sum(2)
        least = total[:, None] * 1e-10  # rounding leaves this instead of nothing
        won = (impure[:, None] - _gini(left, lw) - _gini(np.maximum(right, 0), rw)) / total[:, None]
        won = np.where((lw > least) & (rw > least), won, 0.0)
        best = won.argmax(1)
        value = won[np.arange(nodes), best]
        better = value > np.maximum(gain, 1e-12)
        gain[better], feature[better], cut[better] = value[better], chosen[better, j], best[better]
    return gain, feature, cut


def grown(x: np.ndarray, code: np.ndarray, weight: np.ndarray, drawn: np.ndarray, classes: int, width: int, depth: int,
          subset: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree over rows of bins, level by level, as its nodes in that order.

    Rules of Spark ML's classifier: Gini impurity, `subset` features drawn per node, a split needs a gain, and children that
    predict the same are no split.
    """
    taken = drawn > 0
    x, code, drawn = x[taken], code[taken].astype("uint8"), drawn[taken]
    weight = weight[taken] * drawn
    at = np.zeros(len(x), "int64")
    levels, first, nodes = [], 0, 1
    while nodes:
        stats = np.bincount(at * classes + code, weight, nodes * classes).reshape(nodes, classes)
        raw = np.bincount(at, drawn, nodes).astype("int64")
        total = stats.sum(1)
        impurity = np.divide(_gini(stats, total), total, out=np.zeros(nodes), where=total > 0)
        gain, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, "int64")
        if len(levels) < depth:
            chosen = np.argsort(rng.random((nodes, x.shape[1])), 1)[:, :subset]
            if nodes > LEVEL_NODES:
                order = np.argsort(at, kind="stable")
                x, code, drawn, weight, at = x[order], code[order], drawn[order], weight[order], at[order]
            for a in range(0, nodes, LEVEL_NODES):
                b = min(a + LEVEL_NODES, nodes)
                rows = slice(*np.searchsorted(at, [a, b])) if nodes > LEVEL_NODES else slice(None)
                gain[a:b], feature[a:b], cut[a:b] = _best_splits(
                    x[rows], code[rows], weight[rows], at[rows] - a, stats[a:b], chosen[a:b], width)
        split = (gain > 0) & (impurity > 1e-12)
        child = first + nodes + 2 * (np.cumsum(split) - 1)
        levels.append({"prediction": stats.argmax(1), "impurity": impurity, "stats": stats, "raw": raw, "gain": gain,
                       "left": np.where(split, child, -1), "feature": feature, "cut": cut})
        going = split[at]
        x, code, drawn, weight, at = x[going], code[going], drawn[going], weight[going], at[going]
        right = x[np.arange(len(at)), feature[at]] > cut[at]
        at = child[at] - first - nodes + right
        first, nodes = first + nodes, 2 * int(split.sum())
    return _pruned(levels)


def _pruned(levels: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The nodes without splits whose two leaves predict the same, numbered anew."""
    tree = {k: np.concatenate([v[k] for v in levels]) for k in levels[0]}
    ends = np.cumsum([len(v["left"]) for v in levels])
    left = tree["left"]
    for a, b in zip([0, *ends[:-1]][::-1], ends[::-1]):
        inner = np.arange(a, b)[left[a:b] >= 0]
        y, z = left[inner], left[inner] + 1
        same = (left[y] < 0) & (left[z] < 0) & (tree["prediction"][y] == tree["prediction"][z])
        left[inner[same]] = -1
    stays = np.zeros(len(left), bool)
    stays[0] = True
    for a, b in zip([0, *ends[:-1]], ends):
        inner = np.arange(a, b)[stays[a:b] & (left[a:b] >= 0)]
        stays[left[inner]] = stays[left[inner] + 1] = True
    number = np.cumsum(stays) - 1
    tree["left"] = np.where(left >= 0, number[left], -1)
    return {k: v[stays] for k, v in tree.items()}


NODE_ROWS = ("tree int, id int, prediction double, impurity double, stats array<double>, raw bigint, gain double, left int, "
             "right int, feature int, threshold double")


def grow(counted: DataFrame, cuts: list[list[float]], classes: int, trees: int, depth: int, subset: int, seed: int) -> DataFrame:
    """`NODE_ROWS` of all trees. A tree draws the n equal rows of `counted` Poisson(n) times, as a bootstrap does.

    Tasks get all counted rows, packed, and grow some of the trees each. Rows are put in order first and a tree has its own
    random numbers, so it does not depend on partitions.
    """
    spark = counted.sparkSession
    size = len(cuts)
    width = max(len(c) for c in cuts) + 1
    tasks = min(trees, 2 * spark.sparkContext.defaultParallelism)
    limits = np.array([[*c, *[math.nan] * (width - len(c))] for c in cuts])

    # A row of a task: its bins, its code and nothing up to whole words, by which rows are put in order.
    record = -(-(size + 1) // 8) * 8

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                rows = np.zeros((len(p), record), "uint8")
                rows[:, :size] = np.frombuffer(b"".join(p["bins"]), "uint8").reshape(-1, size)
                rows[:, size] = p["code"]
                yield pd.DataFrame({"x": [rows.tobytes()], "weight": [p["weight"].to_numpy("float64").tobytes()],
                                    "n": [p["n"].to_numpy("int64").tobytes()]})

    def grow_some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, parts = None, {"x": bytearray(), "weight": bytearray(), "n": bytearray()}
        for p in batches:
            task = int(p["task"].iloc[0]) if len(p) else task
            for c in parts:
                for blob in p[c]:
                    parts[c] += blob
        if task is None:
            return
        rows = np.frombuffer(parts["x"], "uint8").reshape(-1, record)
        weight, n = np.frombuffer(parts["weight"]), np.frombuffer(parts["n"], "int64")
        order = np.lexsort([weight, *rows.view(">u8").T])
        rows, weight, n = rows[order], weight[order], n[order]
        del order
        parts.clear()
        x, code = rows[:, :size], rows[:, size]
        for tree in range(task, trees, tasks):
            rng = np.random.default_rng((seed, tree))
            t = grown(x, code, weight, rng.poisson(n), classes, width, depth, subset, rng)
            inner = t["left"] >= 0
            for a in range(0, len(inner), 10_000):
                i, end = inner[a : a + 10_000], slice(a, a + 10_000)
                f = np.where(i, t["feature"][end], -1)
                yield pd.DataFrame({
                    "tree": tree, "id": np.arange(a, a + len(i)), "prediction": t["prediction"][end].astype("float64"),
                    "impurity": t["impurity"][end], "stats": list(t["stats"][end]), "raw": t["raw"][end],
                    "gain": np.where(i, t["gain"][end], -1.0), "left": t["left"][end],
                    "right": np.where(i, t["left"][end] + 1, -1), "feature": f,
                    "threshold": np.where(i, limits[f, t["cut"][end]], 0.0)})

    blobs = counted.mapInPandas(packed, "x binary, weight binary, n binary")
    dealt = blobs.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, F.col("task"))
    return cut_lineage(dealt.mapInPandas(grow_some, NODE_ROWS))


def importances(nodes: DataFrame, size: int) -> list[float]:
    """Share of the impurity that each feature takes away, per tree and then over the trees."""
    total = F.aggregate("stats", F.lit(0.0), lambda a, b: a + b)
    won = nodes.filter("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * total).alias("won"))
    by_tree = won.groupBy("tree").agg(F.sum("won").alias("_all"))
    shares = won.join(by_tree, "tree").groupBy("feature").agg(F.sum(F.col("won") / F.col("_all")).alias("share"))
    out = np.zeros(size)
    for r in shares.collect():  # a row per feature
        out[r["feature"]] = r["share"]
    return (out / out.sum() if out.sum() else out).tolist()


def stored(nodes: DataFrame, size: int, classes: int, settings: dict):
    """The trees written as Spark ML writes forests, in parts of at most `NODES_AT_ONCE` nodes, a tree at least."""
    spark = nodes.sparkSession
    counts = sorted(tuple(r) for r in nodes.groupBy("tree").agg(F.count(F.lit(1))).collect())
    parts, held = [[]], 0
    for tree, n in counts:
        if parts[-1] and held + n > NODES_AT_ONCE:
            parts.append([])
            held = 0
        parts[-1].append(tree)
        held += n
    leaf = F.col("left") < 0
    data = F.struct(
        "id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("raw").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"),
                 F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
                 F.lit(-1).alias("numCategories")).alias("split"))

    def about(kind: str, params: dict, **more) -> str:
        return json.dumps({
            "class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000),
            "sparkVersion": spark.version, "uid": f"{kind}_{uuid.uuid4().hex[:12]}",
            "paramMap": {"impurity": "gini", **params}, "defaultParamMap": {}, **more})

    place, paths = new_place(spark), []
    for k, trees in enumerate(parts):
        paths.append(path := f"{place}/part{k}")
        text = about("RandomForestClassificationModel", {**settings, "numTrees": len(trees)}, numFeatures=size,
                     numClasses=classes, numTrees=len(trees))
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        own = {c: v for c, v in settings.items() if c != "featureSubsetStrategy"}
        spark.createDataFrame([(i, about("DecisionTreeClassificationModel", own), 1.0) for i in range(len(trees))],
                              "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        mine = nodes.filter(F.col("tree").between(trees[0], trees[-1]))
        mine.select((F.col("tree") - trees[0]).alias("treeID"), data.alias("nodeData")).write.parquet(f"{path}/data")
    return opened(paths, importances(nodes, size), sum(n for _, n in counts), len(counts))
