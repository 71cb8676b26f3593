"""Queried names against a list of protected names.

The list is cut into slices of at most SLICE names and the names into blocks of about BLOCK, by hash, one row each. The first
slice is searched before the others, and the worst of the best found there is what names of later slices have to reach.
Blocks and the other slices then meet in cells, a group of blocks and a group of slices each, as many as there are tasks:
a cell takes its blocks first and then one slice after the other, so a slice is prepared once per cell and held
alone. `functions.search` bounds all similarities of a block and a slice and compares only the pairs whose bound can reach
the result. Pairs become rows only for the candidates of a model; the results of the cells are merged per name.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pairs import PAIR_CLASSES, jaccard
from ..functions.search import List
from ..functions.similarity import jaro_to_each
from ..functions.text import let, ratio
from ..session import SALTS, cut_lineage

SLICE = 4096
# Slices up to which the list may be broadcast: 64 x 4096 names of at most 253 bytes, 66 MB at most and some 10 as a rule.
BROADCAST_SLICES = 64
BLOCK = 256
# Blocks and slices of a cell: 32,768 names with their best, and 64 slices one after the other.
CELL_BLOCKS, CELL_SLICES = 128, 64

# A scorer gives, for a target, a query and their Jaro similarity, an array of structs (class, score).
Scorer = Callable[[Column, Column, Column], Column]


def linear_scorer(target: Column, query: Column, jaro: Column) -> Column:
    """Scores of the single-edit classes from similarities and the length difference.

    Stands in for a fitted model where a result must be reproducible on any engine.
    """
    longest = F.greatest(F.char_length(target), F.char_length(query))
    near = (
        F.lit(0.5) * jaro
        + F.lit(0.2) * jaccard(target, query)
        + F.lit(0.3) * (F.lit(1.0) - ratio(F.levenshtein(target, query), longest, 0.0))
    )
    diff = F.char_length(target) - F.char_length(query)

    def classes(n: Column) -> Column:
        fits = {
            "addition": F.when(diff < 0, n),
            "omission": F.when(diff > 0, n),
            "replacement": F.when((diff == 0) & (target != query), n),
            "transposition": F.when((diff == 0) & (target != query), n * 0.9),
            "none": F.when(target == query, n),
        }
        return F.array(*[
            F.struct(F.lit(c).alias("class"), F.coalesce(v, F.lit(0.0)).alias("score")) for c, v in fits.items()])

    return let(near, classes)


def protected_slices(protected: DataFrame) -> tuple[DataFrame, int]:
    """`domain`, `position` (0-based) to rows (`slice`, `names`) and the number of slices."""
    last = protected.agg(F.max("position").alias("m")).first()["m"]
    if last is None:
        raise ValueError("the list of protected domains is empty")
    slices = protected.withColumn("slice", F.expr(f"position div {SLICE}")).groupBy("slice").agg(
        F.array_sort(F.collect_list(F.struct("position", "domain"))).alias("names"))
    return slices, int(last) // SLICE + 1


def _meet(blocks: DataFrame, protected: DataFrame) -> tuple[DataFrame, int]:
    """Rows of `blocks`, each with every slice of the list (`slice`, `names`)."""
    slices, count = protected_slices(protected)
    met = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))))
    if count <= BROADCAST_SLICES:
        return met.join(F.broadcast(slices), "slice"), count
    # Many slices: both sides are salted, so one slice number is not one task.
    salted = slices.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = met.withColumn("_salt", F.pmod(F.hash(met.columns[0]), F.lit(SALTS)))
    return met.join(salted, ["slice", "_salt"]).drop("_salt"), count


def _names(queries: DataFrame) -> DataFrame:
    """Distinct names. Scoring is heavy per row, so they keep a full set of partitions: an evenly dealt, stated
    number is not merged away as the few bytes of a name would suggest."""
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return queries.select("qname").filter(F.col("qname").isNotNull()).distinct().repartition(tasks)


_BEST = "array<struct<score:double, position:bigint, target:string>>"


def _searched(k: int, linear: bool):
    """Rows of cells, the blocks (with the scores to reach) before the slices, to one row per name: its best k names of the
    cell's slices as (score, position, target). By the linear score, or else by the similarity ratio."""
    row = pa.struct([("score", pa.float64()), ("position", pa.int64()), ("target", pa.string())])

    class Block:
        def __init__(self, names: list, needed: list) -> None:
            self.names, self.needed = names, np.array(needed, dtype=np.float64)
            # Of a name: scores, positions and texts of its best so far, best first.
            self.score, self.position = np.full((len(names), k), -np.inf), np.full((len(names), k), -1, dtype=np.int64)
            self.target = np.full((len(names), k), None, dtype=object)

        def search(self, listed: List, positions: np.ndarray, targets: np.ndarray) -> None:
            # A name of a later slice has to beat the worst of the k found before.
            needed = np.maximum(self.needed, self.score[:, -1])
            place, score = listed.best_linear(self.names, needed) if linear else listed.most_alike(self.names, k, needed)
            rows = np.flatnonzero((place >= 0).any(axis=1))
            if not len(rows):
                return
            place, score = place[rows], score[rows]
            every = np.concatenate((self.score[rows], score), axis=1)
            position = np.concatenate((self.position[rows], np.where(place >= 0, positions[place], -1)), axis=1)
            target = np.concatenate((self.target[rows], np.where(place >= 0, targets[place], None)), axis=1)
            best = np.lexsort((position, -np.round(every, 12)), axis=1)[:, :k]
            for mine, found in ((self.score, every), (self.position, position), (self.target, target)):
                mine[rows] = np.take_along_axis(found, best, 1)

        def found(self) -> pa.RecordBatch:
            best = [[{"score": s, "position": p, "target": t} for s, p, t in zip(*at) if p >= 0]
                    for at in zip(self.score.tolist(), self.position.tolist(), self.target.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(self.names, pa.string()), pa.array(best, pa.list_(row))], names=["qname", "best"])

    def run(batches):
        cell, blocks = None, []
        for b in batches:
            for i in range(b.num_rows):
                at, names, needed, positions = (b.column(c)[i].as_py() for c in range(4))
                if at != cell:
                    yield from (x.found() for x in blocks)
                    cell, blocks = at, []
                if positions is None:
                    blocks.append(Block(names, needed))
                    continue
                listed, targets = List(names), np.array(names, dtype=object)
                for x in blocks:
                    x.search(listed, np.array(positions, dtype=np.int64), targets)
        yield from (x.found() for x in blocks)

    return run


def _in_cells(blocks: DataFrame, slices: DataFrame, across: int, down: int, k: int, linear: bool) -> DataFrame:
    """Best names (`qname`, `best`) of every block (`block`, `names`, `needed`) in each of `down` groups of slices; blocks are dealt
    to `across` groups. Cells and partitions are the same, so the largest task is one cell."""
    def dealt(rows: DataFrame, own: Column, others: int, at: Callable[[Column, Column], Column], *columns: Column) -> DataFrame:
        return rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select(
            at(own, F.col("_other")).cast("int").alias("cell"), *columns)

    none = F.lit(None).cast("array<bigint>")
    left = dealt(blocks, F.col("block") % across, down, lambda b, s: b * down + s,
                 "names", "needed", none.alias("positions"), F.col("block").alias("at"))
    right = dealt(slices, F.col("slice") % down, across, lambda s, b: b * down + s,
                  F.col("names.domain").alias("names"), F.lit(None).cast("array<double>").alias("needed"),
                  F.col("names.position").cast("array<bigint>").alias("positions"), F.col("slice").alias("at"))
    cells = left.unionByName(right).repartitionById(across * down, "cell")
    return cells.sortWithinPartitions("cell", F.col("positions").isNotNull(), "at").select(
        "cell", "names", "needed", "positions").mapInArrow(_searched(k, linear), f"qname string, best {_BEST}")


def _search(queries: DataFrame, protected: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """(`qname`, `best`): the best k of the whole list, ordered by score and place in the list. With `least` by the linear
    score, from that score on; else by the similarity ratio."""
    linear = least is not None
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices, count = protected_slices(protected)
    names = cut_lineage(queries.select("qname").filter(F.col("qname").isNotNull()).distinct())
    n = max(-(-names.count() // BLOCK), 1)
    floor = F.lit(float("-inf") if least is None else float(least))
    blocks = names.groupBy(F.pmod(F.xxhash64("qname"), F.lit(n)).alias("block")).agg(
        F.array_sort(F.collect_list("qname")).alias("names"))
    first = _in_cells(blocks.withColumn("needed", F.transform("names", lambda _: floor)),
                      slices.filter("slice = 0"), min(n, tasks), 1, k, linear)
    if count == 1:
        return first
    first = cut_lineage(first)
    # What the first slice gives at place k; a name that has fewer than k there keeps the floor.
    needed = F.coalesce(F.get("best", F.lit(k - 1))["score"], floor)
    blocks = first.groupBy(F.pmod(F.xxhash64("qname"), F.lit(n)).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("qname", needed.alias("needed")))).alias("x")).select(
        "block", F.col("x.qname").alias("names"), F.col("x.needed").alias("needed"))
    across = -(-n // CELL_BLOCKS)
    down = min(count - 1, max(-(-count // CELL_SLICES), -(-tasks // across)))
    rest = _in_cells(blocks, slices.filter("slice > 0"), across, down, k, linear)
    # k per cell at most are merged per name, those of the first slice among them.
    merged = first.unionByName(rest.filter(F.size("best") > 0)).groupBy("qname").agg(F.flatten(F.collect_list("best")).alias("best"))
    ordered = F.array_sort(F.transform("best", lambda b: F.struct(
        (-F.round(b["score"], 12)).alias("neg"), b["position"].alias("position"), b["score"].alias("score"), b["target"].alias("target"))))
    return merged.select("qname", F.transform(F.slice(ordered, 1, k), lambda b: F.struct(
        b["score"].alias("score"), b["position"].alias("position"), b["target"].alias("target"))).alias("best"))


def top_candidates(queries: DataFrame, protected: DataFrame, n: int = 50) -> DataFrame:
    """The n protected names most similar to each name, all of them when the list is not longer.

    Columns `qname`, `target`, `position`, `ratio`, `cand_no`. Equal ratios keep list order. NULL names are left out.
    """
    return _search(queries, protected, n).select("qname", F.posexplode("best").alias("i", "b")).select(
        "qname", "b.target", "b.position", F.col("b.score").alias("ratio"), (F.col("i") + 1).alias("cand_no"))


def _best_of(scores: Column, target: Column, position: Column) -> Column:
    """Best class of one pair as (score, -position, -class number, target, class); `none` is left out."""
    return F.array_max(F.transform(
        F.filter(scores, lambda s: s["class"] != "none"),
        lambda s, i: F.struct(
            s["score"].alias("score"), (-position).alias("p"), (-i).alias("c"),
            target.alias("target"), s["class"].alias("class"))))


def best_match(queries: DataFrame, protected: DataFrame, scorer: Scorer | None = None, least: float = 0.0) -> DataFrame:
    """Best protected name and class per queried name over the whole list.

    Columns `qname`, `target`, `predicted_class`, `score`. On equal scores the earlier name, then
    the earlier class wins; a score of 0 is no match. The linear score is searched by bounds; of names without a match of
    `least` or more, that search may stop early and say no match (score 0). A scorer of one's own is applied to all pairs.
    """
    if scorer is not None:
        return _best_of_all(queries, protected, scorer)
    b = F.get("best", F.lit(0))
    diff = F.char_length(b["target"]) - F.char_length("qname")
    # Of a pair, only one single-edit class fits; a transposition never scores above the replacement.
    kind = F.when(diff < 0, "addition").when(diff > 0, "omission").otherwise("replacement")
    hit = F.coalesce(b["score"] > 0, F.lit(False))
    return _search(queries, protected, 1, least).select(
        "qname", F.when(hit, b["target"]).alias("target"), F.when(hit, kind).alias("predicted_class"),
        F.when(hit, b["score"]).otherwise(0.0).alias("score"))


def _best_of_all(queries: DataFrame, protected: DataFrame, scorer: Scorer) -> DataFrame:
    met, count = _meet(_names(queries), protected)
    met = met.withColumn("jaros", jaro_to_each("qname", F.col("names.domain")))
    pairs = met.select("qname", F.array_max(F.transform("names", lambda p, i: _best_of(
        scorer(p["domain"], F.col("qname"), F.get("jaros", i)), p["domain"], p["position"]))).alias("b"))
    if count > 1:
        pairs = pairs.groupBy("qname").agg(F.max("b").alias("b"))
    hit = F.col("b.score") > 0
    return pairs.select(
        "qname", F.when(hit, F.col("b.target")).alias("target"),
        F.when(hit, F.col("b.class")).alias("predicted_class"), F.col("b.score").alias("score"))


def best_scored(scored: DataFrame) -> DataFrame:
    """`best_match` over rows (`qname`, `target`, `cand_no`, `scores`) already scored by a model.

    `scores` is a map of class to probability, in the order of PAIR_CLASSES on equal scores.
    """
    order = F.array(*[F.lit(c) for c in sorted(PAIR_CLASSES)])
    entries = F.transform(F.map_entries("scores"), lambda e: F.struct(
        e["key"].alias("class"), e["value"].alias("score"),
        F.array_position(order, e["key"]).alias("i")))
    row_best = F.array_max(F.transform(
        F.filter(entries, lambda e: e["class"] != "none"),
        lambda e: F.struct(e["score"].alias("score"), (-F.col("cand_no")).alias("p"),
                           (-e["i"]).alias("c"), F.col("target").alias("target"), e["class"].alias("class"))))
    best = scored.withColumn("b", row_best).groupBy("qname").agg(F.max("b").alias("b"))
    hit = F.col("b.score") > 0
    return best.select(
        "qname", F.when(hit, F.col("b.target")).alias("target"),
        F.when(hit, F.col("b.class")).alias("predicted_class"), F.col("b.score").alias("score"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
