"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, side, written


def _hooked(pairs: DataFrame, name: str, rows: int) -> DataFrame:
    """(x, y) with the smallest y of each x, itself included. The minimum is written, so that the join deals both
    sides anew and a node with very many edges can be split."""
    least = written(pairs.groupBy("x").agg(F.min("y").alias("m")), name, rows=rows)
    return pairs.join(side(least), "x").withColumn("m", F.least("x", "m"))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
    return r[0], r[1]


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node it can reach. `rows`: about how many edges.

    Stars halve the distance to the root, so the rounds grow with the logarithm of a component's width.
    Loops and repeated edges are allowed, nodes are of any ordered type, no edges give no rows.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    e = written(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(u, v).distinct(), "edges", rows=rows)
    nodes = e.filter("u = v").select("u").distinct()
    e = e.filter("u <> v")
    before = _state(e)
    while before[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        large = _hooked(both, "least", before[0]).filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star", rows=before[0])
        small = _hooked(large.select(F.col("u").alias("x"), F.col("v").alias("y")), "least", before[0])
        e = small.select(F.col("y").alias("u"), F.col("m").alias("v")).union(small.select("x", "m"))
        e = written(e.filter("u <> v").distinct(), "small-star", rows=before[0])
        now = _state(e)
        if now == before:
            break
        before = now
    roots = e.select("v").distinct()
    found = e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))
    alone = nodes.join(found, nodes["u"] == found["node"], "left_anti")
    return found.union(alone.select("u", "u"))


ship(__name__)
