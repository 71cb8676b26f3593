"""Exact ranks and order statistics that do not sort a group, or the whole input, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def seeded_hash(seed: int | str, *parts: Column) -> Column:
    """md5 text of the seed and the parts: a fixed pseudo-random order, the same on every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_rank(df: DataFrame, by: list[str], key: str, seed: int | str, out: str = "rank",
              digits: int = 3) -> DataFrame:
    """0-based rank of every row in the order of `seeded_hash(seed, key)` within its `by` group.

    `key` is unique within a group. md5 spreads evenly, so its first `digits` hex digits cut even
    a single huge group into 16^digits like-sized pieces. Pieces are counted first; a window
    over these counts gives the offset of every piece; rows are only ordered within a piece.
    """
    piece = [*by, "_piece"]
    rows = df.withColumn("_hash", seeded_hash(seed, F.col(key))).withColumn(
        "_piece", F.left("_hash", F.lit(digits)))
    offsets = rows.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_offset",
        F.coalesce(
            F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_piece")
                             .rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*piece).orderBy("_hash", key)) - 1
    # Null-safe: rows without a group are a group of their own.
    offsets = offsets.withColumnsRenamed({c: f"_of_{c}" for c in piece})
    same = F.lit(True)
    for c in piece:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    ranked = rows.withColumn("_place", place).join(offsets, same).drop(*[f"_of_{c}" for c in piece])
    return ranked.withColumn(out, F.col("_offset") + F.col("_place")).drop(
        "_hash", "_piece", "_n", "_offset", "_place")


def shuffled(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    """All rows in a seeded pseudo-random order (a range-partitioned sort)."""
    return df.orderBy(seeded_hash(seed, F.col(key)), key)


_DIGIT_BITS = 20


def pick_ranks(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """For every share p the element at index int((n - 1) * p) of the sorted column `value`.

    `value` holds non-negative BIGINTs below 2^60. Three rounds: each counts the values by their next
    20 bits, finds the digit that holds the wanted index, and keeps only values that match. A
    round sends at most 2^20 counts per share through a window, whatever the input size.
    One row per share: `name`, `value`, `n`.
    """
    # Four scans follow; one number per row is kept for them.
    values = cut_lineage(df.select(F.col(value).cast("bigint").alias("v")).filter(F.col("v").isNotNull()))
    # One row, one entry per share: the broadcast sides below never hold more than len(shares) rows.
    targets = cut_lineage(values.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit(0).cast("bigint").alias("prefix"),
        F.array(*[
            F.struct(F.lit(name).alias("name"), F.col("n"),
                     F.floor((F.col("n") - 1) * F.lit(p)).cast("bigint").alias("left"))
            for name, p in shares.items()]).alias("wants")))
    for level in (2, 1, 0):
        step = 1 << (level * _DIGIT_BITS)
        counts = (
            values.select(F.expr(f"v div {step << _DIGIT_BITS}").alias("prefix"),
                          F.expr(f"v div {step}").alias("next"))
            .join(F.broadcast(targets), "prefix")
            .groupBy("prefix", "next").agg(F.count(F.lit(1)).alias("c"), F.any_value("wants").alias("wants")))
        upto = F.sum("c").over(Window.partitionBy("prefix").orderBy("next"))
        found = counts.withColumn("below", upto - F.col("c")).select(
            F.col("next").alias("prefix"),
            F.explode(F.transform(
                F.filter("wants", lambda w: (w["left"] >= F.col("below"))
                         & (w["left"] < F.col("below") + F.col("c"))),
                lambda w: F.struct(w["name"].alias("name"), w["n"].alias("n"),
                                   (w["left"] - F.col("below")).alias("left")))).alias("want"))
        targets = found.groupBy("prefix").agg(F.collect_list("want").alias("wants"))
    return targets.select(F.col("prefix").alias("value"), F.explode("wants").alias("w")).select(
        "w.name", "value", "w.n")


def score_buckets(df: DataFrame, score: str, buckets: int = 256) -> DataFrame:
    """`_bucket`: number of the quantile range the score lies in. Any cut gives right results
    downstream; quantiles only keep the ranges alike in size."""
    cuts = sorted(set(df.approxQuantile(score, [i / buckets for i in range(1, buckets)], 0.001)))
    edges = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    return df.withColumn("_bucket", F.size(F.filter(edges, lambda e: e <= F.col(score))))
