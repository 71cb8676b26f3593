"""Labelled data sets for the models: variants, negatives, splits, class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pairs import PAIR_CLASSES
from ..functions.text import chars
from ..session import attach, cut_lineage
from .ranking import hash_rank

# Own tables of the variant generator: neighbours on a QWERTY keyboard and look-alike characters.
KEY_ROWS = ["1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm"]
LOOKALIKES = {
    "a": ["à", "á", "ä", "а"],
    "b": ["d", "lb"],
    "c": ["e", "ç", "с"],
    "d": ["b", "cl"],
    "e": ["c", "é", "è", "е"],
    "g": ["q", "ğ"],
    "h": ["lh"],
    "i": ["1", "l", "í"],
    "k": ["lk"],
    "l": ["1", "i"],
    "m": ["n", "nn", "rn"],
    "n": ["m", "r", "ñ"],
    "o": ["0", "ö", "о"],
    "q": ["g"],
    "s": ["ş", "ś"],
    "u": ["v", "ü"],
    "v": ["u"],
    "w": ["vv"],
    "z": ["ž", "ż"],
    "0": ["o"],
    "1": ["l", "i"],
}


def key_neighbours() -> dict[str, list[str]]:
    """Keys next to a key: left and right in its row, and the two nearest above and below."""
    out: dict[str, list[str]] = {}
    for r, row in enumerate(KEY_ROWS):
        for i, key in enumerate(row):
            near = [row[i - 1 : i], row[i + 1 : i + 2]]
            if r > 0:
                near += [KEY_ROWS[r - 1][i : i + 1], KEY_ROWS[r - 1][i + 1 : i + 2]]
            if r + 1 < len(KEY_ROWS):
                near += [KEY_ROWS[r + 1][i - 1 : i] if i else "", KEY_ROWS[r + 1][i : i + 1]]
            out[key] = sorted({k for k in near if k})
    return out


def _table(entries: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in entries.items() for x in (
        F.lit(k), F.array(*[F.lit(s) for s in v]))])


def typo_variants(targets: DataFrame) -> DataFrame:
    """`domain` to (`target_domain`, `query_domain`, `classification`), one row per distinct variant.

    Variants change the label before the last one; what lies before it and the last label stay.
    When two classes give the same variant, the first in this order holds: addition, omission,
    replacement, transposition, subdomain, homoglyph. The domain itself is no variant.
    """
    domain = F.col("domain")
    tail = F.when(F.instr(domain, ".") > 0, F.concat(F.lit("."), F.substring_index(domain, ".", -1))).otherwise("")
    front = F.left(domain, F.char_length(domain) - F.char_length(tail))
    label = F.substring_index(front, ".", -1)
    rows = targets.select(F.lower("domain").alias("domain")).distinct().select(
        "domain", tail.alias("tail"), label.alias("label"),
        F.left(front, F.char_length(front) - F.char_length(label)).alias("head"))
    x = F.col("label")
    n = F.char_length(x)
    letters = chars(x)
    where = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def left(i: Column) -> Column:
        return F.substr(x, F.lit(1), i - 1)

    def right(i: Column) -> Column:
        return F.substr(x, i + 1, n)

    def swapped(table: Column) -> Column:
        return F.flatten(F.transform(where, lambda i: F.transform(
            F.coalesce(table[F.get(letters, i - 1)], F.array().cast("array<string>")),
            lambda r: F.concat(left(i), r, right(i)))))

    inner = F.filter(where, lambda i: i < n)
    made = [
        ("addition", F.transform(
            F.array(*[F.lit(c) for c in "0123456789abcdefghijklmnopqrstuvwxyz"]), lambda c: F.concat(x, c))),
        ("omission", F.when(n > 1, F.transform(where, lambda i: F.concat(left(i), right(i))))),
        ("replacement", swapped(_table(key_neighbours()))),
        ("transposition", F.transform(inner, lambda i: F.concat(
            left(i), F.get(letters, i), F.get(letters, i - 1), right(i + 1)))),
        ("subdomain", F.transform(
            F.filter(inner, lambda i: (F.get(letters, i - 1) != "-") & (F.get(letters, i) != "-")),
            lambda i: F.concat(left(i + 1), F.lit("."), right(i)))),
        ("homoglyph", swapped(_table(LOOKALIKES))),
    ]
    def tagged(k: int, name: str, variants: Column) -> Column:
        return F.transform(variants, lambda s: F.struct(
            F.concat("head", s, "tail").alias("q"), F.lit(k).alias("k"), F.lit(name).alias("c")))

    everything = F.flatten(F.filter(
        F.array(*[tagged(k, c, v) for k, (c, v) in enumerate(made)]), lambda a: a.isNotNull()))
    return (
        rows.select("domain", F.explode(everything).alias("v"))
        .filter(F.col("v.q") != F.col("domain"))
        .groupBy(F.col("domain").alias("target_domain"), F.col("v.q").alias("query_domain"))
        .agg(F.min_by("v.c", "v.k").alias("classification")))


def numbered(domains: DataFrame, seed: int | str) -> DataFrame:
    """Distinct domains with a dense 0-based number in seeded pseudo-random order."""
    return hash_rank(domains.select("domain").distinct(), [], "domain", seed, out="idx")


def _stride(seed: int, modulus: int) -> int:
    """A step without a common divisor with the modulus, so that stepping visits everything."""
    from math import gcd

    if modulus <= 2:
        return 1
    step = 1 + (seed * 7919 + modulus * 2 // 3) % (modulus - 1)
    while gcd(step, modulus) != 1:
        step += 1
    return step


def negative_pairs(domains: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """n different unordered pairs of different domains, labelled `none`.

    Pairs are drawn by number, not picked from a list of all pairs: pair number r of m domains
    is (i, i + s mod m) with i = r mod m and s = r div m + 1, which names every unordered pair
    once, and numbers are visited with a step that has no common divisor with their count.
    """
    names = cut_lineage(numbered(domains, seed))
    m = names.count()
    total = m * (m - 1) // 2
    if total < n:
        raise ValueError(f"only {total} different pairs can be made of {m} domains")
    step = _stride(seed, total)
    draws = names.sparkSession.range(n).select(
        F.expr(f"(cast(id as decimal(38,0)) * {step} + {seed}) % {total}").cast("bigint").alias("r")
    ).select(F.expr(f"r % {m}").alias("i"), F.expr(f"(r % {m} + r div {m} + 1) % {m}").alias("j"))
    a = names.select(F.col("domain").alias("a"), F.col("idx").alias("i"))
    b = names.select(F.col("domain").alias("b"), F.col("idx").alias("j"))
    return draws.join(a, "i").join(b, "j").select(
        F.col("a").alias("target_domain"), F.col("b").alias("query_domain"),
        F.lit("none").alias("classification"))


def negative_samples(targets: DataFrame, domains: DataFrame, variants: DataFrame, per_target: int = 40,
                     seed: int = 42) -> DataFrame:
    """`per_target` other domains for every target, class `none`, none of them a variant of it.

    A target at number i steps through i + 1 + (k * step + offset) mod (m - 1), k = 0, 1, ...,
    which visits every other domain once. It takes as many steps as it needs: `per_target` plus
    the number of its variants that are themselves listed, which are then left out.
    """
    names = cut_lineage(numbered(domains, seed))
    m = names.count()
    if m < 2:
        raise ValueError("negatives need at least two domains")
    step = _stride(seed, m - 1)
    listed = names.select(F.col("domain").alias("query_domain"), F.col("idx").alias("j"))
    taken = cut_lineage(variants.select("target_domain", "query_domain").join(
        listed.select("query_domain"), "query_domain", "left_semi"))
    clashes = taken.groupBy("target_domain").agg(F.count(F.lit(1)).alias("clashes"))
    steps = (
        targets.select(F.col("domain")).distinct().join(names, "domain")
        .withColumnRenamed("domain", "target_domain")
        .join(clashes, "target_domain", "left")
        .withColumn("need", F.least(F.lit(per_target) + F.coalesce("clashes", F.lit(0)), F.lit(m - 1)))
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("need") - 1)))
        .withColumn("j", F.expr(f"(idx + 1 + (k * {step} + idx) % {m - 1}) % {m}")))
    # At most per_target + clashes rows per target reach the window.
    pick = Window.partitionBy("target_domain").orderBy("k")
    return (
        steps.join(listed, "j")
        .join(taken, ["target_domain", "query_domain"], "left_anti")
        .withColumn("rn", F.row_number().over(pick)).filter(F.col("rn") <= per_target)
        .select("target_domain", "query_domain", F.lit("none").alias("classification")))


def fold_case(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("target_domain", F.lower("target_domain")).withColumn(
        "query_domain", F.lower("query_domain"))


def keep_classes(pairs: DataFrame, label: str = "classification") -> DataFrame:
    return pairs.filter(F.col(label).isin(PAIR_CLASSES))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and percentage per class, most frequent first."""
    counts = class_counts(df, label).withColumnRenamed("n", "distribution")
    # One row per class reaches this window.
    share = F.col("distribution") * 100.0 / F.sum("distribution").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percentage", share).orderBy(F.desc("distribution"), label)


def class_downsample(df: DataFrame, label: str, key: str, capped: str, cap: int, seed: int = 42) -> DataFrame:
    """At most `cap` seeded pseudo-random rows of one class, all rows of the others."""
    one = hash_rank(df.filter(F.col(label) == capped), [], key, seed, out="_rank")
    rest = df.filter((F.col(label) != capped) | F.col(label).isNull())
    return one.filter(F.col("_rank") < cap).drop("_rank").unionByName(rest)


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """`is_test` for the first round(share * n) rows of every label in seeded order. Rows without a label are
    split like those of one more label."""
    known = F.to_json(F.struct(F.col(label).alias("v")))  # a text that no label lacks
    ranked = hash_rank(df, [label], key, seed, out="_rank").withColumn("_label", known)
    sizes = df.groupBy(known.alias("_label")).agg(
        F.round(F.count(F.lit(1)) * F.lit(test_share)).cast("bigint").alias("_tests"))
    return attach(ranked, sizes, ["_label"]).withColumn(
        "is_test", F.col("_rank") < F.col("_tests")).drop("_rank", "_tests", "_label").select(*df.columns, "is_test")


def kfold(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """`fold` (0-based), dealt round-robin within every label in seeded order."""
    return hash_rank(df, [label], key, seed, out="_rank").withColumn(
        "fold", F.expr(f"cast(_rank % {folds} as int)")).drop("_rank")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (number of classes * rows of the class) per class."""
    counts = class_counts(df, label)
    everything = Window.partitionBy(F.lit(0))  # one row per class
    return counts.withColumn(
        "weight", F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n")))


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Labels in sorted order, numbered from 0; one row per label, none for a missing one."""
    labels = df.select(label).filter(F.col(label).isNotNull()).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(label)  # one row per label
    return labels.withColumn("code", (F.row_number().over(order) - 1).cast("int"))


def label_encode(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """The label's code beside it; NULL where there is no label."""
    codes = label_codes(df, label).withColumnRenamed("code", out)
    return attach(df, codes, [label], "left")


def standard_scale(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Columns to mean 0 and population standard deviation 1; a constant column becomes 0."""
    source = df if fit_on is None else fit_on
    row = source.agg(*[f(c).alias(f"{p}_{c}") for c in columns
                       for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({
        f"{c}_scaled": (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in columns})


def stack(frames: list[DataFrame]) -> DataFrame:
    """Frames one below the other by column name; a missing column is NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# Identifiers and list columns taken out before a flow model is trained.
NON_MODEL_COLUMNS = [
    "flow_id",
    "timestamp",
    "src_ip",
    "dst_ip",
    "src_port",
    "dst_port",
    "dns_domain_name",
    "dns_top_level_domain",
    "dns_second_level_domain",
    "uni_gram_domain_name",
    "bi_gram_domain_name",
    "tri_gram_domain_name",
    "character_distribution",
    "ans_resource_record_type",
    "ans_resource_record_class",
]


def drop_non_model_columns(flows: DataFrame) -> DataFrame:
    return flows.drop(*NON_MODEL_COLUMNS)
