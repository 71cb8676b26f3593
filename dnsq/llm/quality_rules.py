"""Quality by learned decision lists: ordered conjunctions of thresholds, grown and pruned from labelled statistics.

Method: sequential covering. Documents' statistics are cut at quantiles. A rule for low quality grows condition by
condition: each step counts, in one Spark aggregation over the labelled rows that the rule still holds, the rows of
either label beyond every cut of every statistic, and takes the condition with the largest information gain. The finished
rule is pruned on rows set apart: its last conditions go while that does not lower (low - good) / (low + good).
Rows that a kept rule covers are taken out, and the next rule grows on the rest, until no rule is precise
enough. The list becomes one CASE expression, which can be read, and which Spark applies to all documents.

All statistics are built-in expressions over the whole text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written
from .line_dedup import SPACES

TRAIN_ROWS = 20_000  # labelled rows a list is learned from: a sample by hash if there are more
CUTS = 24
MAX_RULES, MAX_CONDITIONS = 8, 3
MIN_PRECISION = 0.95  # of a rule on the rows set apart; clean documents are worth keeping
MIN_COVER = 5
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"

# Ratios that the rules look at, from the counts below.
STATISTICS = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _without(text, chars: str) -> F.Column:
    """Number of the text's characters that are among these."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the counts behind its columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and
    n_upper, n_digits, n_marks (`!`), n_lines (with a word), n_distinct (words).

    Words lie between spaces. n_repeat_words: words inside 3-word windows that the text has twice or more. NULL
    and empty texts have zeros.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    step = docs.withColumn("__llm_words", words)
    w = F.col("__llm_words")
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(
        F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
    step = step.withColumn("__llm_h", F.when(F.size(w) >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    # Sorted with their places only where some window comes twice.
    h = F.col("__llm_h")
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    twice = F.size(F.array_distinct(h)) < F.size(h)
    step = step.withColumn("__llm_sorted", F.when(twice, placed))
    s = F.col("__llm_sorted")
    again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    places = F.array_sort(F.transform(again, lambda x: x["p"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    repeated = F.aggregate(
        places, start,
        lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["reach"])).alias("n"), (p + 3).alias("reach")),
        lambda acc: acc["n"])
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counts = {
        "n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")), "n_symbols": _without(text, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": F.coalesce(repeated, F.lit(0)),
        "n_upper": _without(text, UPPER), "n_digits": _without(text, DIGITS), "n_marks": _without(text, "!"),
        "n_lines": F.size(lines), "n_distinct": F.size(F.array_distinct(w)),
    }
    return step.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("__llm_words", "__llm_h", "__llm_sorted")


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Condition = tuple[str, str, float]  # statistic, ">" or "<=", cut


def _holds(rule: list[Condition]) -> F.Column:
    cond = F.lit(True)
    for name, sign, cut in rule:
        cond = cond & ((F.col(name) > cut) if sign == ">" else (F.col(name) <= cut))
    return cond


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """Information gained about the covered low rows by going from (p0, n0) to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p > 0 else 0.0


def _best_condition(rows: DataFrame, names: list[str], cuts: dict[str, list[float]]) -> tuple[Condition | None, float, float]:
    """The condition with the largest gain on these rows, and the low and good rows that it leaves."""
    binned = F.array(*[F.struct(F.lit(n).alias("name"), sum(
        ((F.col(n) > c).cast("int") for c in cuts[n]), F.lit(0)).alias("bin")) for n in names])
    counted = (rows.select("low", F.explode(binned).alias("b")).groupBy("b.name", "b.bin")
               .agg(F.sum("low").alias("p"), F.sum(1 - F.col("low")).alias("n")).collect())  # names x (CUTS + 1) lines
    best, size = (0.0, None), (0.0, 0.0)
    for name in names:
        own = {r["bin"]: (r["p"], r["n"]) for r in counted if r["name"] == name}
        p0, n0 = sum(x for x, _ in own.values()), sum(x for _, x in own.values())
        for i, cut in enumerate(cuts[name]):
            lower = [v for b, v in own.items() if b <= i]
            p, n = sum(x for x, _ in lower), sum(x for _, x in lower)
            for sign, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                gain = _gain(p0, n0, a, b) if a >= MIN_COVER else 0.0
                if gain > best[0] + 1e-9:
                    best, size = (gain, (name, sign, cut)), (a, b)
    return best[1], *size


def learn(labelled: DataFrame, label_col: str = "low") -> list[list[Condition]]:
    """The decision list for low quality from rows with the counts and a label (1 low, 0 good), at most TRAIN_ROWS
    of them are expected. No rows, or only one label, give an empty list.

    The list has at most MAX_RULES rules of at most MAX_CONDITIONS conditions each, for the sake of readers; covering
    stops there even where a further rule would hold. A row that is given twice counts twice.
    """
    rows = labelled.select(F.col(label_col).cast("int").alias("low"), *[F.expr(e).alias(k) for k, e in STATISTICS.items()])
    rows = rows.withColumn("apart", F.xxhash64(*STATISTICS) % 3 == 0)
    rows = written(rows.repartition(8), "labelled")
    share = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    found = rows.agg(*[F.percentile_approx(k, share, 10_000).alias(k) for k in STATISTICS]).first()
    cuts = {k: sorted(set(found[k] or [])) for k in STATISTICS}
    names = [k for k in STATISTICS if cuts[k]]
    rules: list[list[Condition]] = []
    left = rows
    while len(rules) < MAX_RULES and names:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            condition, p, n = _best_condition(left.filter(~F.col("apart") & _holds(rule)), names, cuts)
            if condition is None:
                break
            rule.append(condition)
            if n == 0:
                break
        if not rule:
            break
        # Every shortening of the rule on the rows set apart, in one pass.
        tests = left.filter("apart").agg(*[F.sum(F.when(_holds(rule[:i]), y).otherwise(0)).alias(f"{k}{i}")
                                           for i in range(1, len(rule) + 1)
                                           for k, y in (("p", F.col("low")), ("n", 1 - F.col("low")))]).first()
        worth = {i: ((tests[f"p{i}"] or 0) - (tests[f"n{i}"] or 0)) / max(1, (tests[f"p{i}"] or 0) + (tests[f"n{i}"] or 0))
                 for i in range(1, len(rule) + 1)}
        size = max(worth, key=lambda i: (worth[i], -i))
        if (worth[size] + 1) / 2 < MIN_PRECISION or not tests[f"p{size}"]:
            break
        rules.append(rule[:size])
        left = left.filter(~_holds(rule[:size]))
    return rules


def as_sql(rules: list[list[Condition]]) -> str:
    """The list as a CASE expression: the number of the first rule that holds, else NULL."""
    if not rules:
        return "cast(null as int)"
    whens = " ".join(
        "when " + " and ".join(f"({STATISTICS[k]}) {sign} {cut!r}D" for k, sign, cut in rule) + f" then {i + 1}"
        for i, rule in enumerate(rules))
    return f"case {whens} end"


def train_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """At most about TRAIN_ROWS labelled documents: all, or a share chosen by the hash of the id."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    n = known.count()
    if n > TRAIN_ROWS:
        known = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / n))
    known = known.select(F.col(id_col), (1 - F.col(label_col)).alias("low")).dropDuplicates([id_col])
    return docs.drop("low").join(known, id_col)


def judge(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """`docs` with the counts, `base_failed`, `rule` (number of the first rule that holds) and `kept` behind its
    columns; columns of those names are replaced.

    A document is kept if it did not fail the base test and no rule holds. NULL, empty and very short texts fail
    the base test. Equal texts get equal results; an empty table stays empty.
    """
    own = docs.drop(*_COUNTS, "base_failed", "rule", "kept")
    return with_counts(own, text_col).withColumn("base_failed", base_failed()).withColumn(
        "rule", F.expr(as_sql(rules))).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks",
           "n_lines", "n_distinct")

ship(__name__)
