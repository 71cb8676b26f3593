"""URL verdicts from rules and, where no rule fits, from an empirical-Bayes reputation of the host.

Method. Labelled outcomes (1 bad, 0 good) are counted per host, registered domain and suffix. At each level a
beta prior is centred on the posterior mean of the level above (suffix below the whole table, domain below its suffix,
host below its domain); its strength comes from the spread of the level's rates beyond chance (method of
moments for the beta-binomial). Hosts with few or no outcomes shrink to their domain, and so on. A host is blocked when
the lower bound of its posterior (mean less `z` deviations) exceeds a threshold.

Only built-in expressions and aggregations with map-side partial sums; a host with a third of all pages is one
partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

ALLOW, BLOCK = "allow", "block"
Z = 1.645  # one-sided 95 %
THRESHOLD = 0.5
MIN_SPREAD, MAX_SPREAD = 0.01, 0.5  # bounds of the estimated intra-group correlation
# Two-label public suffixes under which names are registered; below them a registered domain has three labels.
SECOND_LEVEL = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz",
                "org.nz", "co.in", "co.kr", "co.za", "com.ar", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr",
                "com.tw", "com.ua")
_URL = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


def host_of(url) -> F.Column:
    host = F.regexp_extract(url, _URL, 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host, path, rules: list[tuple[str, str, str]]) -> tuple[F.Column, F.Column]:
    """Text and verdict of the longest rule that fits, or NULL. Rules are (verdict, host, path); of rules of equal
    length the first in order of their text is taken."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=False):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def left_alone(host, path, rules: list[tuple[str, str, str]]) -> F.Column:
    """Whether the host is one of a block rule that holds for a part of its paths only, and the path is none of them."""
    alone = F.lit(False)
    for what, h, p in rules:
        if what == BLOCK and p not in ("", "/"):
            alone = alone | (((host == h) | F.endswith(host, F.lit("." + h))) & ~F.startswith(path, F.lit(p)))
    return alone


def _prior(level: DataFrame, centre: float) -> float:
    """Strength of the beta prior of one level: pseudo-outcomes that its centre is worth."""
    some = level.filter("n > 0")
    r = some.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
                 F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("s")).first()
    spread = MAX_SPREAD
    if r["k"] and r["k"] > 1 and 0 < centre < 1:
        chance = centre * (1 - centre)
        scatter = r["s"] - r["n"] * centre * centre
        room = chance * (r["n"] - r["nn"] / r["n"] - (r["k"] - 1))
        if room > 0:
            spread = (scatter - chance * (r["k"] - 1)) / room
    spread = min(MAX_SPREAD, max(MIN_SPREAD, spread))
    return 1 / spread - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, a, b) for every host of `outcomes` (host, bad: 1, 0 or NULL for not labelled): the counts and
    the parameters of its beta posterior. Without any label every posterior is the even prior of two outcomes."""
    labels = F.split("host", r"\.")
    last = lambda n: F.when(F.size(labels) >= n, F.concat_ws(".", F.slice(labels, -n, n)))
    second = F.coalesce(last(2).isin(*SECOND_LEVEL), F.lit(False))
    domain = F.coalesce(F.when(second, last(3)), last(2), F.col("host"))
    suffix = F.when(second, last(2)).otherwise(F.element_at(labels, -1))
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"),
                                         F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = written(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = written(hosts.groupBy("domain", "suffix").agg(*counts), "domains")
    suffixes = written(domains.groupBy("suffix").agg(*counts), "suffixes")
    all_n, all_bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    centre = (all_bad + 1) / (all_n + 2) if all_n else 0.5

    def posterior(level: DataFrame, mean: F.Column, strength: float) -> DataFrame:
        return level.withColumn("a", F.lit(strength) * mean + F.col("bad")).withColumn(
            "b", F.lit(strength) * (1 - mean) + F.col("n") - F.col("bad"))

    mean = F.col("a") / (F.col("a") + F.col("b"))
    suffixes = posterior(suffixes, F.lit(centre), _prior(suffixes, centre)).select("suffix", mean.alias("mean"))
    domains = posterior(domains.join(suffixes, "suffix"), F.col("mean"), _prior(domains, centre))
    domains = domains.select("domain", "suffix", mean.alias("mean"))
    hosts = posterior(hosts.join(domains, ["domain", "suffix"]), F.col("mean"), _prior(hosts, centre))
    return hosts.select("host", "n", "bad", "a", "b")


def lower_bound(z: float = Z) -> F.Column:
    """Posterior mean less z posterior deviations."""
    a, b = F.col("a"), F.col("b")
    return a / (a + b) - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", z: float = Z,
          threshold: float = THRESHOLD) -> DataFrame:
    """`pages` with host, path, rule and verdict behind its columns (replacing columns of those names).

    Pages that a rule fits are labelled outcomes; their verdict is the rule's. A page that no rule fits, on the host of a
    block rule bound to other paths, is a good outcome. Verdicts without a rule come from the host's reputation. A NULL url, or one without `://`, has empty host and path, and all of those share one
    reputation. Equal urls get equal verdicts; an empty table stays empty.
    """
    own = pages.drop("host", "path", "rule", "verdict").withColumn("host", host_of(F.col(url_col))).withColumn(
        "path", path_of(F.col(url_col)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumn("rule", rule).withColumn("__llm_verdict", verdict)
    bad = F.when(F.col("__llm_verdict").isNotNull(), (F.col("__llm_verdict") == BLOCK).cast("int")).when(
        left_alone(F.col("host"), F.col("path"), rules), 0)
    known = reputation(own.select("host", bad.alias("bad")))
    known = written(known.select(F.col("host").alias("__llm_host"), (lower_bound(z) > threshold).alias("__llm_bad")), "reputation")
    return own.join(known, own["host"] == known["__llm_host"], "left").withColumn(
        "verdict", F.coalesce("__llm_verdict", F.when(F.col("__llm_bad"), BLOCK).otherwise(ALLOW))
    ).drop("__llm_host", "__llm_bad", "__llm_verdict")


ship(__name__)
