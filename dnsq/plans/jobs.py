"""Batch jobs: reports, detection and data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical, pairs
from ..operators import (
    alerts as A, datasets as D, delays as DL, domains as DO, flow_features as FF, matching as M, models as MO,
)
from ..operators.flows import FlowLimits, assign_flows, keep_transport_packets
from ..session import cut_lineage


def flow_feature_table(packets: DataFrame, limits: FlowLimits = FlowLimits(), **options) -> DataFrame:
    """Packets to the wide feature table. `options` are those of `flow_features`.

    The assignment feeds several aggregations, so it is computed once and kept.
    """
    assigned = cut_lineage(assign_flows(keep_transport_packets(packets), limits))
    return FF.flow_features(assigned, **options)


def domain_report(lines: DataFrame, base: bool = False, min_count: int = 1, top: int | None = 100) -> DataFrame:
    """Query log to the most frequent names."""
    return DO.top_domains(DO.domain_counts(DO.parse_queries(lines, need_client=False), base, min_count), top)


def dga_detection(lines: DataFrame, bundle: MO.Bundle, detected_at: Column | None = None,
                  threshold: float = A.DGA_THRESHOLD) -> DataFrame:
    """Query log to alerts on generated names; a name is scored once however often it is queried."""
    queries = DO.parse_queries(lines)
    hits = MO.score_names(queries, bundle, lexical.dga_features).filter(F.col("scores")["dga"] >= threshold)
    at = F.current_timestamp() if detected_at is None else detected_at
    return A.dga_alerts(MO.join_hits(queries, hits), at, threshold)


def model_matches(queries: DataFrame, protected: DataFrame, bundle: MO.Bundle, top_n: int | None = None) -> DataFrame:
    """Best protected name per query by the pair model: all names of the list, or the `top_n` most
    similar ones of a longer list."""
    n = top_n or protected.count()
    candidates = M.top_candidates(queries, protected, n)
    if top_n is None:
        candidates = candidates.withColumn("cand_no", F.col("position") + 1)  # ties keep list order
    featured = candidates.withColumns(pairs.pair_features(F.col("target"), F.col("qname")))
    return M.best_scored(MO.score(featured, bundle).select("qname", "target", "cand_no", "scores"))


def typo_detection(lines: DataFrame, protected: DataFrame, bundle: MO.Bundle | None = None, top_n: int | None = None,
                   detected_at: Column | None = None, threshold: float = A.TYPO_THRESHOLD) -> DataFrame:
    """Query log to alerts on look-alike names."""
    queries = DO.parse_queries(lines)
    best = model_matches(queries, protected, bundle, top_n) if bundle else M.best_match(
        queries, protected, least=threshold)
    at = F.current_timestamp() if detected_at is None else detected_at
    return A.typo_alerts(MO.join_hits(queries, best.filter(F.col("score") >= threshold)), at, threshold)


def tunnel_scoring(flows: DataFrame, bundle: MO.Bundle, threshold: float = A.TUNNEL_THRESHOLD) -> dict:
    """Flow table to the scored table, its alert rows, its summary row and the names of missing model columns."""
    scored = MO.score_flows(flows, bundle)
    return {
        "scored": scored,
        "alerts": A.tunnel_findings(scored.withColumn("row_index", A.row_index(flows)), threshold),
        "summary": MO.score_summary(scored, threshold),
        "missing_feature_columns": MO.missing_columns(bundle.feature_columns, flows.columns),
    }


def delay_report(lines: DataFrame, alerts: DataFrame, top: int = 20) -> dict[str, DataFrame]:
    """Query log and alert log to the delay tables."""
    seen, detected = DL.first_seen(DO.parse_queries(lines)), DL.first_detected(alerts)
    rows = DL.delay_rows(seen, detected)
    return {
        "log_totals": DL.log_totals(lines),
        "overlap": DL.overlap(seen, detected),
        "rows": rows,
        "summary": DL.delay_summary(rows),
        "slowest": DL.slowest(rows, top),
    }


def dga_dataset(labelled: DataFrame) -> DataFrame:
    """`Domain`, `class` to the features and `domain_class` (when there is a class)."""
    extra = [F.col("class").alias("domain_class")] if "class" in labelled.columns else []
    return labelled.select("Domain", *[c.alias(k) for k, c in lexical.dga_features(F.col("Domain")).items()], *extra)


def typo_dataset(ranked: DataFrame, targets: int = 1000, per_target: int = 40, homoglyph_cap: int | None = 40_000,
                 seed: int = 42) -> DataFrame:
    """Ranked domains to labelled pairs: variants of the first `targets`, negatives from all.

    A negative that is also a variant of its target keeps the variant's class.
    """
    first = ranked.orderBy("rank").limit(targets).select("domain")
    variants = D.typo_variants(first)
    rows = variants.unionByName(D.negative_samples(first, ranked.select("domain"), variants, per_target, seed))
    if homoglyph_cap is None:
        return rows
    keyed = rows.withColumn("_key", F.concat_ws("|", "target_domain", "query_domain"))
    return D.class_downsample(keyed, "classification", "_key", "homoglyph", homoglyph_cap, seed).drop("_key")


def pair_model_rows(labelled: DataFrame, binary: bool = False) -> DataFrame:
    """Labelled pairs to the model's input columns; names in lower case, known classes only."""
    t, q = F.col("target_domain"), F.col("query_domain")
    if binary:
        return labelled.withColumns(pairs.binary_pair_features(t, q))
    return D.keep_classes(D.fold_case(labelled)).withColumns(pairs.pair_features(t, q))
