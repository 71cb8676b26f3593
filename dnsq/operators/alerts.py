"""Scored rows to alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import ISO_MICROS
from .delays import with_alert_delays

# Default thresholds and the classes that mean an attack, in order of preference.
DGA_THRESHOLD = 0.95
TYPO_THRESHOLD = 0.98
TUNNEL_THRESHOLD = 0.5
ATTACK_CLASSES_LIVE = ["malicious", "attack", "dns_tunneling", "tunnel"]
ATTACK_CLASSES_BATCH = ["malicious", "attack", "tunnel", "dns_tunneling"]


def _iso(t: Column) -> Column:
    return F.date_format(t.cast("timestamp"), ISO_MICROS)


def _timed(hits: DataFrame) -> DataFrame:
    """Times `_logged`, `_row_seen`, `_detected` to the text columns and delays of an alert."""
    return with_alert_delays(hits.withColumns({
        "unbound_logged_at": _iso(F.col("_logged")),
        "flow_row_seen_at": _iso(F.col("_row_seen")),
        "detected_at": _iso(F.col("_detected")),
    })).drop("_logged", "_row_seen", "_detected")


def _query_alerts(hits: DataFrame) -> DataFrame:
    return _timed(hits.withColumn("_row_seen", F.lit(None).cast("timestamp"))).drop(
        "flow_row_seen_at", "pipeline_stage_delays")


def dga_alerts(scored: DataFrame, detected_at: Column, threshold: float = DGA_THRESHOLD) -> DataFrame:
    """Rows (`qname`, `logged_at`, `scores`) whose `dga` score reaches the threshold."""
    score = F.coalesce(F.col("scores")["dga"], F.lit(0.0))
    return _query_alerts(scored.filter(score >= threshold).select(
        F.lit("DGA").alias("detector"), F.col("qname").alias("domain"), F.round(score, 4).alias("score"),
        "scores", F.col("logged_at").alias("_logged"), detected_at.alias("_detected")))


def typo_alerts(matched: DataFrame, detected_at: Column, threshold: float = TYPO_THRESHOLD) -> DataFrame:
    """Rows (`qname`, `logged_at`, best match) whose score reaches the threshold.

    A protected name itself is not exempt.
    """
    return _query_alerts(matched.filter((F.col("score") >= threshold) & F.col("target").isNotNull()).select(
        F.lit("TYPOSQUATTING").alias("detector"), F.col("qname").alias("domain"),
        F.round("score", 4).alias("score"), "target", "predicted_class",
        F.col("logged_at").alias("_logged"), detected_at.alias("_detected")))


def tunnel_alerts(scored: DataFrame, detected_at: Column, row_seen_at: Column,
                  threshold: float = TUNNEL_THRESHOLD, missing: list[str] | None = None,
                  hard_labels: bool = False) -> DataFrame:
    """Scored flows (`row_index`, endpoints, `dns_domain_name`, `malicious_score`) to alerts.

    The resolver's time is used when the flow has one, else the time of the flow. Alerts of a
    model without probabilities (`hard_labels`) also carry the label.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in scored.columns else F.lit("")

    times = [F.col(c).cast("timestamp") for c in ("unbound_logged_at", "timestamp") if c in scored.columns]
    logged = F.coalesce(*times) if times else F.lit(None).cast("timestamp")
    return _timed(scored.filter(F.col("malicious_score") >= threshold).select(
        F.lit("DNS_TUNNELING").alias("detector"), "row_index", F.round("malicious_score", 4).alias("score"),
        *([F.col("predicted_label").alias("label")] if hard_labels else []),
        *[text(c).alias(c) for c in ("src_ip", "dst_ip", "dns_domain_name")],
        F.lit(missing or []).cast("array<string>").alias("missing_feature_columns"),
        logged.alias("_logged"), row_seen_at.alias("_row_seen"), detected_at.alias("_detected")))


def tunnel_findings(scored: DataFrame, threshold: float = TUNNEL_THRESHOLD) -> DataFrame:
    """Rows that a batch run reports: `row_index`, label, score to six places and endpoints. A text
    column that the table lacks, or a NULL in it, is an empty text."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in scored.columns else F.lit("")

    return scored.filter(F.col("malicious_score") >= threshold).select(
        "row_index", "predicted_label", F.round("malicious_score", 6).alias("malicious_score"),
        *[text(c).alias(c) for c in ("dns_domain_name", "src_ip", "dst_ip")])


def row_index(flows: DataFrame) -> Column:
    """What an alert calls its flow: the table's own `row_index`, else `flow_uid` (a text over several packet
    files), else a hash of its id."""
    for c in ("row_index", "flow_uid"):
        if c in flows.columns:
            return F.col(c)
    return F.xxhash64("flow_id")


def attack_class(labels: list[str], batch: bool = False) -> int | None:
    """Position of the class that means an attack: a known name, else the second of two, else none."""
    lowered = {str(name).lower(): i for i, name in enumerate(labels)}
    for name in ATTACK_CLASSES_BATCH if batch else ATTACK_CLASSES_LIVE:
        if name in lowered:
            return lowered[name]
    return 1 if len(labels) == 2 else None


def hard_label_score(label: Column) -> Column:
    """Score of a model without probabilities: 1 for an attack label."""
    return F.when(F.lower(label).isin(ATTACK_CLASSES_LIVE), 1.0).otherwise(0.0)
