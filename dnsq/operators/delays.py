"""First seen, first detected and the delay between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import logs as L
from ..functions.times import delay_seconds, normalise_time, parse_time, stage_delays
from .ranking import pick_ranks

# Percentiles of the delay report.
PERCENTILES = {"min": 0.0, "p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99, "max": 1.0}


def first_seen(queries: DataFrame) -> DataFrame:
    """Earliest log time per name; lines without a time do not count."""
    return (
        queries.filter(F.col("logged_at").isNotNull())
        .groupBy(F.col("qname").alias("domain"))
        .agg(F.min("logged_at").alias("first_seen_at"), F.count(F.lit(1)).alias("queries")))


def log_totals(lines: DataFrame) -> DataFrame:
    """Lines in all, and lines that are a query with a time."""
    v = F.col("value")
    good = L.client(v).isNotNull() & L.qname(v).isNotNull() & L.log_epoch(v).isNotNull()
    return lines.agg(F.count(F.lit(1)).alias("lines_total"), F.count_if(good).alias("queries_with_time"))


def tunnel_alert_times(alerts: DataFrame) -> DataFrame:
    """Tunnelling alerts with a name and a readable time: `domain`, `detected_at`."""
    return alerts.filter(F.upper("detector") == "DNS_TUNNELING").select(
        L.normalise_domain(F.col("dns_domain_name")).alias("domain"),
        parse_time(F.col("detected_at").cast("string")).alias("detected_at"),
    ).filter((F.col("domain") != "") & F.col("detected_at").isNotNull())


def first_detected(alerts: DataFrame) -> DataFrame:
    return tunnel_alert_times(alerts).groupBy("domain").agg(
        F.min("detected_at").alias("first_detected_at"), F.count(F.lit(1)).alias("alerts"))


def delay_rows(seen: DataFrame, detected: DataFrame) -> DataFrame:
    """Names on both sides whose delay is not negative."""
    delay = delay_seconds(F.col("first_seen_at"), F.col("first_detected_at"))
    return (
        seen.select("domain", "first_seen_at")
        .join(detected.select("domain", "first_detected_at"), "domain")
        .withColumn("first_seen_to_detected_seconds", delay)
        .filter(F.col("first_seen_to_detected_seconds").isNotNull()))


def delay_summary(rows: DataFrame) -> DataFrame:
    """One row: number of names and the order statistics of the delay in seconds."""
    micros = rows.select(
        F.round(F.col("first_seen_to_detected_seconds") * 1_000_000).cast("bigint").alias("us"))
    picks = pick_ranks(micros, "us", PERCENTILES)
    return picks.agg(
        F.max("n").alias("domains_with_valid_delay"),
        *[F.max(F.when(F.col("name") == k, F.col("value") / 1_000_000)).alias(k) for k in PERCENTILES])


def slowest(rows: DataFrame, n: int = 20) -> DataFrame:
    """The n longest delays, by name on equal delays."""
    return rows.orderBy(F.desc("first_seen_to_detected_seconds"), "domain").limit(n)


def overlap(seen: DataFrame, detected: DataFrame) -> DataFrame:
    """Names seen, names detected and names on both sides, in one pass over the two key sets."""
    sides = seen.select("domain", F.lit(1).alias("s"), F.lit(0).alias("d")).unionByName(
        detected.select("domain", F.lit(0).alias("s"), F.lit(1).alias("d")))
    return (
        sides.groupBy("domain").agg(F.max("s").alias("s"), F.max("d").alias("d"))
        .agg(F.coalesce(F.sum("s"), F.lit(0)).alias("domains_seen"),
             F.coalesce(F.sum("d"), F.lit(0)).alias("domains_detected"),
             F.count_if((F.col("s") == 1) & (F.col("d") == 1)).alias("domains_overlap")))


def with_alert_delays(alerts: DataFrame) -> DataFrame:
    """Normalised times, `detection_delay_seconds` and `pipeline_stage_delays` of alert rows.

    The three time columns are texts, as alerts hold them. A text that is no time stays as it is
    and gives no delay.
    """
    times = ["unbound_logged_at", "flow_row_seen_at", "detected_at"]
    parsed = {c: parse_time(F.col(c)) for c in times}
    logged, row_seen, detected = (parsed[c] for c in times)
    return alerts.withColumns({
        **{c: normalise_time(F.col(c)) for c in times},
        "detection_delay_seconds": delay_seconds(logged, detected),
        "pipeline_stage_delays": stage_delays(logged, row_seen, detected),
    })
