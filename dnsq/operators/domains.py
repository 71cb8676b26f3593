"""Query logs to queries, and reports over domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import logs as L


def parse_queries(lines: DataFrame, need_client: bool = True) -> DataFrame:
    """Log lines (`value`) to `client`, `qname`, `logged_at`, `value`; other lines are dropped."""
    fields = F.struct(
        L.client(F.col("value")).alias("client"),
        L.qname(F.col("value")).alias("qname"),
        L.log_time(F.col("value")).alias("logged_at"),
        F.col("value"),
    )

    def kept(q):
        return q["qname"].isNotNull() & q["client"].isNotNull() if need_client else q["qname"].isNotNull()

    # Filtering inside a one-element array instead of after the projection keeps the optimizer from
    # evaluating the expressions twice, once for the filter and once for the columns.
    return lines.select(F.inline(F.filter(F.array(fields), kept)))


def domain_counts(queries: DataFrame, base: bool = False, min_count: int = 1) -> DataFrame:
    """Queries per name, or per base domain, from `min_count` on."""
    name = L.base_domain(F.col("qname")) if base else F.col("qname")
    return (
        queries.groupBy(name.alias("domain")).agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count))


def top_domains(counts: DataFrame, n: int | None = 100) -> DataFrame:
    """The n most frequent, by name on equal counts; all of them when n is None or not positive."""
    ordered = counts.orderBy(F.desc("n"), "domain")
    return ordered.limit(n) if n and n > 0 else ordered


def distinct_first(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key with its first position."""
    return rows.groupBy(key).agg(F.min(position).alias(position))
