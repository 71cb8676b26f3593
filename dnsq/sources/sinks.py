"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.enrich import WHOIS_COLUMNS
from ..operators.flow_features import dns_column_names

MAX_ROWS = 900_000
# The texts of established tables.
NOT_DNS = "not a dns flow"
NO_REGISTRATION = "No information found"


def select_columns(df: DataFrame, reference: list[str] | None = None, allow: list[str] | None = None,
                   ignore: list[str] | None = None) -> DataFrame:
    """Column choice of a table: the order of a reference header, an allow list, an ignore list.

    A column of the reference that the table lacks is empty.
    """
    names = reference or df.columns
    if allow is not None:
        names = [n for n in names if n in allow]
    names = [n for n in names if n not in set(ignore or [])]
    have = set(df.columns)
    return df.select(*[F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names])


def header_of(spark, path: str) -> list[str]:
    """Column order of an existing CSV file."""
    return spark.read.option("header", True).csv(path).columns


def as_csv_rows(flows: DataFrame, places: int | None = None) -> DataFrame:
    """Flow features as text: numbers with fixed places, lists and maps as JSON, DNS columns of
    other flows, missing registration data and missing handshakes with their established texts."""
    dns = {*dns_column_names(), *WHOIS_COLUMNS}
    out = []
    for field in flows.schema.fields:
        col = F.col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            col = F.to_json(col)
        elif isinstance(field.dataType, T.DoubleType) and places is not None:
            col = F.when(col.isNotNull(), F.format_string(f"%.{places}f", col))
        col = col.cast("string")
        if field.name in WHOIS_COLUMNS:
            col = F.coalesce(col, F.lit(NO_REGISTRATION))
        if field.name in dns and "protocol" in flows.columns:
            col = F.when(F.col("protocol") != "DNS", NOT_DNS).otherwise(col)
        if field.name in ("handshake_duration", "delta_start") and "handshake_status" in flows.columns:
            col = F.coalesce(col, F.col("handshake_status"))
        out.append(col.alias(field.name))
    return flows.select(*out)


def write_flow_csv(flows: DataFrame, path: str, places: int | None = None, max_rows: int = MAX_ROWS) -> None:
    """CSV files with a header of at most `max_rows` rows each."""
    as_csv_rows(flows, places).write.mode("overwrite").option("maxRecordsPerFile", max_rows).csv(path, header=True)


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Append alerts as JSON lines."""
    alerts.write.mode("append").json(path)


def write_domain_list(top: DataFrame, path: str) -> None:
    """Domains only, one per line, in order. For a top-N report, which is small."""
    top.select("domain").coalesce(1).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as CSV."""
    report.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_scored(scored: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Input columns with `predicted_label` and `malicious_score`."""
    writer = scored.write.mode("overwrite")
    if fmt == "csv":
        as_csv_rows(scored).write.mode("overwrite").csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Append finished rows to a live table."""
    rows.write.mode("append").parquet(path)
