"""Schemas of the inputs and outputs."""

from __future__ import annotations

from pyspark.sql import types as T

PACKET = T.StructType([
    T.StructField("pkt_no", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("ip_version", T.IntegerType()),
    T.StructField("transport", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("len", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ack", T.LongType()),
    T.StructField("txid", T.IntegerType()),
    T.StructField("qnames", T.ArrayType(T.StringType())),
    T.StructField("answers", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("ttl", T.LongType()),
        T.StructField("type", T.IntegerType()), T.StructField("cls", T.IntegerType())]))),
    T.StructField("additionals", T.ArrayType(T.StructType([
        T.StructField("type", T.IntegerType()), T.StructField("cls", T.IntegerType())]))),
    T.StructField("ancount", T.IntegerType()),
    T.StructField("nscount", T.IntegerType()),
    T.StructField("arcount", T.IntegerType()),
])

ALERT = T.StructType([
    T.StructField("detector", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("target", T.StringType()),
    T.StructField("predicted_class", T.StringType()),
    T.StructField("row_index", T.StringType()),  # a number, or file:number over several packet files
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dns_domain_name", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("unbound_logged_at", T.StringType()),
    T.StructField("flow_row_seen_at", T.StringType()),
    T.StructField("detected_at", T.StringType()),
    T.StructField("detection_delay_seconds", T.DoubleType()),
    T.StructField("pipeline_stage_delays", T.StructType([
        T.StructField("source_to_row_seen_seconds", T.DoubleType()),
        T.StructField("row_seen_to_detected_seconds", T.DoubleType()),
        T.StructField("source_to_detected_seconds", T.DoubleType())])),
    T.StructField("missing_feature_columns", T.ArrayType(T.StringType())),
])

LABELLED_DOMAIN = T.StructType([
    T.StructField("Domain", T.StringType()), T.StructField("class", T.StringType())])

LABELLED_PAIR = T.StructType([
    T.StructField("target_domain", T.StringType()), T.StructField("query_domain", T.StringType()),
    T.StructField("classification", T.StringType())])

RANKED_DOMAIN = T.StructType([T.StructField("rank", T.LongType()), T.StructField("domain", T.StringType())])


def flow_table_schema(columns: list[str]) -> T.StructType:
    """A flow table read from CSV: every column as text, coerced where a model needs numbers."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
