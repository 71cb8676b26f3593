"""Readers. Each gives a lazily evaluated DataFrame, so filters and column choices reach the scan."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.datasets import stack
from ..operators.flows import keep_transport_packets
from ..session import attach, cut_lineage
from . import schemas


# Files number their packets from 0 each; up to this many packets a file, numbers over several files are unique.
FILE_PACKETS = 1 << 40


def number_over_files(packets: DataFrame, file: str = "_file") -> DataFrame:
    """Packet numbers that are unique over all files: those of the n-th file (by name, n from 0) start at n * FILE_PACKETS.

    The first file keeps its numbers, and order within a file stays. The list of files has one row per file, and only file
    names are read for it. The column `file` is dropped.
    """
    order = Window.orderBy(file)  # a row per file
    files = packets.select(file).distinct().withColumn("_rank", F.row_number().over(order) - 1)
    return attach(packets, cut_lineage(files), [file]).withColumn(
        "pkt_no", F.col("_rank") * FILE_PACKETS + F.col("pkt_no")).drop(file, "_rank")


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packet files; IPv4 over TCP or UDP only (the filter is pushed into the scan). Several files may number
    their packets alike: see `number_over_files`."""
    rows = spark.read.schema(schemas.PACKET).parquet(path)
    if len(rows.inputFiles()) < 2:
        return keep_transport_packets(rows)
    return keep_transport_packets(number_over_files(rows.select("*", F.col("_metadata.file_path").alias("_file")))).select(
        *schemas.PACKET.fieldNames())


def decoded(lines: DataFrame) -> DataFrame:
    """Lines (`value`) without the bytes that are no UTF-8 text; the bytes around them stay together."""
    kept = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    return lines.withColumn("value", F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(kept))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines; broken bytes are dropped."""
    return decoded(spark.read.text(path))


def read_flow_table(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """Flow CSV with a header. A missing path gives an empty table."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if columns:
        reader = reader.schema(schemas.flow_table_schema(columns))
    try:
        return reader.csv(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schemas.flow_table_schema(columns or ["flow_id"]))


def parse_alerts(lines: DataFrame) -> DataFrame:
    """JSON lines (`value`) to alerts; blank and broken lines are dropped."""
    schema = T.StructType([*schemas.ALERT.fields, T.StructField("_broken", T.StringType())])
    parsed = lines.filter(F.trim("value") != "").select(F.from_json(
        "value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("a"))
    return parsed.filter(F.col("a").isNotNull() & F.col("a._broken").isNull()).select("a.*").drop("_broken")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return parse_alerts(spark.read.text(path))


def clean_domain_list(lines: DataFrame) -> DataFrame:
    return lines.select(F.lower(F.trim("value")).alias("domain")).filter(F.col("domain") != "")


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    """One domain per line; an empty list is an error."""
    domains = clean_domain_list(spark.read.text(path))
    if domains.isEmpty():
        raise ValueError(f"no domains in {path}")
    return domains


def read_protected_list(spark: SparkSession, path: str) -> DataFrame:
    """A domain list with its 0-based line order as `position`.

    Lines are numbered within each block of a file; the blocks' sizes, one row per block, give
    the offsets.
    """
    block = ["file", "start"]
    lines = spark.read.text(path).select(
        F.lower(F.trim("value")).alias("domain"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"),
    ).filter(F.col("domain") != "")
    blocks = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(
        F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*block).orderBy("line")) - 1
    named = lines.withColumn("place", place).join(blocks, block).select(
        "domain", (F.col("before") + F.col("place")).alias("position"))
    if named.isEmpty():
        raise ValueError(f"no domains in {path}")
    return named


def read_ranked_list(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """`rank,domain` without header, lower case, in rank order, the first N when asked for."""
    ranked = spark.read.schema(schemas.RANKED_DOMAIN).csv(path).select("rank", F.lower("domain").alias("domain"))
    ordered = ranked.orderBy("rank")
    return ordered.limit(first) if first else ordered


def read_labelled_domains(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABELLED_DOMAIN).option("header", True).csv(path)


def read_labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABELLED_PAIR).option("header", True).csv(path)


def read_flow_dataset(spark: SparkSession, benign: str, malicious: str) -> DataFrame:
    """One benign file and a glob of malicious ones, put together by column name."""
    read = spark.read.option("header", True)
    return stack([read.csv(benign), read.csv(malicious)])


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


# Streams. The directories hold finished files, moved in atomically.

def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 200) -> DataFrame:
    return decoded(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def stream_packets(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return keep_transport_packets(
        spark.readStream.schema(schemas.PACKET).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def stream_flow_table(spark: SparkSession, path: str, columns: list[str], files_per_trigger: int = 64) -> DataFrame:
    return (
        spark.readStream.schema(schemas.flow_table_schema(columns)).option("header", True)
        .option("maxFilesPerTrigger", files_per_trigger).csv(path))
