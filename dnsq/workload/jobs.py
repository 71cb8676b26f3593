"""Registered queries that train models or run streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import datasets as D, domains as DO, flow_features as FF, flows as FL, matching as M, models as MO
from ..plans import training as TR
from ..plans.jobs import dga_detection, flow_feature_table, model_matches
from ..session import cut_lineage, shared_dir
from ..sources import readers
from ..streaming import flows as SF, jobs as SJ
from . import tables as X
from .queries import _rounded


# Models

def _labelled(spark, d):
    return X.labelled_domains(spark, d).select("row_key", F.col("domain").alias("Domain"), "class")


def _dga_metrics(spark, d, name):
    trained = TR.train_dga(_labelled(spark, d), {name: TR.DGA_SPECS[name]}, folds=0)
    return _rounded(trained.reports["test_metrics"], 6)


def train_lr(spark, d):
    return _dga_metrics(spark, d, "Logistic Regression")


def train_rf(spark, d):
    return _dga_metrics(spark, d, "Random Forest")


def train_gbt(spark, d):
    return _dga_metrics(spark, d, "Gradient Boosting")


def train_overfitting(spark, d):
    """Train, test and cross-validated metrics of a fitted model."""
    trained = TR.train_dga(_labelled(spark, d), {"Logistic Regression": {"kind": "lr"}}, folds=5)
    return _rounded(trained.reports["overfitting"], 6)


def _labelled_pairs(spark, d):
    hosts = X.domains(spark, d)
    variants = D.typo_variants(hosts)
    rows = variants.unionByName(D.negative_samples(hosts, hosts, variants, 40, 42))
    return rows.withColumn("row_key", F.concat_ws("|", "target_domain", "query_domain"))


def train_balanced_rf(spark, d):
    """Classification report of the balanced pair model on the held-out pairs."""
    return _rounded(TR.train_pairs(_labelled_pairs(spark, d), trees=100).reports["report"], 6)


def train_pairs_binary(spark, d):
    pairs = _labelled_pairs(spark, d).withColumn(
        "classification", F.when(F.col("classification") == "none", "none").otherwise("typo"))
    return _rounded(TR.train_pairs(pairs, binary=True, trees=100, limit=100_000).reports["report"], 6)


def _flow_table(spark, d):
    """Flow features labelled by size: a rule that a model can learn."""
    flows = flow_feature_table(X.packets(spark, d), X.LIMITS, allow=[
        "src_ip", "dst_ip", "timestamp", "protocol", *FF.count_names(), "dns_domain_name", "ttl_values_max",
        "min_packets_len", "max_packets_len", "mean_packets_len"])
    label = F.when(F.col("total_bytes") > 400, "Malicious").otherwise("Benign")
    return flows.withColumn("label", label).withColumn("row_key", F.col("flow_uid"))


def train_tunnel(spark, d):
    specs = {"Random Forest": TR.TUNNEL_SPECS["Random Forest"]}
    return _rounded(TR.train_tunnel(_flow_table(spark, d), specs).reports["auc"], 6)


def feature_importance(spark, d):
    specs = {"Random Forest": TR.TUNNEL_SPECS["Random Forest"]}
    return _rounded(TR.train_tunnel(_flow_table(spark, d), specs).reports["importance"], 6)


def dga_model_alerts(spark, d):
    """Alerts of a fitted model over log lines that query every labelled name."""
    specs = {"Random Forest": TR.DGA_SPECS["Random Forest"]}
    bundle = TR.train_dga(_labelled(spark, d), specs, folds=0).bundles["Random Forest"]
    lines = X.labelled_domains(spark, d).select(F.concat(
        F.lit("[1704067200] unbound[7:0] info: 10.0.0.1 "), "domain", F.lit(". A IN")).alias("value"))
    hits = dga_detection(lines, bundle, F.col("logged_at"), threshold=0.9)
    return hits.select("detector", "domain", "score", "unbound_logged_at", "detection_delay_seconds")


def typo_model_matches(spark, d):
    """Best protected name by a fitted pair model, among the fifty most similar names."""
    bundle = TR.train_pairs(_labelled_pairs(spark, d), trees=100).bundles["Random Forest"]
    return model_matches(X.queried_names(spark, d), X.protected(spark, d), bundle, 50)


# Streams, run to the end of what is there

def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _event_files(spark, d, where: str, files: int = 5) -> DataFrame:
    """The events table as a stream of some files in time order, one per micro-batch."""
    table = X.table(spark, d, "events")
    table.repartitionByRange(files, "ts").write.parquet(f"{where}/in")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")


def _event_files_in_order(spark, d, where: str, files: int = 5, rows: int = 5_000_000) -> DataFrame:
    """`_event_files` written one after the other: a stream takes files by their times of writing. More rows, more files."""
    table = X.table(spark, d, "events").withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    files = max(files, table.count() // rows)
    cuts = table.approxQuantile("_at", [i / files for i in range(1, files)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = table if low is None else table.filter(F.col("_at") > int(low))
        part = part if high is None else part.filter(F.col("_at") <= int(high))
        part.drop("_at").coalesce(1).write.mode("append").parquet(f"{where}/in")
    return spark.readStream.schema(table.drop("_at").schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")


def stream_delays(spark, d):
    """Delays of detected names from a log stream and an alert stream of several micro-batches."""
    where = _place(spark, "delays")
    source = _event_files(spark, d, where)
    seen = X.log_lines(spark, d, source)
    alerts = X.alerts(spark, d, X.events(spark, d, True, source))
    for name, rows, handle in (("seen", seen, SJ.seen_handler), ("detected", alerts, SJ.detected_handler)):
        SJ.start(rows, handle, f"{where}/{name}", f"{where}/{name}-checkpoint", None, "parquet").awaitTermination()
    rows = SJ.delays_so_far(spark.read.parquet(f"{where}/seen"), spark.read.parquet(f"{where}/detected"))
    return rows.select("domain", F.unix_micros("first_seen_at").alias("seen_us"),
                       F.unix_micros("first_detected_at").alias("detected_us"),
                       F.round("first_seen_to_detected_seconds", 6).alias("delay"))


def stream_log_alerts(spark, d):
    """Log lines as a stream of several micro-batches, each matched against the protected names."""
    where = _place(spark, "log-alerts")
    lines = X.log_lines(spark, d, _event_files(spark, d, where))
    protected = cut_lineage(X.protected(spark, d))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def handle(batch):
        # A file is read by few tasks; its lines are parsed by all of them, and once.
        q = cut_lineage(DO.parse_queries(batch.repartition(tasks)))
        best = M.best_match(q, protected, least=0.79)
        hits = best.withColumn("score", F.round("score", 9)).filter("score >= 0.8")
        return MO.join_hits(q, hits).select(
            F.col("qname").alias("domain"), F.round("score", 4).alias("score"), "target", "predicted_class",
            F.unix_micros("logged_at").alias("logged_us"))

    SJ.start(lines, handle, f"{where}/out", f"{where}/checkpoint", None, "parquet").awaitTermination()
    return spark.read.parquet(f"{where}/out").drop("batch")


def stream_flows(spark, d):
    """Flows closed by later packets, by the watermark or by the end of the input, over several micro-batches of packets."""
    where = _place(spark, "flows")
    packets = X.packets(spark, d, sections=False, ev=X.events(spark, d, False, _event_files_in_order(spark, d, where)))
    SF.stream_flows(packets, where, f"{where}/checkpoint", X.LIMITS, 3600, None).awaitTermination()
    closed = spark.read.schema(SF.FLOW_ROWS).parquet(f"{where}/flows/batch=*")
    rows = closed.unionByName(SF.open_flows(spark, where, X.LIMITS))
    return rows.select("flow_uid", "start_us", "end_us", "packets", "bytes", "closed_by")


def stream_flow_scores(spark, d):
    """A stream of flow rows scored and filtered; the flow table is first written in files."""
    where = _place(spark, "flow-scores")
    assigned = FL.assign_flows(X.packets(spark, d, sections=False), X.LIMITS)
    flows = FF.packet_features(assigned, ["packets_numbers", "total_bytes"])
    flows.write.option("header", True).csv(f"{where}/in")
    rows = readers.stream_flow_table(spark, f"{where}/in", ["flow_uid", "packets_numbers", "total_bytes"])

    def handle(batch):
        x = {c: MO.numeric(batch, c) for c in ("packets_numbers", "total_bytes", "not_in_table")}
        s = F.round(F.least(F.lit(1.0), x["packets_numbers"] * 0.05 + x["total_bytes"] * 0.0001 + x["not_in_table"]), 9)
        return batch.select(F.col("flow_uid").cast("bigint").alias("row_index"), F.round(s, 4).alias("score")).filter(s >= 0.5)

    SJ.start(rows, handle, f"{where}/out", f"{where}/checkpoint", None, "parquet").awaitTermination()
    return spark.read.schema("row_index bigint, score double").parquet(f"{where}/out").select("row_index", "score")


def _packet_files(spark, d, where: str, files: int = 5, sections: bool = False) -> DataFrame:
    """The packets written as some files (one per `chunk`), each numbered from 0. Returns the rows as written.

    A file is written by a task of its own, in row groups that several tasks can read."""
    rows = X.packets(spark, d, sections=sections).withColumn("chunk", F.concat(F.lit("file"), F.col("pkt_no") % files)).withColumn(
        "pkt_no", F.expr(f"pkt_no div {files}"))
    dealt = rows.repartitionById(files, F.substring_index("chunk", "file", -1).cast("int"))
    dealt.write.partitionBy("chunk").option("parquet.block.size", 8 << 20).parquet(f"{where}/in")
    return rows


def stream_chunks(spark, d):
    """A stream of packet files numbered alike, one per micro-batch; no flow crosses a file, rows are appended to one table."""
    where = _place(spark, "chunks")
    schema = _packet_files(spark, d, where).schema
    packets = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    handle = SJ.chunk_handler(lambda a: a.groupBy("flow_uid").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes")), X.LIMITS)
    SJ.start(packets, handle, f"{where}/out", f"{where}/checkpoint", None, "parquet").awaitTermination()
    return spark.read.parquet(f"{where}/out").drop("batch")


def packet_files(spark, d):
    """Flows over all packet files read at once; the files number their packets alike, and flows cross them."""
    where = _place(spark, "packet-files")
    _packet_files(spark, d, where)
    assigned = FL.assign_flows(readers.read_packets(spark, f"{where}/in"), X.LIMITS)
    return assigned.groupBy("flow_uid").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes"), F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us")).drop("flow_uid")


def idle_sessions(spark, d):
    """Flows by idle gap alone, with built-in session windows."""
    s = SF.idle_sessions(X.packets(spark, d, sections=False), X.IDLE_ONLY)
    return s.select("flow_key", "start_us", "end_us", "packets", "bytes")


JOBS = {f.__name__: f for f in (
    train_lr, train_rf, train_gbt, train_overfitting, train_balanced_rf, train_pairs_binary, train_tunnel,
    feature_importance, dga_model_alerts, typo_model_matches, stream_delays, stream_log_alerts, stream_flows,
    stream_flow_scores, stream_chunks, packet_files, idle_sessions,
)}
