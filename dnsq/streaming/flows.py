"""Flows over a packet stream, with state kept across files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.flows import ORIGIN, FlowLimits, _keyed, assign_keyed
from ..session import cut_lineage

FLOW_ROWS = ("flow_key string, flow_uid bigint, start_us bigint, end_us bigint, packets bigint, bytes bigint, "
             "src_ip string, dst_ip string, src_port int, dst_port int, protocol string, closed_by string")
# Packets as they wait for the watermark, and flows that are still open: totals, last packet, closing flags.
_ENDS = "src_ip string, src_port int, dst_ip string, dst_port int, txid bigint, protocol string, idle_us bigint"
_WAITING = f"flow_key string, ts_us bigint, pkt_no bigint, bytes bigint, fins bigint, rst boolean, {_ENDS}"
_OPEN = ("flow_key string, flow_uid bigint, start_us bigint, end_us bigint, last_no bigint, packets bigint, bytes bigint, "
         f"fins bigint, rst boolean, {_ENDS}")
_MARK = "batch bigint, watermark_us bigint"
_NEVER = (1 << 63) - 1
_START = -(1 << 62)


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _waiting(packets: DataFrame, limits: FlowLimits) -> DataFrame:
    keyed = _keyed(packets, limits).filter(F.col("ts_us").isNotNull())
    return _shaped(keyed.withColumns({
        "bytes": F.col("len"), "fins": F.col("_fin"), "rst": F.col("_rst"), "idle_us": F.col("_idle_us")}), _WAITING)


def _carried(open_: DataFrame) -> DataFrame:
    """Open flows as the rows that stand for them: their first packet, and their last one with all they have summed up.

    The last one never opens a flow, since no gap is too long for it. Two FINs close a flow as a reset does.
    """
    def row(ts: str, no: str, packets: Column, size: Column, fins: Column, rst: Column, gap: Column) -> Column:
        return F.struct(F.col(ts).alias("ts_us"), F.col(no).alias("pkt_no"), packets.alias("packets"), size.alias("bytes"),
                        fins.alias("_fin"), rst.alias("_rst"), gap.alias("_idle_us"))

    none = F.lit(0).cast("bigint")
    first = row("start_us", "flow_uid", none, none, none, F.lit(False), F.col("idle_us"))
    last = row("end_us", "last_no", F.col("packets"), F.col("bytes"), F.when(F.col("fins") < 2, F.col("fins")).otherwise(0),
               F.col("rst") | (F.col("fins") >= 2), F.lit(_NEVER))
    rows = F.when(F.col("flow_uid") == F.col("last_no"), F.array(last)).otherwise(F.array(first, last))
    return open_.select("flow_key", *[c for c in ORIGIN if c not in ("pkt_no", "ts_us")], "protocol", "idle_us",
                        F.explode(rows).alias("p")).select("*", "p.*").drop("p")


def advance(open_: DataFrame, packets: DataFrame, limits: FlowLimits = FlowLimits()) -> DataFrame:
    """Open flows and the packets after them to flows with `closed_by`, which is NULL for the last flow of a key.

    The packets go through the assignment of batches: spread by (key, slot), slots of busy keys cut up, one summary row a
    slot. An open flow enters as two rows, however long it is. What a key gives back are totals per flow.
    """
    limit_us = int(limits.max_flow_duration * 1_000_000)
    new = packets.withColumns({
        "packets": F.lit(1).cast("bigint"), "_fin": F.col("fins"), "_rst": F.col("rst"), "_idle_us": F.col("idle_us")})
    rows = _carried(open_).unionByName(new.drop("fins", "rst"))
    rows = rows.withColumns({"fins": F.col("_fin"), "rst": F.col("_rst")})
    flows = assign_keyed(rows, limits, True).groupBy("flow_key", "flow_uid").agg(
        F.min("origin").alias("origin"), F.max(F.struct("ts_us", "pkt_no")).alias("last"), F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"), F.sum("fins").alias("fins"), F.max("rst").alias("rst"),
        F.min("protocol").alias("protocol"), F.min("idle_us").alias("idle_us"))
    flows = flows.withColumns({
        "start_us": F.col("origin.ts_us"), "end_us": F.col("last.ts_us"), "last_no": F.col("last.pkt_no"),
        **{c: F.col(f"origin.{c}") for c in ORIGIN if c not in ("pkt_no", "ts_us")}})
    following = F.lead("start_us").over(Window.partitionBy("flow_key").orderBy("start_us", "flow_uid"))
    return flows.withColumn("_next", following).withColumn(
        "closed_by", F.when(F.col("_next") - F.col("end_us") > F.col("idle_us"), "idle")
        .when(F.col("_next") - F.col("start_us") > limit_us, "duration")
        .when(F.col("_next").isNotNull(), "teardown")).drop("_next", "origin", "last")


def _read(spark: SparkSession, state: str, batch_id: int) -> tuple[DataFrame, DataFrame, int]:
    """Open flows, packets that wait and the watermark after micro-batch `batch_id`."""
    if batch_id < 0:
        return spark.createDataFrame([], _OPEN), spark.createDataFrame([], _WAITING), _START
    place = f"{state}/{batch_id % 2}"
    mark = spark.read.schema(_MARK).parquet(f"{place}/mark").first()
    if mark is None or mark["batch"] != batch_id:
        raise RuntimeError(f"{place} does not hold the state after micro-batch {batch_id}")
    waiting = spark.read.schema(_WAITING).parquet(f"{place}/packets").filter(F.col("ts_us") > mark["watermark_us"])
    return spark.read.schema(_OPEN).parquet(f"{place}/open"), waiting, mark["watermark_us"]


def _parted(open_: DataFrame, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open flows of keys that have packets, and the others."""
    keys = packets.select("flow_key").distinct()
    return open_.join(keys, "flow_key", "left_semi"), open_.join(keys, "flow_key", "left_anti")


def flow_step(out: str, limits: FlowLimits = FlowLimits(), late_seconds: float = 10) -> Callable[[DataFrame, int], None]:
    """What `stream_flows` does with a micro-batch and its number."""
    late_us = int(late_seconds * 1_000_000)
    state = f"{out}/state"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = f"{state}/{batch_id % 2}"
        open_, waiting, before = _read(spark, state, batch_id - 1)
        fresh = _waiting(batch, limits).filter(F.col("ts_us") > before)
        waiting.unionByName(fresh).write.mode("overwrite").parquet(f"{place}/packets")
        seen = spark.read.schema(_WAITING).parquet(f"{place}/packets")
        latest = seen.agg(F.max("ts_us")).first()[0]
        mark = before if latest is None else max(before, latest - late_us)
        settled = seen.filter(F.col("ts_us") <= mark)
        touched, rest = _parted(open_, settled)
        flows = advance(touched, settled, limits).unionByName(rest.withColumn("closed_by", F.lit(None).cast("string")))
        over = F.col("end_us") + F.col("idle_us") <= mark
        flows = cut_lineage(flows.withColumn("closed_by", F.coalesce("closed_by", F.when(over, "idle"))))
        _shaped(flows.filter("closed_by is not null"), FLOW_ROWS).write.mode("overwrite").parquet(f"{out}/flows/batch={batch_id}")
        _shaped(flows.filter("closed_by is null"), _OPEN).write.mode("overwrite").parquet(f"{place}/open")
        spark.range(1, numPartitions=1).select(F.lit(batch_id).cast("bigint").alias("batch"), F.lit(mark).cast("bigint").alias(
            "watermark_us")).write.mode("overwrite").parquet(f"{place}/mark")

    return step


def stream_flows(packets: DataFrame, out: str, checkpoint: str, limits: FlowLimits = FlowLimits(),
                 late_seconds: float = 10, interval: str | None = "1 second") -> StreamingQuery:
    """Run a packet stream to flows; those that are finished go to `out`/flows/batch=<id>.

    A packet waits until the watermark (the latest time seen less `late_seconds`) has passed it, so packets are taken in
    their order even where files are not; one that comes behind the watermark is dropped, as is one without a time. A flow
    is finished when the next one of its key begins or the watermark has passed its idle limit. All steps are those of
    batches, so a busy key is spread over tasks.

    Open flows and waiting packets are kept in `out`/state in two folders taken in turns: a micro-batch reads what the one
    before it left and replaces the other folder, so one that runs again gives the same rows. Open flows are written whole
    every time; their number is that of the keys active within the idle limits. `interval` None processes what is there and
    stops; `open_flows` then has the rest.
    """
    writer = packets.writeStream.foreachBatch(flow_step(out, limits, late_seconds)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def open_flows(spark: SparkSession, out: str, limits: FlowLimits = FlowLimits()) -> DataFrame:
    """Flows that a stopped `stream_flows` still holds, the packets that wait among them.

    With the rows it has written they are all flows of its input. No packet follows the last flow of a key, so its idle limit
    closes it, as it does when the watermark passes. The state stays as it is: the stream can go on.
    """
    marks = spark.read.schema(_MARK).parquet(f"{out}/state/*/mark")
    open_, waiting, _ = _read(spark, f"{out}/state", marks.agg(F.max("batch")).first()[0])
    touched, rest = _parted(open_, waiting)
    flows = advance(touched, waiting, limits).unionByName(rest.withColumn("closed_by", F.lit(None).cast("string")))
    return _shaped(flows.withColumn("closed_by", F.coalesce("closed_by", F.lit("idle"))), FLOW_ROWS)


def idle_sessions(packets: DataFrame, limits: FlowLimits = FlowLimits(), late: str = "10 seconds") -> DataFrame:
    """Flows by idle gap alone, with built-in session windows; works on batches as well.

    Partial sessions are merged before the shuffle only in part, so this is for keys of ordinary size.
    """
    gap = F.when(F.col("protocol") == "DNS", f"{limits.dns_activity_timeout} seconds").otherwise(
        f"{limits.activity_timeout} seconds")
    keyed = _keyed(packets, limits)
    if packets.isStreaming:
        keyed = keyed.withWatermark("ts", late)
    return keyed.groupBy(F.session_window("ts", gap).alias("session"), "flow_key").agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes"))
