"""Packets to flows.

A flow key may be very busy (DNS flows are keyed by a 16-bit id alone), so no step puts all
packets of a key into one task. Packets are spread by (key, time slot). Every slot is summarised
in one row, a window over the few slot rows of a key carries what is open at the end of a slot
into the next one, and the result is joined back on (key, slot), which is how the packets are
already partitioned: the packets move once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packets as P
from ..session import attach, cut_lineage


@dataclass(frozen=True)
class FlowLimits:
    """Time limits in seconds. A flow ends when a limit is exceeded, not when it is met."""

    activity_timeout: float = 5000
    dns_activity_timeout: float = 30
    max_flow_duration: float = 120000
    teardown: bool = True
    dns_key: str = "txid"
    slot_seconds: int = 86400
    # Packets of a key and slot above which the slot is cut into shorter ones.
    slot_packets: int = 2_000_000
    # Packets up to which a run that needs the maximum duration is folded within one task.
    fold_packets: int = 100_000


def keep_transport_packets(packets: DataFrame) -> DataFrame:
    """IPv4 over TCP or UDP only."""
    return packets.filter((F.col("ip_version") == 4) & F.col("transport").isin("TCP", "UDP"))


def with_protocol(packets: DataFrame) -> DataFrame:
    return packets.withColumn("protocol", P.app_protocol(F.col("src_port"), F.col("dst_port")))


def _keyed(packets: DataFrame, limits: FlowLimits) -> DataFrame:
    app = P.app_protocol(F.col("src_port"), F.col("dst_port"))
    dns = F.col("protocol") == "DNS"
    key = P.flow_key(F.col("protocol"), F.col("src_ip"), F.col("dst_ip"), F.col("src_port"),
                     F.col("dst_port"), F.col("txid"), limits.dns_key)
    if "chunk" in packets.columns:  # files that are to be taken one by one
        key = F.concat_ws("|", "chunk", key)
    ends = (~dns) & (F.col("transport") == "TCP") & F.lit(limits.teardown)
    return (
        packets.withColumn("protocol", app)
        .withColumn("ts_us", P.micros(F.col("ts")))
        .withColumn("flow_key", key)
        .withColumn("_idle_us", F.when(dns, int(limits.dns_activity_timeout * 1_000_000))
                    .otherwise(int(limits.activity_timeout * 1_000_000)).cast("bigint"))
        .withColumn("_fin", F.when(ends & P.has_flag(F.col("tcp_flags"), P.FIN), 1).otherwise(0))
        .withColumn("_rst", ends & P.has_flag(F.col("tcp_flags"), P.RST))
    )


# What later packets need to know of the packet that opened their flow.
ORIGIN = ("pkt_no", "ts_us", "src_ip", "src_port", "dst_ip", "dst_port", "txid")


def _origin() -> Column:
    return F.struct(*ORIGIN)


def assign_flows(packets: DataFrame, limits: FlowLimits = FlowLimits(), keep: bool = False) -> DataFrame:
    """Every packet with its flow: columns `flow_uid` and `origin`.

    `flow_uid` is the number of the flow's first packet; `origin` holds that packet's endpoints,
    time and transaction id. Order within a key is (time, packet number), and packet numbers are
    unique. Rules: a new flow starts after an idle gap, after a reset, after every second FIN
    (not for DNS), and when a packet is later than the flow's start by more than the maximum
    duration.

    Without the last rule a flow depends on gaps, resets and FIN counts alone (`_runs`). A
    look at the slot rows tells which keys hold a flow that may outlive the limit; as a rule none
    does, and the result is lazy. See `_split_long_flows` for those that do.

    With `keep`, packets that have to be passed over several times are kept with what is known within their slots, so they
    are read and ordered once. All their columns are written then, so it is for narrow rows or dear sources.
    """
    return assign_keyed(_keyed(packets, limits), limits, keep)


def assign_keyed(keyed: DataFrame, limits: FlowLimits = FlowLimits(), keep: bool = False) -> DataFrame:
    """`assign_flows` of rows that have their key, time in microseconds, idle limit and closing flags."""
    limit_us = int(limits.max_flow_duration * 1_000_000)
    slot_us = int(min(limits.slot_seconds, limits.max_flow_duration) * 1_000_000)
    slot_us = max(slot_us, 1)
    keyed = keyed.withColumn("slot", F.expr(f"ts_us div {slot_us}"))
    size = keyed.agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).first()
    if size["n"] > limits.slot_packets:
        keyed = _shorter_slots(keyed, slot_us, limits.slot_packets)
    at_once = size["n"] == 0 or size["b"] - size["a"] <= limit_us
    df = _in_slots(keyed)
    if at_once:
        # No flow of this input can outlive the limit: one lazy plan.
        return _runs(df, _slot_rows(df)).drop("_run", "_fins")
    if keep:
        df = cut_lineage(df)
    slots = cut_lineage(_slot_rows(df))
    runs = _runs(df, slots)
    suspects = slots.filter(F.col("end_us") - F.col("origin_in.ts_us") > limit_us).select("flow_key").distinct()
    n = suspects.count()
    if n == 0:
        return runs.drop("_run", "_fins")
    return _split_long_flows(runs, suspects, n, limit_us, limits.fold_packets)


_SHORT = 1 << 20  # most parts of a slot


def _shorter_slots(df: DataFrame, slot_us: int, most: int) -> DataFrame:
    """Slots of a busy key cut into parts, so that a (key, slot) group stays within a task.

    Counts per key and slot are partial aggregations. A slot with k times too many packets is cut
    into 4 k parts of equal length, as packets need not be spread evenly. N packets have at most
    N / `most` such slots.
    """
    full = cut_lineage(
        df.groupBy("flow_key", "slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
        .select("flow_key", "slot", F.least(F.ceil(F.col("n") / most) * 4, F.lit(_SHORT)).alias("_parts")))
    n = full.count()
    if n == 0:
        return df
    part = F.expr(f"((ts_us - slot * {slot_us}) * _parts) div {slot_us}")
    return attach(df, full, ["flow_key", "slot"], "left", rows=n).withColumn(
        "slot", F.col("slot") * _SHORT + F.coalesce(part, F.lit(0))).drop("_parts")


def _in_slots(df: DataFrame) -> DataFrame:
    """What can be told within a slot, for an even and for an odd number of FINs brought into it.

    A run is what lies between idle gaps and resets. Within it, FINs are counted, and a flow
    starts after every second one.
    """
    slot = Window.partitionBy("flow_key", "slot").orderBy("ts_us", "pkt_no")
    before = slot.rowsBetween(Window.unboundedPreceding, -1)
    upto = slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = (
        df.withColumn("_prev", F.lag(F.struct("ts_us", "_fin", "_rst")).over(slot))
        .withColumn("_seen", F.coalesce(F.sum("_fin").over(before), F.lit(0)))
        .withColumn("_gap", F.coalesce(
            (F.col("ts_us") - F.col("_prev.ts_us") > F.col("_idle_us")) | F.col("_prev._rst"),
            F.lit(False)))
        .withColumn("_base", F.last(
            F.when(F.col("_gap"), F.struct("pkt_no", F.col("_seen").alias("fins"))), True).over(upto))
    )
    # FINs of the run before this packet, up to the parity brought in from earlier slots.
    count = F.col("_seen") - F.coalesce(F.col("_base.fins"), F.lit(0))
    after_fin = F.coalesce(F.col("_prev._fin") == 1, F.lit(False))

    def opens(parity: int) -> Column:
        carried = F.when(F.col("_base").isNull(), F.lit(parity)).otherwise(F.lit(0))
        return F.col("_gap") | (after_fin & (F.pmod(count + carried, F.lit(2)) == 0))

    return df.withColumns({
        f"_open{k}": F.last(F.when(opens(k), _origin()), True).over(upto) for k in (0, 1)})


def _slot_rows(df: DataFrame) -> DataFrame:
    """One row per (key, slot): what is open when the slot begins.

    `offset`: FINs of the key before the slot; `run_in`: first packet of the run the slot begins in
    and the FINs of the key before that; `parity`: FINs of that run before the slot, modulo 2;
    `origin_in`: first packet of the flow the slot begins in; `end_us`: last packet time.
    """
    order = F.struct("ts_us", "pkt_no")
    slots = df.groupBy("flow_key", "slot").agg(
        F.min(F.struct("ts_us", "pkt_no", "src_ip", "src_port", "dst_ip", "dst_port", "txid")).alias("first"),
        F.max(F.struct("ts_us", "pkt_no", "_fin", "_rst")).alias("last"),
        F.sum("_fin").alias("fins"),
        F.max("_idle_us").alias("idle_us"),
        F.max_by("_base", order).alias("base"),
        F.max_by("_open0", order).alias("open0"),
        F.max_by("_open1", order).alias("open1"),
    )
    by_slot = Window.partitionBy("flow_key").orderBy("slot")
    earlier = by_slot.rowsBetween(Window.unboundedPreceding, -1)
    return (
        slots.withColumn("prior", F.lag("last").over(by_slot))
        .withColumn("offset", F.coalesce(F.sum("fins").over(earlier), F.lit(0)))
        .withColumn("head_gap", F.col("prior").isNull()
                    | (F.col("first.ts_us") - F.col("prior.ts_us") > F.col("idle_us"))
                    | F.col("prior._rst"))
        .withColumn("head_run", F.when(
            F.col("head_gap"), F.struct(F.col("first.pkt_no").alias("pkt_no"), F.col("offset").alias("fins"))))
        .withColumn("tail_run", F.when(
            F.col("base").isNotNull(),
            F.struct(F.col("base.pkt_no").alias("pkt_no"), (F.col("offset") + F.col("base.fins")).alias("fins")),
        ).otherwise(F.col("head_run")))
        .withColumn("run_in", F.coalesce("head_run", F.last("tail_run", True).over(earlier)))
        .withColumn("parity", F.pmod(F.col("offset") - F.col("run_in.fins"), F.lit(2)))
        .withColumn("head_origin", F.when(
            F.col("head_gap") | ((F.col("prior._fin") == 1) & (F.col("parity") == 0)),
            F.struct(*[F.col(f"first.{c}").alias(c) for c in ORIGIN])))
        .withColumn("tail_origin", F.coalesce(
            F.when(F.col("parity") == 0, F.col("open0")).otherwise(F.col("open1")), F.col("head_origin")))
        .withColumn("origin_in", F.coalesce("head_origin", F.last("tail_origin", True).over(earlier)))
        .select("flow_key", "slot", "offset", "run_in", "parity", "origin_in", F.col("last.ts_us").alias("end_us"))
    )


def _runs(df: DataFrame, slots: DataFrame) -> DataFrame:
    """Packets with `flow_uid` and `origin` (maximum duration left aside), `_run` (number of the
    run's first packet) and `_fins` (FINs of the run before this packet)."""
    return (
        df.join(slots.drop("end_us"), ["flow_key", "slot"])
        .withColumn("origin", F.coalesce(
            F.when(F.col("parity") == 0, F.col("_open0")).otherwise(F.col("_open1")), F.col("origin_in")))
        .withColumn("flow_uid", F.col("origin.pkt_no"))
        .withColumn("_run", F.coalesce("_base.pkt_no", "run_in.pkt_no"))
        .withColumn("_fins", F.when(F.col("_base").isNotNull(), F.col("_seen") - F.col("_base.fins"))
                    .otherwise(F.col("offset") + F.col("_seen") - F.col("run_in.fins")))
        .drop("_prev", "_seen", "_gap", "_base", "_open0", "_open1", "_fin", "_rst", "_idle_us",
              "offset", "run_in", "parity", "origin_in")
    )


def _split_long_flows(runs: DataFrame, suspects: DataFrame, n: int, limit_us: int, fold_packets: int) -> DataFrame:
    """Apply the maximum duration to the runs of the suspect keys (`n` of them).

    The first packet of a run that is too late for its flow restarts the run's FIN count there. A
    run of up to `fold_packets` packets is folded in order (`_folded_cuts`); larger ones are cut
    by rounds of plain aggregations (`_cuts_by_rounds`), so no run is ever gathered in one task.
    """
    plain = runs.drop("_run", "_fins")
    at = F.struct("ts_us", "pkt_no")
    narrow = cut_lineage(attach(
        runs.select("flow_key", "_run", "ts_us", "pkt_no", "_fins", _origin().alias("me")),
        suspects, ["flow_key"], rows=n).drop("flow_key"))
    sizes = cut_lineage(
        narrow.groupBy("_run").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
        .filter(F.col("b") - F.col("a") > limit_us).select("_run", (F.col("n") <= fold_packets).alias("small")))
    count = sizes.groupBy().agg(F.count_if("small"), F.count_if(~F.col("small"))).first()
    packets = narrow.drop("me")
    found = []
    if count[0]:
        small = attach(packets, sizes.filter("small").drop("small"), ["_run"], rows=count[0])
        found.append(_folded_cuts(small, limit_us))
    if count[1]:
        large = attach(packets, sizes.filter(~F.col("small")).drop("small"), ["_run"], rows=count[1])
        found += _cuts_by_rounds(large, limit_us)
    if not found:
        return plain
    restarts = found[0]
    for more in found[1:]:
        restarts = restarts.unionByName(more)

    # Restarts of a run are more than the limit apart: at most span / limit of them, a short array.
    cuts = cut_lineage(restarts.groupBy("_run").agg(F.array_sort(F.collect_list("head")).alias("_cuts")))
    cut_rows = cuts.count()
    if cut_rows == 0:
        return plain

    def cut_up(df: DataFrame, how: str) -> DataFrame:
        return (
            attach(df, cuts, ["_run"], how, rows=cut_rows)
            .withColumn("_cut", F.try_element_at(
                F.filter("_cuts", lambda c: F.struct(c["ts_us"], c["pkt_no"]) <= at), F.lit(-1)))
            .withColumn("_part", F.expr("(_fins - coalesce(_cut._fins, 0)) div 2"))
            .withColumn("_cut", F.coalesce("_cut.pkt_no", "_run")).drop("_cuts")
        )

    parts = ["_run", "_cut", "_part"]
    starts = cut_lineage(cut_up(narrow, "inner").groupBy(*parts).agg(F.min_by("me", at).alias("_start")))
    return (
        attach(cut_up(runs, "left"), starts, parts, "left")
        .withColumn("origin", F.coalesce("_start", "origin"))
        .withColumn("flow_uid", F.col("origin.pkt_no"))
        .select(*plain.columns)
    )


def _folded_cuts(packets: DataFrame, limit_us: int) -> DataFrame:
    """Restarts (`_run`, `head`) of runs of bounded size: one ordered fold per run."""
    packet = F.struct("ts_us", "pkt_no", "_fins")
    runs = packets.groupBy("_run").agg(F.array_sort(F.collect_list(packet)).alias("p"))
    first = F.get("p", F.lit(0))
    begin = F.struct(
        F.lit(0).cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("part"), first["ts_us"].alias("start"),
        F.array().cast("array<struct<ts_us:bigint,pkt_no:bigint,_fins:bigint>>").alias("cuts"))

    def step(s: Column, p: Column) -> Column:
        part = F.floor((p["_fins"] - s["base"]) / 2)
        return (
            F.when(part != s["part"], F.struct(
                s["base"].alias("base"), part.alias("part"), p["ts_us"].alias("start"), s["cuts"].alias("cuts")))
            .when(p["ts_us"] - s["start"] > limit_us, F.struct(
                p["_fins"].alias("base"), F.lit(0).cast("bigint").alias("part"), p["ts_us"].alias("start"),
                F.concat(s["cuts"], F.array(p)).alias("cuts")))
            .otherwise(s))

    return runs.select("_run", F.explode(F.aggregate("p", begin, step, lambda s: s["cuts"])).alias("head"))


def _cuts_by_rounds(packets: DataFrame, limit_us: int) -> list[DataFrame]:
    """Restarts (`_run`, `head`) of runs of any size, one per run and round, for all runs at once.

    Every step is an aggregation with map-side partial results. The number of rounds is the largest
    number of restarts of a run, at most time span / limit.
    """
    at = F.struct("ts_us", "pkt_no")
    heads = cut_lineage(packets.groupBy("_run").agg(F.min(F.struct("ts_us", "pkt_no", "_fins")).alias("head")))
    n = heads.count()
    found = []
    while n > 0:
        live = (
            attach(packets, heads, ["_run"], rows=n)
            .filter(at >= F.struct("head.ts_us", "head.pkt_no"))
            .withColumn("part", F.expr("(_fins - head._fins) div 2"))
        )
        late = (
            live.groupBy("_run", "part")
            .agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
            .filter(F.col("end_us") - F.col("start_us") > limit_us)
            .groupBy("_run").agg(F.min(F.struct("part", "start_us")).alias("late"))
        )
        heads = cut_lineage(
            attach(live, late, ["_run"], rows=n)
            .filter((F.col("part") == F.col("late.part"))
                    & (F.col("ts_us") - F.col("late.start_us") > limit_us))
            .groupBy("_run").agg(F.min(F.struct("ts_us", "pkt_no", "_fins")).alias("head"))
        )
        n = heads.count()
        if n > 0:
            found.append(heads)
    return found


def with_direction(assigned: DataFrame) -> DataFrame:
    """`is_recv` and `is_send`, both seen from the flow's destination; both hold when the ips are equal."""
    return assigned.withColumn("is_recv", F.col("dst_ip") == F.col("origin.dst_ip")).withColumn(
        "is_send", F.col("src_ip") == F.col("origin.dst_ip"))


def with_previous(assigned: DataFrame) -> DataFrame:
    """Length and time differences to the previous packet of the same flow and direction.

    Columns added: `d_len_recv`, `d_us_recv`, `d_len_send`, `d_us_send`; NULL where there is no
    such packet. Same slot scheme as the assignment.
    """
    df = assigned if "is_recv" in assigned.columns else with_direction(assigned)
    slot = Window.partitionBy("flow_key", "slot").orderBy("ts_us", "pkt_no")
    before = slot.rowsBetween(Window.unboundedPreceding, -1)
    packet = F.struct("ts_us", "pkt_no", "len", "flow_uid")
    sides = {"recv": "is_recv", "send": "is_send"}
    for side, flag in sides.items():
        df = df.withColumn(f"_{side}", F.last(F.when(F.col(flag), packet), True).over(before))
    by_slot = Window.partitionBy("flow_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    tails = df.groupBy("flow_key", "slot").agg(
        *[F.max(F.when(F.col(flag), packet)).alias(f"tail_{side}") for side, flag in sides.items()])
    tails = tails.select("flow_key", "slot", *[
        F.last(f"tail_{side}", True).over(by_slot).alias(f"in_{side}") for side in sides])
    df = df.join(tails, ["flow_key", "slot"])
    for side, flag in sides.items():
        prev = F.coalesce(f"_{side}", f"in_{side}")
        same = F.col(flag) & (prev["flow_uid"] == F.col("flow_uid"))
        df = df.withColumn(f"d_len_{side}", F.when(same, F.col("len") - prev["len"])) \
            .withColumn(f"d_us_{side}", F.when(same, F.col("ts_us") - prev["ts_us"]))
    return df.drop("_recv", "_send", "in_recv", "in_send")


def flow_orientation(assigned: DataFrame) -> DataFrame:
    """One row per flow: endpoints, start and packet counts by direction."""
    df = with_direction(with_protocol(assigned))
    return df.groupBy("flow_uid").agg(
        F.min("origin").alias("origin"),
        F.min("protocol").alias("protocol"),
        F.count(F.lit(1)).alias("packets_numbers"),
        F.count_if("is_recv").alias("receiving_packets_numbers"),
        F.count_if("is_send").alias("sending_packets_numbers"),
    ).select("flow_uid", "origin.src_ip", "origin.src_port", "origin.dst_ip", "origin.dst_port",
             F.col("origin.ts_us").alias("start_us"), "origin.txid", "protocol",
             "packets_numbers", "receiving_packets_numbers", "sending_packets_numbers")


def tcp_flag_counts(packets: DataFrame) -> DataFrame:
    """Packets by application protocol and how many carry each of the four tested flags."""
    flags = {"fin": P.FIN, "syn": P.SYN, "rst": P.RST, "ack": P.ACK}
    return with_protocol(packets).groupBy("protocol", "transport").agg(
        F.count(F.lit(1)).alias("packets"),
        *[F.count_if(P.has_flag(F.col("tcp_flags"), m)).alias(f"{n}_packets") for n, m in flags.items()])


def protocol_mix(packets: DataFrame) -> DataFrame:
    return with_protocol(packets).groupBy("protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes"))
