"""One row of features per flow.

All packet measures are plain aggregations over `flow_uid` with map-side partial results. The
median and the mode keep a count per different value: lengths are 16-bit numbers, and the
differences of a flow that lasts T microseconds can take at most sqrt(2 T) different values
because they add up to T, so these maps are bounded however many packets a flow has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexical, packets as P
from ..functions.stats import STATS, statistic
from ..session import cut_lineage
from .flows import with_direction, with_previous

def _when(flag: str, value: str) -> Column:
    return F.when(F.col(flag), F.col(value))


def _seconds(flag: str | None = None) -> Column:
    ts = F.col("ts_us") if flag is None else _when(flag, "ts_us")
    return (F.max(ts) - F.min(ts)) / 1_000_000


def _rate(top: Column, n: Column, seconds: Column) -> Column:
    """0 with at most one packet, -1 without duration, else top per second."""
    return F.when(n <= 1, 0.0).when(seconds <= 0, -1.0).otherwise(F.try_divide(top, seconds))


def _counts() -> dict[str, Column]:
    n, recv, send = F.count(F.lit(1)), F.count_if("is_recv"), F.count_if("is_send")
    total = F.sum("len")
    recv_bytes = F.coalesce(F.sum(_when("is_recv", "len")), F.lit(0))
    send_bytes = F.coalesce(F.sum(_when("is_send", "len")), F.lit(0))
    seconds = _seconds()
    return {
        "duration": seconds,
        "packets_numbers": n,
        "receiving_packets_numbers": recv,
        "sending_packets_numbers": send,
        "total_bytes": total,
        "receiving_bytes": recv_bytes,
        "sending_bytes": send_bytes,
        "packets_rate": _rate(n, n, seconds),
        "receiving_packets_rate": _rate(recv, recv, _seconds("is_recv")),
        "sending_packets_rate": _rate(send, send, _seconds("is_send")),
        # Duration is tested first here, so a flow of one packet has -1.
        "packets_len_rate": F.when(seconds <= 0, -1.0).otherwise(F.try_divide(total, seconds)),
        "receiving_packets_len_rate": _rate(recv_bytes, recv, _seconds("is_recv")),
        "sending_packets_len_rate": _rate(send_bytes, send, _seconds("is_send")),
    }


def _length_stats() -> dict[str, Column]:
    measures = {
        "packets_len": F.col("len"),
        "receiving_packets_len": _when("is_recv", "len"),
        "sending_packets_len": _when("is_send", "len"),
    }
    return {f"{s}_{m}": statistic(s, x) for m, x in measures.items() for s in STATS}


def _delta_len_stats() -> dict[str, Column]:
    sides = {"receiving": "d_len_recv", "sending": "d_len_send"}
    return {f"{s}_{d}_packets_delta_len": statistic(s, F.col(c)) for d, c in sides.items() for s in STATS}


def _delta_time_stats() -> dict[str, Column]:
    sides = {"receiving": "d_us_recv", "sending": "d_us_send"}
    out = {}
    for d, c in sides.items():
        for s in STATS:
            out[f"{s}_{d}_packets_delta_time"] = statistic(s, F.col(c), scale=1_000_000)
    # The established table header spells this one column differently; both names are offered.
    out["skewness_sreceiving_packets_delta_time"] = statistic("skewness", F.col("d_us_recv"))
    return out


# Feature registry: name -> aggregate expression over the packets of a flow. Users add their own
# with `register`; only the ones asked for are computed.
PACKET_FEATURES: dict[str, Column | Callable[[], Column]] = {}


def register(name: str, build: Callable[[], Column]) -> None:
    """Add a flow feature: an aggregate over packet columns, built when it is asked for."""
    PACKET_FEATURES[name] = build




def count_names() -> list[str]:
    return list(_counts())


def length_names() -> list[str]:
    return list(_length_stats())


def delta_len_names() -> list[str]:
    return list(_delta_len_stats())


def delta_time_names() -> list[str]:
    return list(_delta_time_stats())


def _packet_features(assigned: DataFrame, names: list[str], extra: list[Column]) -> DataFrame:
    df = with_direction(assigned)
    if any("_delta_" in n for n in names):
        df = with_previous(df)
    built = {**_counts(), **_length_stats(), **_delta_len_stats(), **_delta_time_stats()}
    for n in names:
        if n not in built:
            built[n] = PACKET_FEATURES[n]()
    return df.groupBy("flow_uid").agg(*extra, *[built[n].alias(n) for n in names])


def packet_features(assigned: DataFrame, names: list[str]) -> DataFrame:
    """The named packet features, one row per flow: one aggregation for all of them."""
    return _packet_features(assigned, names, [])


def flow_header(assigned: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Identifying columns of a flow, and the named packet features from the same aggregation."""
    names = names or []
    df = _packet_features(assigned, names, [F.min("origin").alias("_o"), F.min("protocol").alias("protocol")])
    ts = F.timestamp_micros("_o.ts_us")
    dns_id = F.when(F.col("protocol") == "DNS", F.col("_o.txid"))
    return df.select(
        "flow_uid",
        P.flow_id_text(ts, F.col("_o.src_ip"), F.col("_o.src_port"), F.col("_o.dst_ip"),
                       F.col("_o.dst_port"), dns_id).alias("flow_id"),
        ts.alias("timestamp"), "_o.src_ip", "_o.src_port", "_o.dst_ip", "_o.dst_port", "protocol", *names)


def handshakes(assigned: DataFrame) -> DataFrame:
    """Three-way handshake per TCP flow: `handshake_duration`, `delta_start`, `handshake_status`.

    The handshake is the first SYN, the first later SYN+ACK that answers it and the first later
    ACK that answers that one; it counts only when another packet follows. `delta_start` is the
    time from the final ACK to the first packet that is none of the three, which may lie before
    the end. Three aggregations over ever smaller inputs; no packet list is built. They read `assigned` four times, so
    give it kept (`session.cut_lineage`).
    """
    cols = ["flow_uid", "ts_us", "pkt_no", "tcp_flags", "seq", "ack"]
    at = F.struct("ts_us", "pkt_no")
    tcp = assigned.select(*cols)
    flag = lambda mask: P.has_flag(F.col("tcp_flags"), mask)
    # The transport is not part of the flow key. That of the first packet decides. The first SYN comes from the same pass.
    flows = cut_lineage(assigned.groupBy("flow_uid").agg(
        F.min_by("transport", at).alias("transport"), F.max(at).alias("end"),
        F.min(F.when(flag(P.SYN), F.struct("ts_us", "pkt_no", "seq"))).alias("syn")))
    first = flows.filter(F.col("syn").isNotNull() & (F.col("transport") == "TCP"))
    # Join keys hold sequence numbers as well as the flow, so a busy flow is spread.
    answers = (
        tcp.filter(flag(P.SYN) & flag(P.ACK)).withColumn("want", F.col("ack") - 1)
        .join(first.select("flow_uid", "syn", F.col("syn.seq").alias("want")), ["flow_uid", "want"])
        .filter(at > F.struct("syn.ts_us", "syn.pkt_no"))
        .groupBy("flow_uid")
        .agg(F.min("syn").alias("syn"), F.min(F.struct("ts_us", "pkt_no", "seq", "ack")).alias("answer")))
    finals = (
        tcp.filter(flag(P.ACK)).withColumn("want", F.col("ack") - 1)
        .join(answers.select("flow_uid", "syn", "answer", F.col("answer.seq").alias("want"),
                             F.col("answer.ack").alias("seq")), ["flow_uid", "want", "seq"])
        .filter(at > F.struct("answer.ts_us", "answer.pkt_no"))
        .groupBy("flow_uid")
        .agg(F.min("syn").alias("syn"), F.min("answer").alias("answer"), F.min(at).alias("final")))
    # The first packet that is no part of the handshake is among the first four of the flow. Four
    # per slot are kept, so a flow contributes at most four times its number of slots.
    slot = Window.partitionBy("flow_key", "slot", "flow_uid").orderBy("ts_us", "pkt_no")
    heads = (
        assigned.withColumn("_n", F.row_number().over(slot)).filter("_n <= 4")
        .groupBy("flow_uid").agg(F.array_sort(F.collect_list(at)).alias("heads")))
    parts = F.array("syn.pkt_no", "answer.pkt_no", "final.pkt_no")
    other = F.get(F.filter("heads", lambda p: ~F.array_contains(parts, p["pkt_no"])), F.lit(0))
    done = F.col("final").isNotNull() & (F.col("end") > F.col("final")) & (F.col("transport") == "TCP")
    micro = 1_000_000
    return (
        flows.drop("syn").join(finals, "flow_uid", "left").join(heads, "flow_uid")
        .select(
            "flow_uid",
            F.when(done, (F.col("final.ts_us") - F.col("syn.ts_us")) / micro).alias("handshake_duration"),
            F.when(done, (other["ts_us"] - F.col("final.ts_us")) / micro).alias("delta_start"),
            F.when(F.col("transport") != "TCP", "not a tcp connection").when(done, "complete")
            .otherwise("not a complete handshake").alias("handshake_status")))


def dns_records(assigned: DataFrame) -> DataFrame:
    """First name, record counts and section averages of DNS flows.

    `average_answer_resource_records` averages the additional count as established tables do;
    `average_answer_count` is the average the name promises.
    """
    dns = assigned.filter(F.col("protocol") == "DNS")
    at = F.struct("ts_us", "pkt_no")
    names = F.concat(
        F.coalesce("qnames", F.array().cast("array<string>")),
        F.coalesce(F.transform("answers", lambda a: a["name"]), F.array().cast("array<string>")))
    first_name = F.get(F.filter(names, lambda n: n.isNotNull() & (n != "")), F.lit(0))
    of_type = lambda t: F.coalesce(
        F.sum(F.size(F.filter("answers", lambda a: a["type"] == t))), F.lit(0))
    return dns.withColumn("_name", first_name).groupBy("flow_uid").agg(
        F.min_by("_name", F.when(F.col("_name").isNotNull(), at)).alias("dns_domain_name"),
        of_type(1).alias("distinct_A_records"),
        of_type(2).alias("distinct_NS_records"),
        F.avg("nscount").alias("average_authority_resource_records"),
        F.avg("arcount").alias("average_additional_resource_records"),
        F.avg("arcount").alias("average_answer_resource_records"),
        F.avg("ancount").alias("average_answer_count"),
    )


TTL_NAMES = ["min", "max", "mean", "mode", "variance", "standard_deviation", "median", "skewness",
             "coefficient_of_variation"]


def ttl_stats(assigned: DataFrame) -> DataFrame:
    """Statistics of the answer TTLs of DNS flows; -1 when a flow has none."""
    dns = assigned.filter(F.col("protocol") == "DNS")
    ttls = dns.select("flow_uid", F.explode_outer(F.transform("answers", lambda a: a["ttl"])).alias("ttl"))
    ttl = F.col("ttl")
    stats = ttls.groupBy("flow_uid").agg(
        *[statistic(s, ttl, empty=-1.0).alias(f"ttl_values_{s}") for s in TTL_NAMES])
    # The distinct count is its own two-step aggregation; both have map-side partial results.
    distinct = ttls.distinct().groupBy("flow_uid").agg(F.count("ttl").alias("distinct_ttl_values"))
    return distinct.join(stats, "flow_uid")


RECORD_LISTS = {
    "query_resource_record_type": ("additionals", "type"),
    "ans_resource_record_type": ("answers", "type"),
    "query_resource_record_class": ("additionals", "cls"),
    "ans_resource_record_class": ("answers", "cls"),
}


def record_list_chunks(assigned: DataFrame, most: int = 10_000) -> DataFrame:
    """Record types and classes of DNS flows in packet order, in rows (`flow_uid`, `slot`, `part`) of bounded size.

    The lists of a flow are those of its rows one after the other. A row begins where the records of the flow's earlier
    packets in the slot pass another multiple of `most`, so it holds at most `most` records and those of one packet more,
    however long the flow is. A packet without records counts as none; a flow without any has empty lists.
    """
    size = sum((F.coalesce(F.size(c), F.lit(0)) for c in ("additionals", "answers")), F.lit(0))
    before = Window.partitionBy("flow_key", "slot", "flow_uid").orderBy("ts_us", "pkt_no").rowsBetween(
        Window.unboundedPreceding, -1)
    records = F.coalesce(F.sum(F.greatest(size, F.lit(0))).over(before), F.lit(0))
    dns = assigned.filter(F.col("protocol") == "DNS").withColumn("part", F.floor(records / most))
    at = [F.col("ts_us"), F.col("pkt_no")]
    listed = {
        out: F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct(
                *at, F.coalesce(F.transform(col, lambda r: r[field]), F.array().cast("array<int>")).alias("v")))),
            lambda s: s["v"]))
        for out, (col, field) in RECORD_LISTS.items()
    }
    return dns.groupBy("flow_key", "slot", "flow_uid", "part").agg(
        *[v.alias(k) for k, v in listed.items()]).drop("flow_key")


def numbered_chunks(chunks: DataFrame) -> DataFrame:
    """`record_list_chunks` with `chunk`, their number within the flow from 0 on, instead of slot and part."""
    order = Window.partitionBy("flow_uid").orderBy("slot", "part")
    return chunks.withColumn("chunk", F.row_number().over(order) - 1).drop("slot", "part")


def record_lists(chunks: DataFrame) -> DataFrame:
    """Whole lists per flow from `record_list_chunks`, for every flow.

    A list is as long as the flow has records, which the maximum duration of a flow bounds; jobs over
    flows whose lists would be too long for a row read the chunks.
    """
    return chunks.groupBy("flow_uid").agg(*[
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", "part", F.col(c).alias("v")))),
                              lambda s: s["v"])).alias(c) for c in RECORD_LISTS])


def dns_column_names() -> list[str]:
    """Columns that only DNS flows fill, registration columns left out."""
    return [*lexical.name_features(F.lit("x")), "dns_domain_name", "distinct_A_records", "distinct_NS_records",
            "average_authority_resource_records", "average_additional_resource_records",
            "average_answer_resource_records", "average_answer_count", "distinct_ttl_values",
            *[f"ttl_values_{s}" for s in TTL_NAMES], *RECORD_LISTS]


def flow_features(assigned: DataFrame, allow: list[str] | None = None, ignore: list[str] | None = None,
                  label: str = "Unknown", whois: DataFrame | None = None, as_of=None) -> DataFrame:
    """The wide feature table: header, the features asked for, `label`.

    `allow` keeps only the named columns, `ignore` drops some. Parts of which no column is asked
    for are not computed.
    """
    from .enrich import WHOIS_COLUMNS, with_whois

    ignored = set(ignore or [])

    def wanted(names) -> list[str]:
        return [n for n in names if (allow is None or n in allow) and n not in ignored]

    table = flow_header(assigned, wanted(
        [*_counts(), *_length_stats(), *_delta_len_stats(), *_delta_time_stats(), *PACKET_FEATURES]))
    if wanted(["handshake_duration", "delta_start", "handshake_status"]):
        table = table.join(handshakes(assigned), "flow_uid", "left")
    name = F.col("dns_domain_name")
    lexical_names = list(lexical.name_features(F.lit("x")))
    record_names = ["distinct_A_records", "distinct_NS_records", "average_authority_resource_records",
                    "average_additional_resource_records", "average_answer_resource_records"]
    whois_names = WHOIS_COLUMNS if whois is not None else []
    if wanted([*lexical_names, *record_names, *whois_names]):
        table = table.join(dns_records(assigned), "flow_uid", "left")
        derived = wanted([n for n in lexical_names if n != "dns_domain_name"])
        if derived:
            built = lexical.name_features(name)
            table = table.withColumns({n: built[n] for n in derived})
    ttl_names = ["distinct_ttl_values", *[f"ttl_values_{s}" for s in TTL_NAMES]]
    if wanted(ttl_names):
        table = table.join(ttl_stats(assigned), "flow_uid", "left")
    if wanted(RECORD_LISTS):
        table = table.join(record_lists(record_list_chunks(assigned)), "flow_uid", "left")
    if wanted(whois_names):
        table = with_whois(table, whois, as_of)
    table = table.withColumn("label", F.lit(label))
    header = ["flow_id", "timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol"]
    columns = ([c for c in header if allow is None or c in allow]
               + wanted(c for c in table.columns if c not in header and c not in ("flow_uid", "label"))
               + (["label"] if allow is None or "label" in allow else []))
    return table.select("flow_uid", *columns)
