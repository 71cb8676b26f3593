import random

import pytest
from pyspark.sql import functions as F

from dnsq.operators import flow_features as FF, flows as FL
from dnsq.operators.flows import FlowLimits
from dnsq.sources.schemas import PACKET


def packet(no, ts, src="10.0.0.1", dst="10.0.0.2", sport=1000, dport=80, flags=16, size=100, seq=0, ack=0,
           transport="TCP", **dns):
    import datetime

    t = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=round(ts * 1e6))
    udp = transport == "UDP"
    row = dict(pkt_no=no, ts=t, ip_version=4, transport=transport, src_ip=src, dst_ip=dst, src_port=sport, dst_port=dport,
               len=size, tcp_flags=0 if udp else flags, seq=-1 if udp else seq, ack=-1 if udp else ack, txid=None,
               qnames=None, answers=None, additionals=None, ancount=None, nscount=None, arcount=None)
    row.update(dns)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in PACKET.fields) for r in rows], PACKET)


def assign(spark, rows, **limits):
    out = FL.assign_flows(frame(spark, rows), FlowLimits(**limits))
    return {r.pkt_no: r.flow_uid for r in out.select("pkt_no", "flow_uid").collect()}


def expected(rows, idle, dns_idle, longest):
    """The rules packet by packet, one open flow per key."""
    open_flows, out = {}, {}
    for p in sorted(rows, key=lambda r: (r["ts"], r["pkt_no"])):
        dns = 53 in (p["src_port"], p["dst_port"]) and 80 not in (p["src_port"], p["dst_port"])
        app = "DNS" if dns else "x"
        key = ("id", p["txid"]) if dns and p["txid"] is not None else (
            app, tuple(sorted([p["src_ip"], p["dst_ip"]])), tuple(sorted([p["src_port"], p["dst_port"]])))
        now = p["ts"].timestamp()
        f = open_flows.get(key)
        if f is None or now - f["last"] > (dns_idle if dns else idle) + 1e-9 or now - f["start"] > longest + 1e-9 or (
                not dns and (f["fins"] >= 2 or f["rst"])):
            f = open_flows[key] = {"uid": p["pkt_no"], "start": now, "fins": 0, "rst": False}
        f["last"] = now
        f["fins"] += p["tcp_flags"] & 1
        f["rst"] = f["rst"] or bool(p["tcp_flags"] & 4)
        out[p["pkt_no"]] = f["uid"]
    return out


@pytest.mark.parametrize("slot,fold,most", [(5, 100_000, 10**6), (1000, 100_000, 10**6), (5, 0, 10**6), (37, 3, 10**6), (600, 100_000, 20)])
def test_random_packets(spark, slot, fold, most):
    """Small and large slots, crowded ones cut up; long runs folded in a task, or cut by rounds."""
    rng = random.Random(7)
    rows, now = [], 0.0
    for no in range(1500):
        now += rng.choice([0, 0.5, 1, 2, 9])
        kind = rng.random()
        if kind < 0.3:
            rows.append(packet(no, now, dport=53, transport="UDP", txid=rng.choice([1, 2]), src=f"10.0.0.{rng.randint(1, 3)}"))
        else:
            a, b = rng.choice([("10.0.0.1", "10.0.0.2"), ("10.0.0.2", "10.0.0.1")])
            s, d = (1000, 8080) if a == "10.0.0.1" else (8080, 1000)
            if kind < 0.6:
                a, b = "10.0.0.9", "10.0.0.8"
            rows.append(packet(no, now, a, b, s, d, flags=rng.choice([16] * 12 + [1, 17, 17, 4])))
    got = assign(spark, rows, activity_timeout=30, dns_activity_timeout=40, max_flow_duration=60, slot_seconds=slot,
                 fold_packets=fold, slot_packets=most)
    assert got == expected(rows, 30, 40, 60)
    assert len(got) == len(rows)


def test_limits_are_strict(spark):
    rows = [packet(0, 0), packet(1, 10), packet(2, 20.000001)]
    assert assign(spark, rows, activity_timeout=10, max_flow_duration=1000) == {0: 0, 1: 0, 2: 2}
    rows = [packet(0, 0), packet(1, 5), packet(2, 10), packet(3, 10.000001)]
    assert assign(spark, rows, activity_timeout=10, max_flow_duration=10) == {0: 0, 1: 0, 2: 0, 3: 3}


def test_teardown(spark):
    rows = [packet(0, 0), packet(1, 1, flags=4), packet(2, 2), packet(3, 3, flags=1), packet(4, 4, flags=17), packet(5, 5)]
    assert assign(spark, rows) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5}
    assert set(assign(spark, rows, teardown=False).values()) == {0}


def test_dns_key_is_the_id(spark):
    rows = [packet(0, 0, dport=53, transport="UDP", txid=7), packet(1, 1, src="10.9.9.9", dport=53, transport="UDP", txid=7),
            packet(2, 2, dport=53, transport="UDP"), packet(3, 3, dport=53, transport="TCP", txid=7, flags=4),
            packet(4, 4, dport=53, transport="UDP", txid=7)]
    # An undecoded packet has a key of its endpoints; a reset does not end a DNS flow.
    assert assign(spark, rows) == {0: 0, 1: 0, 2: 2, 3: 0, 4: 0}
    assert assign(spark, rows, dns_key="txid+endpoints")[1] == 1


def test_chunks_do_not_share_flows(spark):
    rows = frame(spark, [packet(0, 0), packet(1, 1)]).withColumn("chunk", F.concat(F.lit("f"), F.col("pkt_no")))
    out = FL.assign_flows(rows)
    assert {r.flow_uid for r in out.collect()} == {0, 1}


def test_only_ipv4_transport(spark):
    rows = [packet(0, 0), packet(1, 1, transport="ICMP"), dict(packet(2, 2), ip_version=6)]
    assert FL.keep_transport_packets(frame(spark, rows)).count() == 1


def shake(spark, steps):
    rows = []
    for no, (ts, flags, seq, ack) in enumerate(steps):
        back = flags == 18
        rows.append(packet(no, ts, *(("10.0.0.2", "10.0.0.1", 80, 1000) if back else ()), flags=flags, seq=seq, ack=ack))
    got = FF.handshakes(FL.assign_flows(frame(spark, rows))).collect()
    assert len(got) == 1
    return got[0].handshake_duration, got[0].delta_start, got[0].handshake_status


def test_handshake(spark):
    syn, answer, final = (0, 2, 10, 0), (1, 18, 50, 11), (3, 16, 11, 51)
    assert shake(spark, [syn, answer, final, (7, 24, 11, 51)]) == (3.0, 4.0, "complete")
    # Without a further packet it is not complete.
    assert shake(spark, [syn, answer, final])[2] == "not a complete handshake"
    # A repeated SYN is the first packet that is no part of the handshake.
    assert shake(spark, [syn, (0.5, 2, 10, 0), answer, final, (7, 24, 11, 51)]) == (3.0, -2.5, "complete")
    assert shake(spark, [syn, (1, 18, 50, 99), final, (7, 24, 0, 0)])[2] == "not a complete handshake"


def test_handshake_of_udp(spark):
    out = FF.handshakes(FL.assign_flows(frame(spark, [packet(0, 0, transport="UDP", dport=99)]))).first()
    assert out.handshake_status == "not a tcp connection" and out.handshake_duration is None


def test_directions_and_rates(spark):
    rows = [packet(0, 0, size=100), packet(1, 1, "10.0.0.2", "10.0.0.1", 80, 1000, size=50), packet(2, 4, size=300)]
    f = FF.packet_features(FL.assign_flows(frame(spark, rows)), FF.count_names() + FF.delta_len_names() + FF.length_names()
                           + FF.delta_time_names()).first()
    assert (f.packets_numbers, f.receiving_packets_numbers, f.sending_packets_numbers) == (3, 2, 1)
    assert f.packets_rate == pytest.approx(3 / 4) and f.sending_packets_rate == 0
    assert f.packets_len_rate == pytest.approx(450 / 4)
    assert f.mean_receiving_packets_delta_len == 200 and f.max_receiving_packets_delta_time == 4
    assert f.min_sending_packets_delta_len == 0 and f.mode_packets_len == 50
    assert f.skewness_sending_packets_delta_len == 0  # no value at all
    assert f.skewness_receiving_packets_delta_len is None  # one value: no spread
    one = FF.packet_features(FL.assign_flows(frame(spark, rows[:1])), ["packets_rate", "packets_len_rate"]).first()
    assert (one.packets_rate, one.packets_len_rate) == (0, -1)


def test_equal_ips_count_both_ways(spark):
    rows = [packet(0, 0, "10.0.0.1", "10.0.0.1"), packet(1, 2, "10.0.0.1", "10.0.0.1")]
    f = FF.packet_features(FL.assign_flows(frame(spark, rows)), ["receiving_packets_numbers", "sending_packets_numbers",
                           "max_sending_packets_delta_time", "max_receiving_packets_delta_time"]).first()
    assert list(f)[1:] == [2, 2, 2.0, 2.0]


def test_previous_packet_across_slots(spark):
    rows = [packet(i, i * 10, size=100 + i) for i in range(6)]
    out = FL.with_previous(FL.assign_flows(frame(spark, rows), FlowLimits(slot_seconds=1)))
    got = {r.pkt_no: r.d_us_recv for r in out.collect()}
    assert got == {0: None, **{i: 10_000_000 for i in range(1, 6)}}


def dns(no, ts, **k):
    return packet(no, ts, dport=53, transport="UDP", txid=5, **k)


def test_dns_records_and_lists(spark):
    a = [("x.org.", 300, 1, 1), ("x.org.", 60, 2, 1)]
    rows = [dns(0, 0, qnames=["X.org."], ancount=0, nscount=1, arcount=2, additionals=[(41, 4096), (41, 1)]),
            dns(1, 1, qnames=["x.org."], answers=a, ancount=2, nscount=0, arcount=0, additionals=[])]
    assigned = FL.assign_flows(frame(spark, rows), FlowLimits(slot_seconds=1))
    r = FF.dns_records(assigned).first()
    assert (r.dns_domain_name, r.distinct_A_records, r.distinct_NS_records) == ("X.org.", 1, 1)
    assert r.average_answer_resource_records == r.average_additional_resource_records == 1
    assert r.average_answer_count == 1 and r.average_authority_resource_records == 0.5
    lists = FF.record_lists(FF.record_list_chunks(assigned)).first()
    assert lists.query_resource_record_type == [41, 41] and lists.ans_resource_record_type == [1, 2]
    assert FF.record_list_chunks(assigned).count() == 2
    whole = FL.assign_flows(frame(spark, rows + [dns(2, 2), dns(3, 3, answers=a)]), FlowLimits())
    parts = FF.numbered_chunks(FF.record_list_chunks(whole, 2)).orderBy("chunk").collect()
    assert [(r.chunk, r.query_resource_record_type, r.ans_resource_record_type) for r in parts] == [
        (0, [41, 41], []), (1, [], [1, 2]), (2, [], [1, 2])]
    t = FF.ttl_stats(assigned).first()
    assert (t.distinct_ttl_values, t.ttl_values_min, t.ttl_values_median) == (2, 60, 180)


def test_wide_table_and_registry(spark):
    rows = [dns(0, 0, qnames=["www.x.org."]), packet(1, 1), packet(2, 2)]
    assigned = FL.assign_flows(frame(spark, rows))
    wide = FF.flow_features(assigned, label="Benign")
    by = {r.protocol: r for r in wide.collect()}
    assert by["DNS"].dns_second_level_domain == "x.org" and by["HTTP"].dns_domain_name is None
    assert by["DNS"].label == "Benign" and by["DNS"].ttl_values_min == -1
    assert len(FF.count_names() + FF.length_names() + FF.delta_len_names() + FF.delta_time_names()) == 13 + 27 + 18 + 19
    FF.register("largest_port", lambda: F.max("dst_port"))
    try:
        few = FF.flow_features(assigned, allow=["protocol", "largest_port", "duration"], ignore=["duration"])
        assert few.columns == ["flow_uid", "protocol", "largest_port"]
        assert {r.largest_port for r in few.collect()} == {53, 80}
    finally:
        del FF.PACKET_FEATURES["largest_port"]


def test_whois(spark):
    from dnsq.operators.enrich import with_whois

    names = spark.createDataFrame([("a.org.",), ("b.org.",), (None,)], "dns_domain_name string")
    dim = spark.sql("select 'a.org' as domain, 'R' as registrar, 'O' as org, timestamp'2024-01-01 05:00:00' as creation_date")
    got = {r.dns_domain_name: r for r in with_whois(names, dim, "2024-01-11").collect()}
    assert got["a.org."].dns_domain_age == 10 and got["a.org."].dns_domain_organization == "O"
    assert got["b.org."].dns_domain_registrar is None and None in got


def test_busy_key_is_spread(spark):
    """The packets of one key move once, by (key, slot), and aggregations are partial first."""
    rows = [packet(i, i * 100) for i in range(40)]
    assigned = FL.assign_flows(frame(spark, rows), FlowLimits(slot_seconds=60))
    plan = FF.packet_features(assigned, ["packets_numbers", "median_packets_len"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(flow_key" in plan and "slot" in plan
    assert "partial_median" in plan or "partial_percentile" in plan or "partial_" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_kept_packets_are_read_once(spark, sf):
    """Flows that may outlive the maximum duration take several passes; with `keep` the source has one."""
    from dnsq.workload import tables as X

    seen = spark.sparkContext.accumulator(0)

    def number(n):
        seen.add(1)
        return n

    packets = X.packets(spark, sf, sections=False).withColumn("pkt_no", F.udf(number, "bigint")("pkt_no"))
    want = sorted((r.pkt_no, r.flow_uid) for r in FL.assign_flows(packets, X.LIMITS).select("pkt_no", "flow_uid").collect())
    twice, seen.value = seen.value, 0
    got = sorted((r.pkt_no, r.flow_uid) for r in FL.assign_flows(packets, X.LIMITS, keep=True).select("pkt_no", "flow_uid").collect())
    assert got == want and seen.value <= len(want) < twice
