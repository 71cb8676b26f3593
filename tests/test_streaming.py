import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dnsq.operators import flows as FL
from dnsq.operators.flows import FlowLimits
from dnsq.sources import readers as R
from dnsq.streaming import flows as SF, jobs as SJ
from dnsq.workload import tables as X
from tests.test_flows import dns, frame, packet


def write_files(spark, path, groups, first=0):
    """One finished file per group, in order of modification time."""
    for i, rows in enumerate(groups, first):
        part = f"{path}/tmp{i}"
        frame(spark, rows).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.makedirs(f"{path}/in", exist_ok=True)
        os.rename(f"{part}/{name}", f"{path}/in/{i}.parquet")
        os.utime(f"{path}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


LIMITS = FlowLimits(activity_timeout=20, dns_activity_timeout=5, max_flow_duration=60)


def traffic():
    first = [packet(0, 0), packet(1, 3, "10.0.0.2", "10.0.0.1", 80, 1000), dns(2, 4), packet(3, 5, sport=7, flags=4)]
    second = [packet(4, 10), dns(5, 12), packet(6, 13, sport=7), packet(7, 28, flags=17), packet(8, 40, flags=17)]
    third = [packet(9, 45), packet(10, 60), packet(11, 78), packet(12, 96), packet(13, 110)]
    # A late packet far ahead moves the watermark past all idle limits.
    return [first, second, third, [packet(99, 10_000, sport=5555)]]


def totals(df):
    return sorted(map(tuple, df.select("flow_uid", "packets", "bytes", "start_us", "end_us").collect()))


def batch_totals(spark, groups, limits=LIMITS):
    return sorted(map(tuple, FL.assign_flows(frame(spark, [p for g in groups for p in g]), limits).groupBy("flow_uid").agg(
        F.count(F.lit(1)), F.sum("len"), F.min("ts_us"), F.max("ts_us")).collect()))


def run_flows(spark, tmp_path, late, limits=LIMITS):
    stream = R.stream_packets(spark, f"{tmp_path}/in", files_per_trigger=1)
    SF.stream_flows(stream, f"{tmp_path}/out", f"{tmp_path}/cp", limits, late, None).awaitTermination()
    return spark.read.schema(SF.FLOW_ROWS).parquet(f"{tmp_path}/out/flows/batch=*"), SF.open_flows(spark, f"{tmp_path}/out", limits)


def test_flows_across_files_equal_the_batch(spark, tmp_path):
    groups = traffic()
    write_files(spark, str(tmp_path), groups)
    closed, left = run_flows(spark, tmp_path, 1)
    assert closed.columns == left.columns
    assert totals(closed.unionByName(left)) == batch_totals(spark, groups)
    reasons = {r.flow_uid: r.closed_by for r in closed.collect()}
    assert "teardown" in reasons.values() and "idle" in reasons.values() and "duration" in reasons.values()
    assert [r.flow_uid for r in left.collect()] == [99]  # the last packet moved the watermark past all the others


def test_flows_open_at_the_end_of_the_input(spark, tmp_path):
    groups = traffic()
    write_files(spark, str(tmp_path), groups[:2])
    closed, left = run_flows(spark, tmp_path, 86400)  # the watermark passes no packet
    assert closed.count() == 0 and totals(left) == batch_totals(spark, groups[:2])
    write_files(spark, str(tmp_path), groups[2:], 2)  # the stream goes on from its state
    closed, left = run_flows(spark, tmp_path, 5)
    assert totals(closed.unionByName(left)) == batch_totals(spark, groups)


def random_traffic(n):
    rng = random.Random(11)
    rows, now = [], 0.0
    for no in range(n):
        now += rng.choice([0, 0.5, 1, 2, 9])
        if rng.random() < 0.3:
            rows.append(packet(no, now, dport=53, transport="UDP", txid=rng.choice([1, 2]), src=f"10.0.0.{rng.randint(1, 3)}"))
        else:
            ends = rng.choice([("10.0.0.1", "10.0.0.2", 1000, 8080), ("10.0.0.2", "10.0.0.1", 8080, 1000), ("10.0.0.9", "10.0.0.8", 5, 6)])
            rows.append(packet(no, now, *ends, flags=rng.choice([16] * 9 + [1, 17, 17, 4]), size=no))
    return rows


def test_files_out_of_order(spark, tmp_path):
    """Packets reach their file up to 40 seconds late; the flows are those of one batch in order."""
    rng = random.Random(5)
    rows = random_traffic(240)
    arrival = sorted(rows, key=lambda r: r["ts"].timestamp() + rng.random() * 40)
    groups = [arrival[i:i + 80] for i in range(0, len(arrival), 80)]
    limits = FlowLimits(activity_timeout=30, dns_activity_timeout=40, max_flow_duration=60, slot_seconds=15)
    write_files(spark, str(tmp_path), groups)
    closed, left = run_flows(spark, tmp_path, 41, limits)
    assert totals(closed.unionByName(left)) == batch_totals(spark, groups, limits)
    assert closed.filter("closed_by = 'teardown'").count() > 0 and left.count() > 0


def test_a_micro_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    groups = traffic()[:2]
    step = SF.flow_step(str(tmp_path), LIMITS, 1)
    for n, again in ((0, 1), (1, 2)):
        for _ in range(again):  # as if the driver was lost before the batch was committed
            step(frame(spark, groups[n]), n)
    closed = spark.read.schema(SF.FLOW_ROWS).parquet(f"{tmp_path}/flows/batch=*")
    assert totals(closed.unionByName(SF.open_flows(spark, str(tmp_path), LIMITS))) == batch_totals(spark, groups)
    with pytest.raises(RuntimeError):
        step(frame(spark, groups[0]), 7)


def test_late_packets_and_packets_without_a_time(spark, tmp_path):
    groups = [[packet(0, 0), packet(1, 100)], [packet(2, 50), dict(packet(3, 0), ts=None), packet(4, 101)]]
    write_files(spark, str(tmp_path), groups)
    closed, left = run_flows(spark, tmp_path, 10)
    assert totals(closed.unionByName(left)) == batch_totals(spark, [[groups[0][0], groups[0][1], groups[1][2]]])


def test_an_open_flow_enters_the_next_batch_as_two_rows(spark):
    """However many packets a flow has; the step runs without Python."""
    seen = SF._waiting(frame(spark, [packet(i, i) for i in range(30)]), LIMITS)
    flows = SF.advance(spark.createDataFrame([], SF._OPEN), seen, LIMITS)
    assert [(r.packets, r.closed_by) for r in flows.collect()] == [(30, None)]
    assert SF._carried(flows).count() == 2
    more = SF.advance(flows, SF._waiting(frame(spark, [packet(30, 30), packet(31, 70)]), LIMITS), LIMITS)
    assert sorted((r.packets, r.closed_by) for r in more.collect()) == [(1, None), (31, "idle")]
    assert "Python" not in flows._jdf.queryExecution().executedPlan().toString()


def test_stream_flows_returns_every_flow_of_the_table(spark, sf):
    got = entry.queries()["stream_flows"](spark, sf).select("flow_uid", "packets", "bytes", "start_us", "end_us")
    batch = FL.assign_flows(X.packets(spark, sf, sections=False), X.LIMITS).groupBy("flow_uid").agg(
        F.count(F.lit(1)), F.sum("len"), F.min("ts_us"), F.max("ts_us"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_chunks_are_separate(spark, tmp_path):
    write_files(spark, str(tmp_path), [[packet(0, 0), packet(1, 1)], [packet(0, 0), packet(1, 1)]])  # numbered alike
    stream = R.stream_packets(spark, f"{tmp_path}/in", 1).withColumn("chunk", F.col("_metadata.file_name"))
    handle = SJ.chunk_handler(lambda a: a.groupBy("flow_uid").agg(F.count(F.lit(1)).alias("n")), LIMITS)
    for _ in range(2):  # a second run finds nothing new
        SJ.start(stream, handle, f"{tmp_path}/out", f"{tmp_path}/cp", None, "parquet").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [r.n for r in got] == [2, 2] and len({r.flow_uid for r in got}) == 2
    with pytest.raises(ValueError):
        handle(spark.read.parquet(f"{tmp_path}/in"))


def test_log_stream(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    open(f"{tmp_path}/in/a.log", "w").write("[1704067200] 1.2.3.4 gogle.com. A IN\nnoise\n")
    open(f"{tmp_path}/in/b.log", "w").write("[1704067200] 1.2.3.4 amazzon.com. A IN\n")
    protected = spark.createDataFrame([("google.com", 0), ("amazon.com", 1)], "domain string, position bigint")
    SJ.start(R.stream_log(spark, f"{tmp_path}/in", 1), SJ.typo_handler(None, protected, 0.8), f"{tmp_path}/out",
             f"{tmp_path}/cp", None).awaitTermination()
    got = spark.read.json(f"{tmp_path}/out").collect()
    assert {(r.domain, r.target) for r in got} == {("gogle.com", "google.com"), ("amazzon.com", "amazon.com")}
    assert all(r.detection_delay_seconds > 0 for r in got)


def test_delay_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    epoch = int(t0.timestamp())
    os.makedirs(f"{tmp_path}/log")
    os.makedirs(f"{tmp_path}/alerts")
    open(f"{tmp_path}/log/a.log", "w").write(
        f"[{epoch + 5}] 1.1.1.1 a.org. A IN\n[{epoch + 60}] 1.1.1.1 a.org. A IN\n[{epoch}] 1.1.1.1 b.org. A IN\n"
        f"[{epoch + 200000}] 1.1.1.1 z.org. A IN\n")
    open(f"{tmp_path}/alerts/a.log", "w").write(
        '{"detector": "dns_tunneling", "dns_domain_name": "A.org.", "detected_at": "2024-01-01T00:31:00"}\n'
        '{"detector": "DGA", "dns_domain_name": "b.org.", "detected_at": "2024-01-01T00:31:00"}\n'
        '{"detector": "DNS_TUNNELING", "dns_domain_name": "y.org.", "detected_at": "2024-01-04T00:31:00"}\n')
    # A later file holds an earlier detection, and one that makes the delay negative.
    open(f"{tmp_path}/alerts/b.log", "w").write(
        '{"detector": "DNS_TUNNELING", "dns_domain_name": "a.org.", "detected_at": "2024-01-01T00:20:00"}\n'
        '{"detector": "DNS_TUNNELING", "dns_domain_name": "z.org.", "detected_at": "2024-01-01T00:00:10"}\n'
        '{"detector": "DNS_TUNNELING", "dns_domain_name": "z.org.", "detected_at": "2024-01-05T00:00:00"}\n')
    for name, rows, handle in (("log", R.stream_log(spark, f"{tmp_path}/log", 1), SJ.seen_handler),
                               ("alerts", R.parse_alerts(spark.readStream.option("maxFilesPerTrigger", 1).text(f"{tmp_path}/alerts")),
                                SJ.detected_handler)):
        SJ.start(rows, handle, f"{tmp_path}/out-{name}", f"{tmp_path}/cp-{name}", None, "parquet").awaitTermination()
    got = SJ.delays_so_far(spark.read.parquet(f"{tmp_path}/out-log"), spark.read.parquet(f"{tmp_path}/out-alerts")).collect()
    assert [(r.domain, r.first_seen_at.second, r.first_detected_at.minute) for r in got] == [("a.org", 5, 20)]


@pytest.mark.parametrize("limits", [FlowLimits(activity_timeout=20, dns_activity_timeout=5, max_flow_duration=10**9, teardown=False)])
def test_idle_sessions_equal_the_assignment(spark, limits):
    df = frame(spark, [p for g in traffic() for p in g])
    a = FL.assign_flows(df, limits).groupBy("flow_uid").agg(F.min("ts_us"), F.max("ts_us"), F.count(F.lit(1)))
    s = SF.idle_sessions(df, limits).select("start_us", "end_us", "packets")
    assert sorted(tuple(r)[1:] for r in a.collect()) == sorted(map(tuple, s.collect()))
