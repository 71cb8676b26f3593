import datetime

import json

import pytest

from dnsq.operators import domains as DO, flow_features as FF, flows as FL
from dnsq.sources import readers as R, sinks as S
from tests.test_flows import dns, frame, packet


@pytest.fixture
def path(tmp_path):
    return str(tmp_path)


def test_packets_round_trip(spark, path):
    frame(spark, [packet(0, 0), packet(1, 1, transport="ICMP")]).write.parquet(f"{path}/p")
    df = R.read_packets(spark, f"{path}/p")
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(ip_version,4)" in plan


def test_flow_table(spark, path):
    assert R.read_flow_table(spark, f"{path}/missing", ["a"]).columns == ["a"]
    assert R.read_flow_table(spark, f"{path}/missing").count() == 0
    (open(f"{path}/f.csv", "w")).write("a,b\n1,x\n")
    assert R.read_flow_table(spark, f"{path}/f.csv").first().asDict() == {"a": "1", "b": "x"}


def test_alert_log(spark, path):
    lines = [json.dumps({"detector": "DGA", "score": 0.5, "scores": {"dga": 0.5}}), "", "  ", "{broken", "[1]",
             json.dumps({"detector": "DNS_TUNNELING", "missing_feature_columns": ["x"], "other": 1})]
    open(f"{path}/a.jsonl", "w").write("\n".join(lines))
    rows = R.read_alerts(spark, f"{path}/a.jsonl").collect()
    assert sorted(r.detector for r in rows if r.detector) == ["DGA", "DNS_TUNNELING"]
    assert len([r for r in rows if r.detector]) == 2


def test_lists(spark, path):
    open(f"{path}/l.txt", "w").write("B.org \n\n a.org\nb.org\n")
    assert [r.domain for r in R.read_domain_list(spark, f"{path}/l.txt").collect()] == ["b.org", "a.org", "b.org"]
    got = R.read_protected_list(spark, f"{path}/l.txt").orderBy("position").collect()
    assert [(r.domain, r.position) for r in got] == [("b.org", 0), ("a.org", 1), ("b.org", 2)]
    open(f"{path}/e.txt", "w").write("\n \n")
    for read in (R.read_domain_list, R.read_protected_list):
        with pytest.raises(ValueError):
            read(spark, f"{path}/e.txt")
    open(f"{path}/r.csv", "w").write("2,B.com\n1,A.com\n3,C.com\n")
    assert [r.domain for r in R.read_ranked_list(spark, f"{path}/r.csv", 2).collect()] == ["a.com", "b.com"]


def test_labelled_and_stacked(spark, path):
    open(f"{path}/d.csv", "w").write("Domain,class\nx.com,dga\n")
    assert R.read_labelled_domains(spark, f"{path}/d.csv").first()["class"] == "dga"
    open(f"{path}/p.csv", "w").write("target_domain,query_domain,classification\na,b,none\n")
    assert R.read_labelled_pairs(spark, f"{path}/p.csv").first().classification == "none"
    open(f"{path}/b.csv", "w").write("label,x\nBenign,1\n")
    open(f"{path}/m1.csv", "w").write("x,label,y\n2,Attack,9\n")
    both = R.read_flow_dataset(spark, f"{path}/b.csv", f"{path}/m*.csv")
    assert sorted((r.label, r.x, r.y) for r in both.collect()) == [("Attack", "2", "9"), ("Benign", "1", None)]
    assert [r.x for r in R.first_rows(both, ["x"], 1).collect()] == ["1"]


def test_flow_csv(spark, path):
    rows = [dns(0, 0, qnames=["www.x.org."]), packet(1, 1), packet(2, 2), packet(3, 9, sport=5)]
    table = FF.flow_features(FL.assign_flows(frame(spark, rows)))
    S.write_flow_csv(table.coalesce(1), f"{path}/f", places=4, max_rows=2)
    back = spark.read.option("header", True).csv(f"{path}/f")
    got = {r.protocol: r for r in back.collect()}
    assert got["HTTP"].dns_domain_name == "not a dns flow" and got["DNS"].dns_domain_name == "www.x.org."
    assert got["DNS"].handshake_duration == "not a tcp connection"
    assert got["HTTP"].handshake_duration == "not a complete handshake"
    assert json.loads(got["DNS"].bi_gram_domain_name)[0] == "ww" and got["DNS"].duration == "0.0000"
    assert len(list((__import__("pathlib").Path(path) / "f").glob("*.csv"))) == 2
    picked = S.select_columns(table, reference=["protocol", "not_there", "duration"], ignore=["duration"])
    assert picked.columns == ["protocol", "not_there"] and picked.first().not_there is None
    assert S.header_of(spark, f"{path}/f")[:2] == ["flow_uid", "flow_id"]


def test_small_sinks(spark, path):
    top = DO.top_domains(spark.createDataFrame([("b", 1), ("a", 3)], "domain string, n bigint"))
    S.write_domain_list(top, f"{path}/top")
    assert [r.value for r in spark.read.text(f"{path}/top").collect()] == ["a", "b"]
    S.write_report(top, f"{path}/rep")
    assert spark.read.option("header", True).csv(f"{path}/rep").count() == 2
    for _ in range(2):
        S.write_alerts(top, f"{path}/alerts")
        S.append_rows(top, f"{path}/rows")
    assert spark.read.json(f"{path}/alerts").count() == spark.read.parquet(f"{path}/rows").count() == 4
    S.write_scored(top, f"{path}/s", "csv")
    S.write_scored(top, f"{path}/sp")
    assert spark.read.parquet(f"{path}/sp").count() == 2 and spark.read.csv(f"{path}/s").count() >= 2


def test_packet_files_numbered_alike(spark, tmp_path):
    from dnsq.operators.flows import FlowLimits, assign_flows
    from dnsq.sources import schemas

    def packet(no, second, port):
        row = dict.fromkeys(schemas.PACKET.fieldNames())
        row.update(pkt_no=no, ts=datetime.datetime(2024, 1, 1, 0, 0, second), ip_version=4, transport="TCP", src_ip="10.0.0.1",
                   dst_ip="10.0.0.2", src_port=port, dst_port=80, len=60, tcp_flags=16, seq=1, ack=1)
        return tuple(row[c] for c in schemas.PACKET.fieldNames())

    # The second file goes on with the first one's flow and has one of its own; both number from 0.
    for name, rows in (("a", [packet(0, 0, 1000), packet(1, 1, 1000)]), ("b", [packet(0, 2, 1000), packet(1, 3, 2000)])):
        spark.createDataFrame(rows, schemas.PACKET).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    packets = R.read_packets(spark, f"{tmp_path}/*")
    assert packets.columns == schemas.PACKET.fieldNames()
    assert sorted(r.pkt_no for r in packets.collect()) == [0, 1, R.FILE_PACKETS, R.FILE_PACKETS + 1]
    flows = assign_flows(packets, FlowLimits()).groupBy("flow_uid").count().collect()
    assert sorted(r["count"] for r in flows) == [1, 3]
    assert sorted(r.pkt_no for r in R.read_packets(spark, f"{tmp_path}/a").collect()) == [0, 1]


def test_broken_bytes_are_dropped(spark, tmp_path):
    from dnsq.operators.domains import parse_queries

    lines = [b"[1] 1.2.3.4 exa\xffmple.com. A IN", "[2] 1.2.3.4 good.com. A IN �".encode(), b"\xc3(", b"\xe2\x82", "é".encode()]
    (tmp_path / "x.log").write_bytes(b"\n".join(lines) + b"\n")
    got = sorted(r.value for r in R.read_log(spark, f"{tmp_path}/x.log").collect())
    assert got == sorted(x.decode("utf-8", "ignore") for x in lines)
    names = {r.qname for r in parse_queries(R.read_log(spark, f"{tmp_path}/x.log")).collect()}
    assert names == {"example.com", "good.com"}
