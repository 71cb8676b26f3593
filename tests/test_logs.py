import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from dnsq.functions import logs as L, times
from dnsq.operators import domains as DO


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "value string").select(column(F.col("value"))).first()[0]


def test_four_patterns_and_order(spark):
    cases = {
        "[1] unbound: 10.0.0.1 www.example.com. A IN": "www.example.com",
        "query: www.Example.com. x": "www.example.com",
        "query[AAAA] a.b.c. from": "a.b.c",
        "QNAME host.example. z": "host.example",
        # The greedy name needs a literal dot after it, so a name without a final one loses its last label.
        "query: www.example.com IN A": "www.example",
        # The first pattern in order wins, not the leftmost match.
        "query: second.example. query[A] first.example. ": "first.example",
        "QUERY: UPPER.example. ": "upper.example",
        "nothing here": None,
        "query: ... x": None,
    }
    for line, want in cases.items():
        assert one(spark, line, L.qname) == want, line


def test_client_and_time(spark):
    assert one(spark, "from 999.1.2.3 port", L.client) == "999.1.2.3"
    assert one(spark, "no address", L.client) is None
    assert one(spark, "query[123] x [456.5]", L.log_epoch) == 123.0
    assert one(spark, "[456.5]", L.log_epoch) == 456.5
    assert one(spark, "[abc]", L.log_epoch) is None


def test_domains(spark):
    assert one(spark, "  WWW.Example.COM... ", L.normalise_domain) == "www.example.com"
    assert one(spark, "a.b.c.d", L.base_domain) == "c.d"
    assert one(spark, "localhost.", L.base_domain) == "localhost"
    assert one(spark, "", L.canonical_name) is None
    assert one(spark, "x.y", L.canonical_name) == "x.y."
    assert one(spark, "x.y.", L.canonical_name) == "x.y."


def test_lines_need_client_for_detectors_only(spark):
    lines = spark.createDataFrame([("query: a.b. x",), ("1.2.3.4 query: a.b. x",)], "value string")
    assert DO.parse_queries(lines).count() == 1
    assert DO.parse_queries(lines, need_client=False).count() == 2


def test_top_n(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "domain string, n bigint")
    assert [r.domain for r in DO.top_domains(counts, 2).collect()] == ["c", "a"]
    assert DO.top_domains(counts, 0).count() == 3
    assert DO.top_domains(counts, None).count() == 3


def test_times(spark):
    assert one(spark, "1704067200", times.normalise_time) == "2024-01-01T00:00:00.000000"
    assert one(spark, "2024-01-01 10:00:00.5", times.normalise_time) == "2024-01-01T10:00:00.500000"
    assert one(spark, " ", times.normalise_time) is None
    assert one(spark, "yesterday", times.normalise_time) == "yesterday"
    row = spark.sql("select timestamp'2024-01-01 00:00:01' as a, timestamp'2024-01-01 00:00:00' as b, "
                    "cast(null as timestamp) as n")
    got = row.select(times.delay_seconds(F.col("a"), F.col("b")), times.delay_seconds(F.col("b"), F.col("a")),
                     times.delay_seconds(F.col("a"), F.col("n"))).first()
    assert list(got) == [None, 1.0, None]


pieces = st.lists(st.sampled_from(["a", "B-", "x.", ".", "..", " ", "  ", "\t", "A", "IN", "in", "info", "1", "10.", "2.3", "_", "[", "é", ":"]), max_size=14)


@settings(max_examples=3000, deadline=None)
@given(pieces)
def test_fast_patterns_match_the_same(parts):
    line = "".join(parts)

    def normalised(pattern):
        m = re.search(pattern, line, re.ASCII)
        return m and m.group(1).lower().rstrip(".")

    assert normalised(L._FAST_QNAME[3]) == normalised(L.QNAME_PATTERNS[3])
    assert normalised(L._FAST_CLIENT) == normalised(L.CLIENT_PATTERN)


def test_many_lines_as_by_hand(spark):
    """The four patterns one after the other over mixed lines."""
    import random

    rng = random.Random(3)
    bits = ["query[A] a.b. ", "query: c.d. ", "QNAME e.f. ", "g.h. A IN ", "10.0.0.1 ", "noise ", "i.j ", "query:k. ", "info: ", "... A IN "]
    lines = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def by_hand(line):
        for p in L.QNAME_PATTERNS:
            m = re.search(p, line)
            if m:
                return m.group(1).lower().rstrip(".") or None
        return None

    df = spark.createDataFrame([(x,) for x in lines], "value string").select("value", L.qname(F.col("value")).alias("q"))
    for r in df.collect():
        assert r.q == by_hand(r.value), r.value
