import hashlib
from collections import defaultdict

import numpy as np
import pytest

from dnsq.llm import line_dedup
from dnsq.llm.queries import QUERIES

from .helpers import FOLD, prose, table

LONG = "This line is long enough to count as a repeated one"


def brute(data, min_chars=40, min_docs=5):
    """By distinct pair of id and text."""
    docs = set(data)

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)

    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add((i, t))
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = []
        for line in lines:
            h = holders.get(key(line), ())
            known = [x for x, _ in h if x is not None]
            stays = len(h) < min_docs or (i == max(known) if known else i is None)
            if stays:
                keep.append(line)
        out[(i, t)] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def check(spark, data, clash=False):
    df = table(spark, [(i, t, "en", "s", 0) for i, t in data], clash=clash)
    got = line_dedup.drop_repeated_lines(df).collect()
    assert len(got) == len(data)
    want = brute(data)
    by_id = defaultdict(list)
    for (i, _), v in want.items():
        by_id[i].append(v)
    for r in got:
        assert (r.n_lines, r.n_dropped, r.text or "") in by_id[r.doc_id]


def test_planted_lines_and_awkward_rows(spark):
    data = [(i, f"{prose(i, 8)}\n  {LONG.upper() if i % 2 else LONG}\t\n{prose(i, 3)}") for i in range(7)]
    data += [(i, f"{LONG} four times only\nx") for i in range(20, 24)]
    data += [(30, None), (31, ""), (32, "\n\n"), (33, f"{LONG}\n{LONG}\n{LONG}"), (34, "é" * 39 + "\n" + "é" * 40)]
    data += [(i, "é" * 40 + "\r\n" + "ß" * 50) for i in range(40, 45)]
    data += [(50, "\n".join([LONG, *(prose(j, 12) for j in range(3000))]))]
    check(spark, data)
    check(spark, data, clash=True)


def test_repeated_rows_and_null_ids(spark):
    check(spark, [(1, LONG)] * 9 + [(2, LONG)])
    check(spark, [(i, LONG) for i in range(5)] + [(4, LONG + "\n" + "y")] + [(None, LONG)])
    check(spark, [(None, f"{LONG}\n{i}") for i in range(6)])


def test_empty_table(spark):
    out = line_dedup.drop_repeated_lines(table(spark, []))
    assert out.count() == 0 and out.columns[-2:] == ["n_lines", "n_dropped"]


@pytest.mark.parametrize("limits", [{"BROADCAST_BLOCKS": 0}, {"BROADCAST_BLOCKS": 0, "FEW_HASHES": 0}, {"FEW_KEYS": 0},
                                    {"BROADCAST_BLOCKS": 0, "FEW_KEYS": 0}])
def test_beyond_the_limits(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(line_dedup, name, value)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, [(i, f"{LONG}\n{prose(i, 20)}\n{LONG.upper()}  \nshort") for i in range(30)] + [(None, LONG), (77, None), (78, "")], clash=True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_documents_and_lines_stay_where_they_are(spark, monkeypatch):
    """Without automatic broadcasts: documents pass without an exchange, and only hashes meet a large filter."""
    docs = table(spark, [(i, f"{LONG}\n{prose(i, 20)}", "en", "s", 1) for i in range(30)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in line_dedup.drop_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(line_dedup, "BROADCAST_BLOCKS", 0)
        base = docs.selectExpr("doc_id as id", "text")
        suspects, plain = line_dedup._suspects(base, 40)
        assert plain and "BroadcastHashJoin [h" in suspects._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_filter_misses_no_repeat_and_suspects_few(spark):
    values = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    df = spark.createDataFrame([(int(v),) for v in [*values, *values[:500]]], "h long").repartition(4)
    blocks = 20_500 * line_dedup.BITS_PER_LINE // line_dedup.BLOCK_BITS + 1
    bits = {r.block: np.array(r.words).view(np.uint64) for r in line_dedup.repeated_bits(df, blocks).collect()}

    def has(h):
        places = line_dedup._bits(np.array([h]).view(np.uint64), blocks)
        at = [(int(p[0]) // line_dedup.BLOCK_BITS, int(p[0]) % line_dedup.BLOCK_BITS) for p in places]
        return all(b in bits and (int(bits[b][i >> 6]) >> (i & 63)) & 1 for b, i in at)

    assert all(has(v) for v in values[:500])
    # A key that comes once is suspected if other keys have set both its bits, each with a chance of at most
    # 2 bits / BITS_PER_LINE.
    assert sum(has(v) for v in values[500:]) < (2 / line_dedup.BITS_PER_LINE) ** 2 * 19_500


def test_query_hashes_what_is_kept(spark, sf):
    got = QUERIES["op7_line_dedup"](spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute(list(docs.items()))
    assert len(got) == len(docs)
    for r in got:
        n, dropped, text = want[(r.doc_id, docs[r.doc_id])]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"


