"""The pipeline against plain Python, stage by stage over the smallest tables, and on a table of awkward rows."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from dnsq.llm import language
from dnsq.llm.common import held_out, written
from dnsq.llm.queries import QUERIES, tokenizer_path

from .helpers import groups, prose, table
from .test_decontaminate import brute as hits_of
from .test_line_dedup import brute as lines_of

SF = "/root/testdata/sf0.001"


def as_rows(docs):
    return sorted((tuple(r) for r in docs.collect()), key=repr)


def check_stages(spark, docs, sf_dir):
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    data = [(r.doc_id, r.text) for r in docs.collect()]
    langs, logs = language.train(docs.filter(~held_out("doc_id")))
    best = language.shares([t for _, t in data], logs).max(axis=1) if langs and data else [0] * len(data)
    data = [d for d, s in zip(data, best) if s > 0]
    docs = written(C.STAGES[0][1](spark, docs, sf_dir), "a")
    assert docs.columns == columns and as_rows(docs.select("doc_id", "text")) == sorted(data, key=repr)

    want = lines_of(data)
    data = [(i, want[(i, t)][2] if t is not None or want[(i, t)][1] else t) for i, t in data]
    docs = written(C.STAGES[1][1](spark, docs, sf_dir), "b")
    assert docs.columns == columns and as_rows(docs.select("doc_id", "text")) == sorted(data, key=repr)

    data = sorted(set(data), key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    first, sizes = groups([t for _, t in data])
    data = [d for i, d in enumerate(data) if first[i] == i]
    docs = written(C.STAGES[2][1](spark, docs, sf_dir), "c")
    assert docs.columns == columns and as_rows(docs.select("doc_id", "text")) == sorted(data, key=repr)

    found = hits_of(data, items)
    data = [d for d, (_, n, hit, _) in zip(data, found) if not (hit and 20 * hit >= n)]
    docs = written(C.STAGES[3][1](spark, docs, sf_dir), "d")
    assert docs.columns == columns and as_rows(docs.select("doc_id", "text")) == sorted(data, key=repr)

    whole = Tokenizer.from_file(tokenizer_path())
    pieces = C.STAGES[4][1](spark, docs, sf_dir).toPandas()
    want = sorted(b"".join([np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()]) for _, t in data)
    got = []
    for _, g in pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.length.sum() <= 2048
    for r in pieces.sort_values(["sequence_id", "offset"]).itertuples():
        got[-1:] = [got[-1] + r.ids] if r.start else [*got[-1:], r.ids]
    assert sorted(got) == want


def test_five_stages():
    assert [name for name, _ in C.STAGES] == [
        "language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_given_tables(spark):
    check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows(spark, tmp_path, empty):
    line = "This line comes back in very many documents of the table"
    texts = [] if empty else [None, "", "12 !!", *(f"{prose(i, 30)} abc\n{line}" for i in range(8)), prose(1, 30) + " abc", prose(1, 30) + " abc"]
    data = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, t, "en", "s", 0) for t in texts[3:4]]
    item = spark.createDataFrame([(1, prose(5, 20))], "item_id long, text string")
    item.write.parquet(f"{tmp_path}/benchmark.parquet")
    check_stages(spark, table(spark, data), str(tmp_path))


def test_run_is_the_stages_in_a_row(spark):
    assert C.run(spark, SF).columns[:3] == ["doc_id", "start", "length"]
    assert set(QUERIES) == {f"op{n}_{x}" for n, x in (
        (1, "decontaminate"), (2, "pii"), (3, "quality_rules"), (4, "training_order"), (5, "packing"), (6, "toxicity"),
        (7, "line_dedup"), (8, "language"), (9, "url_reputation"), (10, "jaccard_join"), (11, "filter_audit"),
        (12, "chat_format"), (13, "vector_codes"))}
