import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from dnsq.llm import packing
from dnsq.llm.queries import tokenizer_path
from dnsq.llm.tokens import Words

from .helpers import prose, table

import pyarrow as pa

ODD = ["", None, "it's I'll don't 'S !'s", "Ünï ÇÃ ß ẞ İstanbul ΑΣ ΣΑΣ", "a b c d́ ́x", "<|endoftext|>x a<|startoftext|>",
       "x²½ 1234 ٣٤ 你好 日本語", "\x00\x01 \x1c\x1d a\x0bb\x0cc\r\nd", "!!! a.b.c... -- 'tis 's", "é e ́", "ﬁ ǅ ŉ Å", "a" * 5000]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(tokenizer_path())


def test_words_give_the_ids_of_whole_texts(whole):
    words = Words(tokenizer_path())
    texts = [*ODD, prose(1, 300), "One. Two! Three? " + prose(2, 50)]
    ids, starts, ends, closes = words.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids
    assert closes.sum() >= 3 and len(ends) == len(closes)


def brute_cost(at, penalty, width):
    best = [0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = min(best[i] + width - (at[j] - at[i]) + penalty[j] for i in range(j) if at[j] - at[i] <= width)
    return best[-1]


def test_cuts_are_the_cheapest():
    r = np.random.default_rng(5)
    for _ in range(30):
        at = np.concatenate(([0], np.cumsum(r.integers(1, 11, 60))))
        penalty = r.choice([0, 3, 7], 61)
        cuts = packing.best_cuts(at, penalty, 20, closed=True)
        edges = [0, *at[cuts]]
        cost = sum(20 - (b - a) for a, b in zip(edges, edges[1:])) + sum(penalty[c] for c in cuts)
        assert cuts[-1] == 60 and max(np.diff(edges)) <= 20 and cost == brute_cost(at, penalty, 20)


@pytest.mark.parametrize("block", [500, 1_000_000])
def test_every_id_lies_in_one_piece(spark, whole, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", block)
    texts = [*ODD, *(". ".join(prose(j, 8) for j in range(i, i + i % 40)) for i in range(60)), prose(7, 2500)]
    df = table(spark, texts, clash=True)
    got = packing.pack(df, tokenizer_path(), width=256).toPandas()
    full = {i: np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, t in enumerate(texts)}
    assert set(got.doc_id) == set(full)
    for i, g in got.sort_values("start").groupby("doc_id"):
        assert b"".join(g.ids) == full[i].tobytes() and set(g.doc_tokens) == {len(full[i])}
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]]
    sums = got.groupby("sequence_id").length.sum()
    assert sums.max() <= 256 and 1 - sums.sum() / (256 * len(sums)) < 0.08
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    assert all(len(x) == 4 * n for x, n in zip(got.ids, got.length))
    assert zlib.crc32(got.ids[0]) >= 0


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = table(spark, [(None, "one two", "en", "s", 0), (1, "x", "en", "s", 0), (1, "x", "en", "s", 0)])
    got = packing.pack(df, tokenizer_path()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 1), (True, 0)]
    assert packing.pack(table(spark, []), tokenizer_path()).count() == 0
