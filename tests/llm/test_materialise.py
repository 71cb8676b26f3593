import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from dnsq.llm import materialise as M
from dnsq.llm.queries import tokenizer_path

from .helpers import prose, table


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_slots_are_a_permutation_that_depends_on_the_key(n):
    a, b = M.slots(np.arange(n), n, 1), M.slots(np.arange(n), n, 2)
    assert sorted(a.tolist()) == list(range(n)) == sorted(b.tolist())
    assert n < 17 or ((a != b).any() and (a != np.arange(n)).any())
    assert (M.slots(np.arange(n)[::-1], n, 1) == a[::-1]).all()


def test_shards_hold_all_tokens_in_slot_order(spark, tmp_path):
    texts = [None, "", *(prose(i, 5 + 9 * i) for i in range(30)), "x", "x"]
    rows, path = M.materialise(table(spark, texts, clash=True), tokenizer_path(), key=7, path=str(tmp_path / "out"), length=64,
                               shard_sequences=8)
    got = sorted(rows.collect())
    n = len(got)
    assert [r.slot for r in got] == list(range(n)) and sorted(r.sequence for r in got) == list(range(n))
    read = list(M.read_slots(path, 0, n, length=64, shard_sequences=8))
    assert [zlib.crc32(x.tobytes()) for x in read] == [r.ids_crc32 for r in got]
    assert all((r.shard, r.byte_offset) == (r.slot // 8, r.slot % 8 * 128) for r in got)
    resumed = list(M.read_slots(path, 11, 5, length=64, shard_sequences=8))
    assert [x.tolist() for x in resumed] == [x.tolist() for x in read[11:16]]
    whole = Tokenizer.from_file(tokenizer_path())
    want = sorted(tuple(whole.encode(t or "", add_special_tokens=False).ids) for t in texts)
    stream = np.concatenate([x for _, x in sorted(zip((r.sequence for r in got), read))]).tolist()
    docs, at = [], []
    for i in stream:
        if i == M.END:
            docs.append(tuple(at))
            at = []
        elif i != M.PAD or at:
            at.append(i)
    assert sorted(tuple(x for x in d if x != M.PAD) for d in docs) == want
    again, second = M.materialise(table(spark, texts), tokenizer_path(), key=7, path=str(tmp_path / "two"), length=64, shard_sequences=8)
    assert second != path and again.count() == n


def test_empty_table(spark, tmp_path):
    rows, _ = M.materialise(table(spark, []), tokenizer_path(), key=1, path=str(tmp_path / "out"))
    assert rows.count() == 0
