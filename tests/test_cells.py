"""Cells of blocks and slices: every slice is prepared once for all blocks, scores found before bound those after."""

import random

import numpy as np
import pyarrow as pa
import pytest

from dnsq.functions.search import List, levenshtein_batch
from dnsq.functions.similarity import lcs_batch
from dnsq.operators import matching as M


def words(seed, n, low=0, high=12):
    r = random.Random(seed)
    return ["".join(r.choice("abcdé-.") for _ in range(r.randrange(low, high))) for _ in range(n)]


def test_bit_steps_equal_the_tables():
    """Names and queries around the 64 letters that fit a word, empty ones and letters that the list lacks."""
    listed = [*words(1, 60), *words(2, 30, 60, 70), "", "a" * 64, "a" * 65, "a" * 200]
    queries = [*words(3, 20), *words(4, 10, 62, 67), "", "zzz", "a" * 63, "a" * 64, "a" * 65]
    pairs = [(q, t) for q in range(len(queries)) for t in range(len(listed))]
    random.Random(5).shuffle(pairs)
    q, t = np.array(pairs).T
    prepared, texts = List(listed), ([listed[b] for _, b in pairs], [queries[a] for a, _ in pairs])
    assert prepared.common(queries, q, t).tolist() == lcs_batch(*texts).tolist()
    assert prepared.edits(queries, q, t).tolist() == levenshtein_batch(*texts).tolist()


def test_a_score_to_reach_changes_no_result():
    listed = list(dict.fromkeys(words(6, 300, 3)))
    queries = list(dict.fromkeys(words(7, 40, 3)))
    prepared = List(listed)
    place, score = prepared.most_alike(queries, 5)
    again = prepared.most_alike(queries, 5, score[:, -1])
    assert again[0].tolist() == place.tolist() and again[1].tolist() == score.tolist()
    place, score = prepared.best_linear(queries)
    again = prepared.best_linear(queries, score[:, 0])
    assert again[0].tolist() == place.tolist() and again[1].tolist() == score.tolist()


def test_a_cell_prepares_each_slice_once(monkeypatch):
    made = []
    monkeypatch.setattr(M, "List", lambda names: made.append(len(names)) or List(names))
    listed = words(8, 30, 3)
    rows = [(0, words(9 + i, 4, 3), [float("-inf")] * 4, None) for i in range(5)]
    rows += [(0, listed[i : i + 10], None, list(range(i, i + 10))) for i in (0, 10, 20)]
    batch = pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.string())),
        pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
        names=["cell", "names", "needed", "positions"])
    out = list(M._searched(3, False)(iter([batch])))
    assert made == [10, 10, 10]
    whole = List(listed)
    for r, b in zip(rows, out):
        place, _ = whole.most_alike(r[1], 3)
        assert [[x["position"] for x in best] for best in b.column(1).to_pylist()] == place.tolist()


@pytest.mark.parametrize("across", [1, 4])
def test_many_slices_give_the_matches_of_one(spark, monkeypatch, across):
    listed = list(dict.fromkeys(words(20, 200, 3)))
    queries = list(dict.fromkeys(words(21, 90, 3)))
    monkeypatch.setattr(M, "SLICE", 10)
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "CELL_BLOCKS", across)
    monkeypatch.setattr(M, "CELL_SLICES", 3)
    q = spark.createDataFrame([(x,) for x in queries], "qname string")
    p = spark.createDataFrame([(x, i) for i, x in enumerate(listed)], "domain string, position bigint")
    place, _ = List(listed).most_alike(queries, 15)
    want = {(n, int(t), j + 1) for n, ts in zip(queries, place) for j, t in enumerate(ts)}
    assert {(r.qname, r.position, r.cand_no) for r in M.top_candidates(q, p, 15).collect()} == want
    best, _ = List(listed).best_linear(queries)
    got = {r.qname: r.target for r in M.best_match(q, p).collect() if r.target is not None}
    assert got == {n: listed[t] for n, (t,) in zip(queries, best) if n in got} and len(got) > 80


def moved(spark, monkeypatch):
    """What cells take in: (first name, number of names, whether it is a slice, whether it comes with a block) per row."""
    def seen(k, linear):
        def run(batches):
            for b in batches:
                for names, needed, positions in zip(*(b.column(c).to_pylist() for c in (1, 2, 3))):
                    best = [{"score": float(needed is not None), "position": len(names), "target": str(positions is not None)}]
                    yield pa.RecordBatch.from_arrays([pa.array([names[0]]), pa.array([best], pa.list_(pa.struct([
                        ("score", pa.float64()), ("position", pa.int64()), ("target", pa.string())])))], names=["qname", "best"])

        return run

    monkeypatch.setattr(M, "_searched", seen)
    monkeypatch.setattr(M, "SLICE", 10)
    monkeypatch.setattr(M, "BROADCAST_SLICES", 0)
    q = spark.createDataFrame([(f"q{i}",) for i in range(40)], "qname string")
    p = spark.createDataFrame([(f"t{i:03}", i) for i in range(200)], "domain string, position bigint")
    return M.top_candidates(q, p, 100).collect()


def test_the_list_moves_once(spark, monkeypatch):
    """Not once per salt: 200 names in 20 slices meet 40 names in one block."""
    slices = [r for r in moved(spark, monkeypatch) if r.target == "True"]
    assert sum(r.position for r in slices) == 200 and len(slices) == 20


def test_a_row_holds_a_block_or_a_slice(spark, monkeypatch):
    """A batch of rows is as large as its names and slices, not their product."""
    rows = moved(spark, monkeypatch)
    assert rows and all((r.target == "True") == (r.ratio == 0.0) for r in rows)
