import math

import numpy as np
import pytest

from dnsq.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, q string, size long, code string, error string, id long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, y, "x", 1, "c", "e", 2) for i, v, y in rows], SCHEMA).repartition(parts)


def brute(rows, parts=8, entries=16, rounds=6):
    """Codes and codebooks with every distance computed."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], y) for i, v, y in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], np.array(r[1], dtype=np.int32).tobytes()))
    w = len(kept[0][1]) // parts
    cut = [[tuple(q[p * w : (p + 1) * w]) for p in range(parts)] for _, q, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def near(p, v):
        return min((gap(v, e), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(near(p, c[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(mine[k]) for x in zip(*mine[k])) if k in mine else e for k, e in enumerate(books[p])]
    coded, by_label = [], {}
    for (i, _, y), c in zip(kept, cut):
        best = [near(p, c[p]) for p in range(parts)]
        coded.append((i, y, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
        by_label[y] = by_label.get(y, 0) + coded[-1][3]
    return sorted(((*r, by_label[r[1]]) for r in coded), key=repr), np.array(books)


def vectors(seed, n, dim=64, spread=0.1):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.15, (6, dim))
    return [(i, (centres[i % 6] + r.normal(0, spread, dim)).astype(np.float32).tolist(), i % 4) for i in range(n)]


def check(spark, rows, want_rows=None):
    coded, books = V.compress(frame(spark, rows))
    want, want_books = brute(rows if want_rows is None else want_rows)
    assert sorted(map(tuple, coded.collect()), key=repr) == want
    assert books.tolist() == want_books.tolist()


def test_like_all_distances(spark):
    rows = vectors(1, 150)
    rows += [(200, None, 1), (201, [], 1), (202, [float("nan")] * 64, 1), (203, [0.0] * 63 + [None], 1), (204, [math.inf] * 64, 1),
             (205, rows[3][1], None), (206, rows[3][1], None), (207, rows[4][1], 3), (208, [0.0] * 64, 3), (None, rows[5][1], 9)]
    check(spark, rows)


def test_repeated_ids_and_few_vectors(spark):
    check(spark, [(5, v, y) for _, v, y in vectors(2, 20, 16)])
    check(spark, vectors(3, 7, 8, 1.0))
    check(spark, [(i, [1.0] * 8, None) for i in range(40)])


def test_other_lengths_are_dropped(spark):
    rows = vectors(4, 30, 16)
    check(spark, rows + [(-1, [1.0] * 15, 1), (50, [1.0] * 24, 1), (51, [20_000.0] + [0.0] * 15, 1)], rows)


def test_empty_table(spark):
    for rows in ([], [(1, None, 2)], [(1, [1.0] * 3, 2)]):
        coded, books = V.compress(frame(spark, rows))
        assert coded.count() == 0 and books.size == 0
        assert len(V.digest(books)) == 64


@pytest.mark.parametrize("bits", [0, 3, 7, 9, 11, 20])
def test_cells_leave_the_nearest_entry(bits):
    r = np.random.default_rng(bits)
    books = r.integers(-900, 900, (2, 16, 8))
    books[0, 5] = books[0, 3]  # ties
    cells = V.Cells(books, bits)
    q = r.integers(-900, 900, (700, 16))
    q[:20, :8] = books[0, :1]
    for _ in range(2):  # the second time from memory
        codes, gaps = cells.assign(q)
        d = ((q.reshape(-1, 2, 1, 8) - books) ** 2).sum(axis=3)
        assert codes.tolist() == d.argmin(axis=2).tolist() and gaps.tolist() == d.min(axis=2).tolist()
    assert cells.compared <= 2 * 700 * 2 * 16
    if bits == 7:
        assert cells.compared < 2 * 700 * 2 * 8


def test_equal_hashes_of_different_cells():
    r = np.random.default_rng(8)
    books = r.integers(-900, 900, (1, 16, 8))
    cells = V.Cells(books, 6)
    cells.factors = np.zeros(8, dtype=np.uint64)  # all cells have one hash
    q = r.integers(-900, 900, (300, 8))
    codes, _ = cells.assign(q)
    cells.assign(q[::-1])
    assert codes[:, 0].tolist() == ((q[:, None] - books[0]) ** 2).sum(axis=2).argmin(axis=1).tolist()
    assert cells.assign(q[::-1])[0][:, 0].tolist() == codes[::-1, 0].tolist()
