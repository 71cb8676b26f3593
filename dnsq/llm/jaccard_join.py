"""Documents linked by the Jaccard similarity of their word shingles, exactly, and the groups they form.

Method: vertical partitioning. Shingles are 64-bit hashes, and the order of all hashes is cut into fragments. Every
fragment is handled apart and gives partial numbers, which are summed per document or per pair:

1. Shared shingles. In the first `SHARE` of the order, each fragment tells which shingles lie in two documents.
   A document of n shingles that links with another lacks at most (1 - t) n of the other's, so one with more
   unshared shingles than that in these fragments links with nothing and is left out. Documents with equal sets
   become one class, which one document stands for.
2. Candidates. Fragments count, for the classes left, in how many classes each shingle lies. By (count, hash),
   rarest first, two linked classes share one of their first n - ceil(t n) + 1 shingles. Classes that have
   such a shingle in common form a list.
3. Overlaps. How many lists two linked classes must have in common follows from their sizes, so the first of them is
   among the first few of either. A short list gives the pairs that this allows; in a long one, in a few rounds, each class
   outside the list's main component is held against some members of it, so that a group of very many near
   copies costs some comparisons per copy. Only classes still of different components are then paired in the same
   way, so no link between components is lost. The overlap of a pair is counted by fragment and summed.

Texts are read twice and never stored; sets are kept only for the classes that are left after step 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, ship, side, written
from .components import components
from .words import NOT_SPACE, binaries, mix, shingles, text_buffer, word_hashes

WORDS = 5
PERCENT = 80
SHARE = 0.35  # part of the order that step 1 looks at
FLUSH = 250_000  # shingles a piece gathers before it is handed on
SLICE = 128  # rows whose words are hashed at a time
FRAGMENT = 500_000  # shingles of a fragment, about
LEAST_FRAGMENTS = 8  # of the order, in steps 1 and 2
ROW = 4096  # shingles that a fragment of step 3 has of one set, about: it bounds a row
SHORT_LIST = 8
# Rounds of pivots before the classes left are compared in pairs; members drawn per list, and tried per class, in each.
ROUNDS, DRAWS, TRIALS = 3, 8, 16
_U = np.uint64
_LONGS = pa.list_(pa.int64())


def _first_cut() -> np.uint64:
    return _U(int(SHARE * 2.0**64))


def _fragment_of(keys: np.ndarray, fragments: int, share: float) -> np.ndarray:
    if fragments == 1:
        return np.zeros(len(keys), dtype=np.int64)
    width = int(share * 2.0**64) // fragments + 1
    return (keys // _U(width)).astype(np.int64)


def _digest(s: np.ndarray) -> bytes:
    """128 bits of a set: equal for equal sets."""
    a, b = mix(s ^ _U(0x5851F42D4C957F2D)), mix(s * _U(0x2545F4914F6CDD1D) + _U(len(s)))
    return np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)], dtype=">u8").tobytes()


_PIECE = ("part long, flush long, keys binary, slots binary, ids array<long>, hashes array<long>, sizes array<long>, "
          "cuts array<long>, shared array<long>, digests array<binary>")
_PIECE_ARROW = pa.schema([
    ("part", pa.int64()), ("flush", pa.int64()), ("keys", pa.binary()), ("slots", pa.binary()), ("ids", _LONGS),
    ("hashes", _LONGS), ("sizes", _LONGS), ("cuts", _LONGS), ("shared", _LONGS), ("digests", pa.list_(pa.binary()))])
_MERGED = _PIECE.replace("part long, ", "").replace("keys binary", "counts binary")


def _pieces(k: int, fragments: int):
    """Batches (id, row hash, text) to rows of one flush: its documents (part below 0), and per fragment the
    distinct shingles with the one document of the flush that has it, or -1 if several have."""

    def flush(number, ids, hashes, sizes, firsts, digests):
        """`firsts`: of each set the shingles in the first part of the order."""
        cuts = [len(s) for s in firsts]
        keys = np.concatenate(firsts)
        slots = np.repeat(np.arange(len(firsts), dtype=np.int32), cuts)
        order = np.argsort(keys, kind="stable")
        keys, slots = keys[order], slots[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=bool)
        first = np.flatnonzero(new)
        several = np.diff(np.append(first, len(keys))) > 1
        local = np.bincount(slots[np.repeat(several, np.diff(np.append(first, len(keys))))], minlength=len(firsts))
        yield pa.RecordBatch.from_pylist([{
            "part": -1 - number, "flush": number, "ids": ids, "hashes": hashes, "sizes": sizes, "cuts": cuts,
            "shared": local.tolist(), "digests": digests}], schema=_PIECE_ARROW)
        keys, slots = keys[first], np.where(several, -1, slots[first]).astype(np.int32)
        part = _fragment_of(keys, fragments, SHARE)
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, dtype=int)
        edges, n = np.append(at, len(keys)), len(at)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[at]), pa.repeat(number, n), binaries(keys, edges), binaries(slots, edges),
                 *(pa.nulls(n, f.type) for f in list(_PIECE_ARROW)[4:])], schema=_PIECE_ARROW)

    def run(batches):
        number, held, cut = TaskContext.get().partitionId() << 32, 0, _first_cut()
        ids, hashes, sizes, firsts, digests = [], [], [], [], []
        for b in batches:
            # Some rows at a time: the words of a batch of very long texts would be too many at once.
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                found = shingles(*word_hashes(*text_buffer(part.column(2)), NOT_SPACE), k)
                ids += part.column(0).to_pylist()
                hashes += part.column(1).to_pylist()
                digests += [_digest(s) for s in found]
                sizes += [len(s) for s in found]
                firsts += [s[: np.searchsorted(s, cut)].copy() for s in found]
                held += sum(map(len, found))
                if held >= FLUSH / SHARE:
                    yield from flush(number, ids, hashes, sizes, firsts, digests)
                    number, held = number + 1, 0
                    ids, hashes, sizes, firsts, digests = [], [], [], [], []
                    pa.default_memory_pool().release_unused()
        if ids:
            yield from flush(number, ids, hashes, sizes, firsts, digests)

    return run


def _joined(rows, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Binary cells as one array, and the row of each element."""
    parts = [np.frombuffer(x, dtype=dtype) for x in rows]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _shared(table: pa.Table) -> pa.Table:
    """One fragment: how many shingles of each document other documents have too. Rows of documents pass."""
    if table["part"][0].as_py() < 0:
        out = table.drop_columns(["part", "keys"]).append_column("counts", pa.nulls(len(table), pa.binary()))
        return out.select(["flush", "counts", *out.column_names[1:-1]])
    keys, row = _joined(table["keys"].to_pylist(), np.uint64)
    slots, _ = _joined(table["slots"].to_pylist(), np.int32)
    order = np.argsort(keys, kind="stable")
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    size = np.diff(np.append(np.flatnonzero(new), len(keys)))
    several = np.empty(len(keys), dtype=bool)
    several[order] = np.repeat(size > 1, size)
    flushes = table["flush"].to_pylist()
    several &= slots >= 0
    rows, slots = row[several], slots[several]
    edges = np.searchsorted(rows, np.arange(len(flushes) + 1))  # keys lie in the order of their rows
    out = []
    for r in np.flatnonzero(np.diff(edges)).tolist():
        slot, n = np.unique(slots[edges[r] : edges[r + 1]], return_counts=True)
        out.append({"flush": flushes[r], "counts": n.astype(np.int32).tobytes(), "slots": slot.astype(np.int32).tobytes()})
    schema = pa.schema([("flush", pa.int64()), ("counts", pa.binary()), *list(_PIECE_ARROW)[3:]])
    return pa.Table.from_pylist(out, schema=schema)


def _summed(percent: int):
    """One flush: partial counts summed per document; can it link with another?"""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["ids"] is not None)
        shared = np.array(own["shared"], dtype=np.int64)
        for r in rows:
            if r["counts"] is not None:
                shared[np.frombuffer(r["slots"], dtype=np.int32)] += np.frombuffer(r["counts"], dtype=np.int32)
        size, cut = np.array(own["sizes"], dtype=np.int64), np.array(own["cuts"], dtype=np.int64)
        likely = (size > 0) & (cut - shared <= size * (100 - percent) // 100)
        return pa.table({"id": pa.array(own["ids"], pa.int64()), "row_hash": pa.array(own["hashes"], pa.int64()),
                         "n": size, "cls": pa.array(own["digests"], pa.binary()), "likely": likely})

    return run


_SET = "kind string, part long, flush long, keys binary, counts binary, cls binary, n long, fragment long, shingles array<long>"
_SET_ARROW = pa.schema([
    ("kind", pa.string()), ("part", pa.int64()), ("flush", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()),
    ("cls", pa.binary()), ("n", pa.int64()), ("fragment", pa.int64()), ("shingles", _LONGS)])


def _sets(k: int, fragments: int, cells: int):
    """Batches (class, text) to the classes' sets by fragment (kind s), and the shingles of a flush with the
    number of its classes that have them (kind k)."""

    def flush(number, classes, sets):
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        cell = owner * cells + _fragment_of(flat, cells, 1.0)
        at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        edges, n = np.append(at, len(flat)), len(at)
        yield pa.RecordBatch.from_arrays([
            pa.repeat("s", n), pa.nulls(n, pa.int64()), pa.repeat(number, n), pa.nulls(n, pa.binary()),
            pa.nulls(n, pa.binary()), pa.array([classes[i] for i in owner[at]], pa.binary()), pa.array(size[owner[at]]),
            pa.array(cell[at] % cells),
            pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.view(np.int64)))], schema=_SET_ARROW)
        keys, count = np.unique(flat, return_counts=True)
        part = _fragment_of(keys, fragments, 1.0)
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        edges, n = np.append(at, len(keys)), len(at)
        yield pa.RecordBatch.from_arrays([
            pa.repeat("k", n), pa.array(part[at]), pa.repeat(number, n), binaries(keys, edges),
            binaries(count.astype(np.int64), edges), *(pa.nulls(n, f.type) for f in list(_SET_ARROW)[5:])], schema=_SET_ARROW)

    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, 0
        classes, sets = [], []
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                classes += part.column(0).to_pylist()
                found = shingles(*word_hashes(*text_buffer(part.column(1)), NOT_SPACE), k)
                sets += found
                held += sum(map(len, found))
                if held >= FLUSH:
                    yield from flush(number, classes, sets)
                    number, held, classes, sets = number + 1, 0, [], []
                    pa.default_memory_pool().release_unused()
        if sets:
            yield from flush(number, classes, sets)

    return run


def _counted(table: pa.Table) -> pa.Table:
    """One fragment: each flush gets back those of its shingles that several classes have, with their number."""
    keys, row = _joined(table["keys"].to_pylist(), np.uint64)
    counts, _ = _joined(table["counts"].to_pylist(), np.int64)
    distinct, where = np.unique(keys, return_inverse=True)
    total = np.bincount(where, weights=counts, minlength=len(distinct)).astype(np.int64)[where]
    flushes, out = table["flush"].to_pylist(), []
    several = total > 1
    keys, total = keys[several], total[several]
    edges = np.searchsorted(row[several], np.arange(len(flushes) + 1))  # keys lie in the order of their rows
    for r in np.flatnonzero(np.diff(edges)).tolist():
        a, b = edges[r], edges[r + 1]
        out.append({"flush": flushes[r], "keys": keys[a:b].tobytes(), "counts": total[a:b].tobytes()})
    return pa.Table.from_pylist(out, schema=pa.schema([("flush", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))


def _prefixes(percent: int):
    """One flush: the first shingles of its classes in the order (count, hash), those that no other class has left out,
    with the number of the class's shingles that others have (shared), and the last of the first shingles in that
    order."""

    def run(sets: pa.Table, counted: pa.Table) -> pa.Table:
        out = {"shingle": [], "cls": [], "n": [], "shared": [], "last_df": [], "last_hash": []}
        if len(sets) and len(counted):
            keys, _ = _joined(counted["keys"].to_pylist(), np.uint64)
            count, _ = _joined(counted["counts"].to_pylist(), np.int64)
            order = np.argsort(keys)
            keys, count = keys[order], count[order]
            sets = sets.sort_by([("cls", "ascending")])
            classes, sizes = sets["cls"].to_pylist(), sets["n"].to_pylist()
            lists = sets["shingles"].combine_chunks()
            flat, at = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            place = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
            df = np.where(keys[place] == flat, count[place], 1)
            first = [i for i in range(len(classes)) if i == 0 or classes[i] != classes[i - 1]]
            for i, j in zip(first, [*first[1:], len(classes)]):
                s, d, n = flat[at[i] : at[j]], df[at[i] : at[j]], sizes[i]
                shared = np.flatnonzero(d > 1)
                take = n * (100 - percent) // 100 + 1 - (len(s) - len(shared))
                if take > 0 and len(shared):
                    chosen = s[shared[np.lexsort((s[shared], d[shared]))[:take]]]
                    out["shingle"].append(chosen.view(np.int64))
                    out["cls"] += [classes[i]] * len(chosen)
                    out["n"] += [n] * len(chosen)
                    out["shared"] += [len(shared)] * len(chosen)
                    last = int(chosen[-1])
                    out["last_df"] += [int(d[s == chosen[-1]][0])] * len(chosen)
                    out["last_hash"] += [last - (1 << 63)] * len(chosen)
        flat = np.concatenate(out["shingle"]) if out["shingle"] else np.empty(0, dtype=np.int64)
        numbers = {k: pa.array(out[k], pa.int64()) for k in ("n", "shared", "last_df", "last_hash")}
        return pa.table({"shingle": flat, "cls": pa.array(out["cls"], pa.binary()), **numbers})

    return run


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, overlap): partial overlaps by fragment, summed per pair."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), "fragment", F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "fragment", F.col("shingles").alias("sb"))
    parts = pairs.join(left, "a").join(right, ["b", "fragment"])
    return (parts.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("o"))
            .groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("overlap")))


def _is_link(percent: int) -> F.Column:
    return 100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))


_CLASS = ("cls", "n", "shared", "last", "lists", "place")


def _can_link(x: dict, y: dict, percent: int) -> F.Column:
    """Can a list be the first one that two classes have in common, shortest lists first, if they link?

    A pair that links has `overlap` shingles in common, all of them shared ones. Those before the end of the prefix
    that ends first are in both prefixes: so many lists at least are common, and the first has the others behind it.
    """
    overlap = F.ceil(percent * (x["n"] + y["n"]) / (100 + percent))

    def behind(z) -> F.Column:
        return z["n"] - F.floor((100 - percent) * z["n"] / 100) - 1

    need = overlap - F.when(x["last"] < y["last"], behind(x)).when(y["last"] < x["last"], behind(y)).otherwise(
        F.greatest(behind(x), behind(y)))
    fits = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    for z in (x, y):
        fits = fits & (z["shared"] >= overlap) & (z["place"] <= z["lists"] - need + 1)
    return fits


def _links(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): enough links between classes to give the components of all links."""
    size = postings.count()
    lists = written(postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "lists", rows=size)
    # The place of a list among those of a class, shortest first: one order of lists for all classes.
    own = Window.partitionBy("cls")
    listed = postings.join(side(lists), "shingle").withColumns({
        "place": F.row_number().over(own.orderBy("members", "shingle")), "lists": F.count(F.lit(1)).over(own)})
    listed = written(listed.select("shingle", "members", "cls", "n", "shared", F.struct("last_df", "last_hash").alias("last"),
                                   "lists", "place"), "listed", rows=size)
    is_short = F.col("members") <= SHORT_LIST

    # Short lists: all pairs that can link.
    short = listed.filter(is_short).groupBy("shingle").agg(F.collect_list(F.struct(*_CLASS)).alias("m"))
    both = F.flatten(F.transform("m", lambda x: F.transform(
        F.filter("m", lambda y: (y["cls"] > x["cls"]) & _can_link(x, y, percent)),
        lambda y: F.struct(x["cls"].alias("a"), y["cls"].alias("b")))))
    near = written(short.select(F.explode(both).alias("p")).select("p.a", "p.b").distinct(), "pairs", rows=size)
    checked = written(_overlaps(near, sets), "overlaps", rows=size)
    links = checked.filter(_is_link(percent)).select("a", "b")

    # Long lists: in each round, every class outside a list's main component is held against some of that component's
    # members that the round's hash chooses, those first that it meets in most lists.
    long = listed.filter(~is_short).select("shingle", *_CLASS)
    for number in range(ROUNDS):
        members = written(_with_roots(long, components(links, rows=size), size), "members", rows=size)
        open_lists = _split(members, size)
        if open_lists.isEmpty():
            return links
        members = members.join(side(open_lists), "shingle")
        chosen = [F.min_by(F.struct(F.col("cls").alias("pivot"), F.col("n").alias("np")), F.xxhash64("cls", F.lit(number * DRAWS + i)))
                  for i in range(DRAWS)]
        pivots = members.filter("root = main").groupBy("shingle").agg(F.array_distinct(F.array(*chosen)).alias("pivots"))
        stars = members.filter("root <> main").join(side(written(pivots, "pivots", rows=size)), "shingle")
        stars = stars.select("cls", "n", F.explode("pivots").alias("p")).select("cls", "n", "p.pivot", "p.np")
        fits = 100 * F.least("n", "np") >= percent * F.greatest("n", "np")
        stars = stars.filter(fits).groupBy("cls", "pivot").agg(F.count(F.lit(1)).alias("k"))
        stars = stars.select("cls", "k", F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b"))
        stars = stars.join(side(checked.select("a", "b")), ["a", "b"], "left_anti")
        place = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("k"), "a", "b"))  # some draws per class
        stars = written(stars.withColumn("place", place).filter(F.col("place") <= TRIALS).select("a", "b").distinct(), "pairs", rows=size)
        found = written(_overlaps(stars, sets), "overlaps", rows=size)
        checked = checked.unionByName(found)
        more = found.filter(_is_link(percent)).select("a", "b")
        links = links.unionByName(more)
        if stars.isEmpty():
            break

    # What is left: pairs of different components that can link. The first list that such a pair has in common is
    # among these, or it is a short one, and the pair was met above.
    members = written(_with_roots(long, components(links, rows=size), size), "members", rows=size)
    open_lists = _split(members, size)
    if open_lists.isEmpty():
        return links
    members = members.join(side(open_lists), "shingle")
    names = (*_CLASS, "root")
    left = members.filter("root <> main").select("shingle", "main", *[F.col(c).alias(c + "_x") for c in names])
    left = written(left, "outside", rows=size)
    right = members.select("shingle", *[F.col(c).alias(c + "_y") for c in names])
    x, y = ({c: F.col(c + end) for c in names} for end in ("_x", "_y"))
    apart = left.join(right, "shingle").filter(
        (x["root"] != y["root"]) & ((y["root"] == F.col("main")) | (x["cls"] < y["cls"])) & _can_link(x, y, percent))
    more = apart.select(F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b")).distinct()
    more = written(more.join(side(checked.select("a", "b")), ["a", "b"], "left_anti"), "pairs")
    return links.unionByName(_overlaps(more, sets).filter(_is_link(percent)).select("a", "b"))


def _with_roots(long: DataFrame, roots: DataFrame, size: int) -> DataFrame:
    roots = side(written(roots, "roots", rows=size))
    return long.join(roots, long["cls"] == roots["node"], "left").select(
        "shingle", *_CLASS, F.coalesce("root", "cls").alias("root"))


def _split(members: DataFrame, size: int) -> DataFrame:
    """(shingle, main): lists whose members are of several components, and the most frequent of them."""
    by_root = members.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("k"))
    return written(by_root.groupBy("shingle").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("k", "root")).alias("m"))
                   .filter("roots > 1").select("shingle", F.col("m.root").alias("main")), "open-lists", rows=size)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row_hash"),
                       F.col(text_col).alias("text"))


def _grouped(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, row_hash, n, root, component) per row; root is NULL for documents that link with nothing."""
    spark = rows.sparkSession
    bound_batches(spark)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, int(chars / 6 * SHARE / FRAGMENT))
    pieces = rows.mapInArrow(_pieces(words, fragments), _PIECE)
    merged = pieces.groupBy("part").applyInArrow(_shared, _MERGED)
    classes = written(merged.groupBy("flush").applyInArrow(
        _summed(percent), "id long, row_hash long, n long, cls binary, likely boolean"), "classes")

    heads = written(classes.filter("likely").groupBy("cls").agg(
        F.min(F.struct("id", "row_hash")).alias("head"), F.min("id").alias("least")), "heads")
    head = heads.select("cls", F.col("head.id").alias("head_id"), F.col("head.row_hash").alias("head_hash"))
    head = side(head)
    # Only the text of one document per class is read; rows that repeat it are left out.
    texts = rows.join(head, rows["id"].eqNullSafe(F.col("head_id")) & (rows["row_hash"] == F.col("head_hash")))
    texts = texts.select("cls", "text").dropDuplicates(["cls"])
    kept = fresh_path(spark, "sets")
    total, largest = classes.filter("likely").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    texts.mapInArrow(_sets(words, max(LEAST_FRAGMENTS, total // FRAGMENT), largest // ROW + 1), _SET).write.partitionBy("kind").option(
        "compression", "zstd").parquet(kept)
    read = spark.read.schema(_SET).parquet(kept)
    sets = read.filter("kind = 's'").select("flush", "cls", "n", "fragment", "shingles")
    counted = read.filter("kind = 'k'").select("part", "flush", "keys", "counts").groupBy("part").applyInArrow(
        _counted, "flush long, keys binary, counts binary")
    postings = written(sets.groupBy("flush").cogroup(counted.groupBy("flush")).applyInArrow(
        _prefixes(percent), "shingle long, cls binary, n long, shared long, last_df long, last_hash long"), "prefixes")

    roots = side(written(components(_links(postings, sets, percent)), "roots"))
    grouped = heads.join(roots, heads["cls"] == roots["node"], "left").select(
        "cls", "least", F.coalesce("root", "cls").alias("root"))
    grouped = written(grouped, "grouped")
    named = written(grouped.groupBy("root").agg(F.min("least").alias("component")), "named")
    by_class = written(grouped.join(side(named), "root").select("cls", "root", "component"), "by-class")
    return classes.join(side(by_class), "cls", "left").select("id", "row_hash", "n", "root", "component")


def linked_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                  percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the size of its set and the smallest id reachable by links.

    A text is lower-cased (A-Z) and cut at spaces; its set holds the distinct windows of `words` words, or all
    its words if there are fewer. Two documents link when 100 * intersection >= percent * union. NULL or empty
    texts, and texts of spaces only, have an empty set and link with nothing. Rows that repeat are rows of their
    own, in one group. A NULL id counts last: it names a group only of rows without ids. An empty table gives no rows.
    """
    found = _grouped(_rows(docs, id_col, text_col), words, percent)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.coalesce("component", "id").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                      percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, all columns, with one document of each group of links: the one with the smallest id.

    Rows that repeat id and text are one document and stay once, whatever their text. Documents that link with
    nothing stay. A NULL id counts last in a group.
    """
    found = _grouped(_rows(docs, id_col, text_col), words, percent).filter("root is not null")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row_hash")
    heads = written(found.groupBy("root").agg(F.min(order).alias("head")), "group-heads")
    others = found.join(side(heads), "root").filter(F.col("head") != order).select("id", "row_hash").distinct()
    # Plain equality on two columns, so that one exchange of the texts serves the join and the last step.
    key = [F.coalesce("id", F.lit(-(1 << 63))).alias("__llm_id"), F.xxhash64(F.col("id").isNull(), "row_hash").alias("__llm_hash")]
    others = written(others.select(*key), "group-others")
    keyed = docs.withColumns({
        "__llm_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))),
        "__llm_hash": F.xxhash64(F.col(id_col).isNull(), F.xxhash64(text_col))})
    on = ["__llm_id", "__llm_hash"]
    return keyed.join(others, on, "left_anti").dropDuplicates(on).drop(*on).select(docs.columns)


ship(__name__)
