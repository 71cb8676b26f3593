"""How filters that run one after another interact: what each removes, repeats and loses, in every order.

Method. Per part and range of rows, each filter keeps the sorted list of the rows that fail it (posting lists, as are
the rows of each label). Unions of the lists of every set of filters are merged from the union of a smaller set and one
more list, differences and intersections likewise; the shorter list always gallops through the longer one. The sizes
of these lists, summed over the ranges of a part, give all figures: what filter f removes after the filters S is the size
of its list less the union of S.

A range holds at most RANGE rows however large a part is, so a part with a third of all rows is many small lists, and
only sizes leave a task.
"""

from __future__ import annotations

import hashlib
import json
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach
from .common import bound_batches, ship, written

RANGE = 1 << 16  # rows of one range
_PIECE = 4 << 20  # bytes of a text whose words are counted at a time
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
_SIGNS = b"#$%&*|"

FILTERS = ("A", "B", "C", "D", "E")


def _words(text: bytes) -> tuple[int, int]:
    """Words and distinct words of a text."""
    if len(text) <= _PIECE:
        words = text.split()  # bytes are split at ASCII white space
        return len(words), len(set(words))
    n, seen, start = 0, set(), 0
    while start < len(text):
        end = min(len(text), start + _PIECE)
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        words = text[start:end].split()
        n += len(words)
        seen.update(words)
        start = end
    return n, len(seen)


def _failures(batches):
    for b in batches:
        rows = []
        for text in b.column(b.num_columns - 1).to_pylist():
            text = (text or "").encode()
            n, distinct = _words(text)
            upper = len(text) - len(text.translate(None, _UPPER))
            points = len(text.translate(None, _FOLLOWING))
            rows.append((n < 200, 100 * distinct < 50 * n, 100 * upper > 2 * points,
                         len(text.translate(None, _SIGNS)) < len(text), hashlib.sha256(text).digest()))
        flags = list(zip(*rows)) or [()] * 5
        arrays = [pa.array(f, pa.bool_()) for f in flags[:4]] + [pa.array(flags[4], pa.binary())]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=["id", "part", *FILTERS[:4], "digest"])


def failing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, row, A to E) per document: which of the five filters of this module its whole text fails.

    A: under 200 words; B: under half of the words are distinct; C: over 2 % capitals of A-Z; D: holds one of
    `#$%&*|`; E: some smaller id has the same text. A NULL text is empty, a NULL part is "". Rows that share an id are rows of
    their own and do not make each other fail E; a NULL id is smaller than none, and larger than none. An empty table
    gives no rows. `row` numbers the rows in ranges of RANGE and is fixed, since the table is written once.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        F.col(text_col).alias("text"))
    flags = ", ".join(f"{f} boolean" for f in FILTERS[:4])
    marked = plain.mapInArrow(_failures, f"id {kind}, part string, {flags}, digest binary")
    marked = written(marked.withColumn("row", F.monotonically_increasing_id()), "failing")
    first = marked.filter(F.col("id").isNotNull()).groupBy("digest").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    met = attach(marked, written(first, "repeated"), ["digest"], "left")
    return met.withColumn("E", F.coalesce(F.col("id") > F.col("first"), F.lit(False))).select("id", "part", "row", *FILTERS)


def with_labels(marked: DataFrame, labels: DataFrame, flags: dict[str, F.Column], id_col: str = "doc_id") -> DataFrame:
    """`marked` with a boolean column per flag: whether some row of `labels` with this id fulfils it. Ids without a
    label, and NULL ids, fulfil none."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        *[F.max(F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()])
    met = attach(marked, known, ["id"], "left")
    return met.withColumns({name: F.coalesce(name, F.lit(False)) for name in flags})


def posting_lists(marked: DataFrame, names: list[str]) -> DataFrame:
    """One row per part and range: `part`, `n` rows, and per name the sorted list of the rows whose flag is true,
    numbered within the range. Written to the shared folder."""
    place = (F.col("row") % RANGE).cast("int")
    lists = [F.array_sort(F.collect_list(F.when(F.col(name), place))).alias(name) for name in names]
    grouped = marked.groupBy("part", F.expr(f"row div {RANGE}").alias("range"))
    return written(grouped.agg(F.count(F.lit(1)).alias("n"), *lists), "failing-lists")


def inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which ids of the sorted list `a` are in the sorted list `b`; the shorter one gallops through the longer one."""
    out = np.zeros(len(a), dtype=bool)
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(long, short)
    met = at < len(long)
    met[met] = long[at[met]] == short[met]
    out[met if short is a else at[met]] = True
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two sorted lists: what the longer lacks is put into its places."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    new = short[~inside(short, long)]
    return np.insert(long, np.searchsorted(long, new), new) if len(new) else long


def _sizes(filters: int, labels: int):
    """Batches of posting lists to sizes: per part, set of filters before (bits) and filter, how many rows the filter removes,
    and how many of each label. Ranges of one batch lie one behind the other on one number line."""

    def run(batches):
        for b in batches:
            parts, part = np.unique(np.array(b.column(0).to_pylist(), dtype=object), return_inverse=True)
            if not len(part):
                continue
            lists = []
            for column in b.columns[2:]:
                sizes = np.diff(column.offsets.to_numpy())
                base = np.repeat(np.arange(len(part), dtype=np.int64) * RANGE, sizes)
                lists.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + base)

            def per_part(ids):
                return np.bincount(part[ids // RANGE], minlength=len(parts))

            unions = {0: np.empty(0, dtype=np.int64)}
            for s in range(1, 1 << filters):
                lowest = (s & -s).bit_length() - 1
                unions[s] = merged(unions[s & (s - 1)], lists[lowest])
            out = {"before": [], "filter": [], "removed": [], **{f"l{k}": [] for k in range(labels)}}
            for f in range(filters):
                for s in unions:
                    if s >> f & 1:
                        continue
                    left = lists[f][~inside(lists[f], unions[s])]
                    out["before"].append(np.full(len(parts), s))
                    out["filter"].append(np.full(len(parts), f))
                    out["removed"].append(per_part(left))
                    for k in range(labels):
                        out[f"l{k}"].append(per_part(left[inside(left, lists[filters + k])]))
            times = len(out["before"])
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(list(parts) * times, pa.string()),
                **{name: pa.array(np.concatenate(v).astype(np.int64)) for name, v in out.items()}})

    return run


def audit(lists: DataFrame, filters: list[str], lost: list[str] = []) -> DataFrame:
    """Per part, order of all filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails,
    shapley, and <name>_lost per label of `lost`), from the lists of `posting_lists`.

    shapley is the sum over all orders of what the filter of this step removes. There are 2^n unions for n filters and n!
    orders, so n is small. Parts without a failing row have rows too; an empty table gives no rows.
    """
    n = len(filters)
    labels = "".join(f", l{k} long" for k in range(len(lost)))
    sizes = lists.select("part", "n", *filters, *lost).mapInArrow(
        _sizes(n, len(lost)), f"part string, before long, filter long, removed long{labels}")
    sizes = sizes.groupBy("part", "before", "filter").agg(
        *[F.sum(c).alias(c) for c in ("removed", *[f"l{k}" for k in range(len(lost))])])
    one = sizes.groupBy("part", "filter").agg(  # at most 2^(n - 1) rows of a part and filter
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("failing"),
        F.max(F.when(F.bit_count("before") == n - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * _orders(n, F.col("before"))).alias("shapley"),
        F.map_from_entries(F.collect_list(F.struct("before", F.struct("removed", *[
            F.col(f"l{k}").alias(f"{name}_lost") for k, name in enumerate(lost)])))).alias("after"))
    rows = lists.groupBy("part").agg(F.sum("n").alias("n"))
    whole = rows.join(one.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("filter", F.struct(
        "failing", "unique_fails", "shapley", "after")))).alias("by")), "part")
    orders = []
    for order in permutations(range(n)):
        done = [sum(1 << g for g in order[:i]) for i in range(n)]
        orders += [{"filter_order": "".join(filters[g] for g in order), "step": i + 1, "filter": f, "before": done[i],
                    "past": [{"filter": g, "before": done[j]} for j, g in enumerate(order[: i + 1])]}
                   for i, f in enumerate(order)]
    # The orders are a constant, given by the number of filters alone; each part is repeated for its own lines.
    steps = F.from_json(F.lit(json.dumps(orders)), "array<struct<filter_order:string, step:int, filter:long, before:long, "
                                                   "past:array<struct<filter:long, before:long>>>>")
    met = whole.select("part", "n", "by", F.explode(steps).alias("s")).select("part", "n", "by", "s.*")
    own = F.element_at("by", F.col("filter"))
    now = F.element_at(own["after"], F.col("before"))
    gone = F.aggregate("past", F.lit(0).cast("long"), lambda total, p: total + F.element_at(
        F.element_at("by", p["filter"])["after"], p["before"])["removed"])
    return met.select(
        "part", "filter_order", "step", (F.col("n") - gone).alias("kept"), now["removed"].alias("removed"),
        (own["failing"] - now["removed"]).alias("redundant"), own["unique_fails"].alias("unique_fails"),
        own["shapley"].alias("shapley"), *[now[f"{name}_lost"].alias(f"{name}_lost") for name in lost])


def _orders(n: int, before) -> F.Column:
    """Number of orders of n filters in which exactly the filters of this set come before one more."""
    weights = [factorial(k) * factorial(n - 1 - k) for k in range(n)]
    return F.element_at(F.array(*[F.lit(w) for w in weights]), F.bit_count(before) + 1)


ship(__name__)
