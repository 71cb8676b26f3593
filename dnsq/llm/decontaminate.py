"""Passages of benchmark items in training documents, found through a positional inverted index.

Method. Documents are dealt into segments of a bounded number of words. Every segment stores its postings as
rows (segment, term, n, places): the places of the term's occurrences, numbered through the segment with a gap
between documents, so that one sorted list answers phrase and proximity questions. Nothing is shuffled to build it.

A phrase is looked up from its rarest word: the word's places, less its offset in the phrase, are candidate
starts, and the list of each further word (rarest first) keeps those starts that have it where the phrase needs it.
`slop` > 0 accepts a word up to that many places away (proximity match). Segments in which no phrase's rarest
word occurs are left out, and only postings of words of the test items are shuffled, by segment.
Many items are split into blocks of a bounded number, each with its own group per segment.

Terms are 64-bit hashes; a phrase of 13 words matches by chance only if 13 hashes collide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, ship, written
from .words import ALPHANUMERIC, binaries, text_buffer, word_hashes

GAP = 64  # free places between documents of a segment
SEGMENT_WORDS = 1_500_000
ITEMS_PER_GROUP = 20_000
_INDEX = "kind string, seg long, term long, n long, places binary, ids array<long>, hashes array<long>, words array<long>"


def _segments(batches):
    """Batches (id, row hash, text) to the rows of the index: the documents and the postings of each segment."""
    part, number = TaskContext.get().partitionId(), 0
    ids, hashes, counts, terms, places, base, held = [], [], [], [], [], 0, 0

    def flush():
        seg = (part << 32) + number
        yield pa.RecordBatch.from_pylist(
            [{"kind": "d", "seg": seg, "term": None, "n": len(ids), "places": None, "ids": ids, "hashes": hashes,
              "words": counts}],
            schema=schema)
        t, p = np.concatenate(terms), np.concatenate(places)
        if len(t) == 0:
            return
        order = np.argsort(t, kind="stable")
        t, p = t[order], p[order].astype(np.uint32)
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        edges = np.append(first, len(t))
        n = len(first)
        yield pa.RecordBatch.from_arrays([
            pa.repeat("t", n), pa.repeat(seg, n), pa.array(t[first].view(np.int64)), pa.array(np.diff(edges)),
            binaries(p, edges), pa.nulls(n, longs), pa.nulls(n, longs), pa.nulls(n, longs)], schema=schema)

    longs = pa.list_(pa.int64())
    schema = pa.schema([("kind", pa.string()), ("seg", pa.int64()), ("term", pa.int64()), ("n", pa.int64()),
                        ("places", pa.binary()), ("ids", longs), ("hashes", longs), ("words", longs)])
    for b in batches:
        if b.num_rows == 0:
            continue
        h, before = word_hashes(*text_buffer(b.column(2)), ALPHANUMERIC)
        n = np.diff(before)
        starts = base + np.concatenate(([0], np.cumsum(n + GAP)))
        terms.append(h)
        places.append(np.arange(len(h)) + np.repeat(starts[:-1] - before[:-1], n))
        ids += b.column(0).to_pylist()
        hashes += b.column(1).to_pylist()
        counts += n.tolist()
        base, held = int(starts[-1]), held + len(h)
        if held >= SEGMENT_WORDS:
            yield from flush()
            pa.default_memory_pool().release_unused()
            ids, hashes, counts, terms, places, base, held, number = [], [], [], [], [], 0, 0, number + 1
    if ids:
        yield from flush()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the index of all documents into the shared folder and returns its path."""
    bound_batches(docs.sparkSession)
    path = fresh_path(docs.sparkSession, "postings")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col), F.col(text_col).alias("text"))
    rows.mapInArrow(_segments, _INDEX).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return path


def read_index(spark, path: str, kind: str) -> DataFrame:
    """Its postings (kind t) or its documents (kind d)."""
    return spark.read.schema(_INDEX).parquet(path).filter(F.col("kind") == kind)


def _item_terms(batches):
    for b in batches:
        h, before = word_hashes(*text_buffer(b.column(2)), ALPHANUMERIC)
        terms = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), terms], names=["item", "item_id", "terms"])


def _occurrences(length: int, slop: int):
    """Postings and items of one segment to the hit stretches of its documents."""

    def starts_of(terms: np.ndarray, rarity: np.ndarray, lists: dict) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rarity, kind="stable")
        anchor = lists.get(int(terms[order[0]]))
        if anchor is None:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        found = anchor - int(order[0])
        for j in order[1:]:
            have = lists.get(int(terms[j]))
            if have is None or len(found) == 0:
                return found[:0], anchor[:0]
            at = np.searchsorted(have, found + (int(j) - slop))
            inside = at < len(have)
            inside[inside] = have[at[inside]] <= found[inside] + (int(j) + slop)
            found, anchor = found[inside], anchor[inside]
        return found, anchor

    def run(postings: pa.Table, items: pa.Table) -> pa.Table:
        out = {"seg": [], "slot": [], "starts": [], "ends": [], "items": []}
        lists = {t: np.frombuffer(p, dtype=np.uint32).astype(np.int64) for t, p in
                 zip(postings["term"].to_pylist(), postings["places"].to_pylist())}
        rows = items.to_pylist()
        words = next((np.array(r["words"], dtype=np.int64) for r in rows if r["words"] is not None), None)
        if lists and words is not None and len(words):
            bases = np.concatenate(([0], np.cumsum(words + GAP)[:-1]))
            slots, begins, ends, owners = [], [], [], []
            for r in rows:
                if r["words"] is not None:
                    continue
                terms, rarity = np.array(r["terms"]), np.array(r["rarity"])
                n = min(length, len(terms))
                for i in range(len(terms) - n + 1):
                    s, anchor = starts_of(terms[i : i + n], rarity[i : i + n], lists)
                    if len(s):
                        slot = np.searchsorted(bases, anchor, side="right") - 1
                        slots.append(slot)
                        begins.append(np.maximum(s, bases[slot]))
                        ends.append(np.minimum(s + n, bases[slot] + words[slot]))
                        owners.append(np.full(len(s), r["item"]))
            if slots:
                slot, s, e, owner = map(np.concatenate, (slots, begins, ends, owners))
                order = np.lexsort((s, slot))
                slot, s, e, owner = slot[order], s[order], e[order], owner[order]
                edges = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True])))
                seg = rows[0]["seg"]
                for a, b in zip(edges[:-1], edges[1:]):
                    reach = np.maximum.accumulate(e[a:b])
                    new = np.concatenate(([True], s[a + 1 : b] > reach[:-1]))
                    out["seg"].append(seg)
                    out["slot"].append(int(slot[a]))
                    out["starts"].append((s[a:b][new] - bases[slot[a]]).tolist())
                    out["ends"].append((np.append(reach[:-1][new[1:]], reach[-1]) - bases[slot[a]]).tolist())
                    out["items"].append(np.unique(owner[a:b]).tolist())
        longs = pa.list_(pa.int64())
        return pa.table(out, schema=pa.schema([("seg", pa.int64()), ("slot", pa.int64()), ("starts", longs),
                                               ("ends", longs), ("items", longs)]))

    return run


def _covered() -> F.Column:
    """Places in the union of the stretches."""
    ordered = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    return F.aggregate(
        ordered, start,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(x["starts"], acc["reach"]))).alias("n"),
            F.greatest(acc["reach"], x["ends"]).alias("reach")),
        lambda acc: acc["n"])


def find(spark, index: str, items: DataFrame, length: int = 13, slop: int = 0, item_col: str = "item_id",
         text_col: str = "text") -> DataFrame:
    """Per document (row of the indexed table): doc_id, row_hash (of its text), n_words, n_hit, item_ids.

    A phrase is each window of `length` consecutive words of an item; an item of fewer words, but not none, is
    one phrase. n_hit counts the document's words inside any occurrence, item_ids lists (as sorted distinct
    texts) the items that occur. NULL or empty texts have no words and no hits; items without an
    id hit but are not listed; rows that repeat an item are one item, rows that repeat a document are documents of
    their own. Empty tables give no rows, or rows without hits.
    """
    if 2 * slop >= GAP:
        raise ValueError(f"slop must be below {GAP // 2}")
    bound_batches(spark)
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("string").alias("item_id"),
                            F.col(text_col).alias("text"))
    numbered = written(numbered.mapInArrow(_item_terms, "item long, item_id string, terms array<long>"), "items")
    postings, documents = read_index(spark, index, "t"), read_index(spark, index, "d")

    placed = numbered.select("item", F.posexplode("terms").alias("pos", "term"))
    wanted = placed.select("term").distinct()
    rarity = postings.select("term", "n").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df"))
    at = F.array_sort(F.collect_list(F.struct("pos", "term", F.coalesce("df", F.lit(0)).alias("df"))))
    rated = placed.join(rarity, "term", "left").groupBy("item").agg(at.alias("w"))
    rated = written(rated.select("item", F.col("w.term").alias("terms"), F.col("w.df").alias("rarity")), "rated-items")

    # The rarest word of every phrase; a phrase with a word that no document has cannot occur.
    words = F.transform(F.arrays_zip("rarity", "terms"), lambda x: F.struct(x["rarity"], x["terms"].alias("term")))
    size = F.least(F.lit(length), F.size("terms"))
    rarest = F.transform(F.sequence(F.lit(1), F.size("terms") - size + 1), lambda i: F.array_min(F.slice(words, i, size)))
    anchors = (rated.select("item", F.explode(F.array_distinct(rarest)).alias("a")).filter(F.col("a.rarity") > 0)
               .select("item", F.col("a.term").alias("term")))
    pairs = written(postings.select("seg", "term").join(anchors, "term").select("seg", "item").distinct(), "candidates")

    n_items = rated.count()
    blocks = max(1, -(-n_items // ITEMS_PER_GROUP))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    tasks = pairs.join(rated, "item").select("seg", block.alias("block"), "item", "terms", "rarity", F.lit(None).cast("array<long>").alias("words"))
    groups = pairs.select("seg", block.alias("block")).distinct()
    tasks = tasks.unionByName(
        documents.select("seg", "words").join(groups, "seg").select(
            "seg", "block", F.lit(None).cast("long").alias("item"), F.lit(None).cast("array<long>").alias("terms"),
            F.lit(None).cast("array<long>").alias("rarity"), "words"))
    needed = postings.select("seg", "term", "places").join(wanted, "term", "left_semi").join(groups, "seg")
    found = needed.groupBy("seg", "block").cogroup(tasks.groupBy("seg", "block")).applyInArrow(
        _occurrences(length, slop),
        "seg long, slot long, starts array<long>, ends array<long>, items array<long>")
    hits = written(found.groupBy("seg", "slot").agg(
        _covered().alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "hits")
    named = (hits.select("seg", "slot", F.explode("items").alias("item")).join(numbered.select("item", "item_id"), "item")
             .groupBy("seg", "slot").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")))
    listed = documents.select("seg", "ids", "hashes", F.posexplode("words").alias("pos", "n_words"))
    listed = listed.select("seg", F.col("pos").cast("long").alias("slot"), F.get("ids", "pos").alias("doc_id"),
                           F.get("hashes", "pos").alias("row_hash"), "n_words")
    return (listed.join(hits.select("seg", "slot", "n_hit"), ["seg", "slot"], "left").join(named, ["seg", "slot"], "left")
            .select("doc_id", "row_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      length: int = 13, min_share: int = 20) -> DataFrame:
    """The rows of `docs`, all columns, that are not contaminated by the items' phrases."""
    found = find(docs.sparkSession, build_index(docs, id_col, text_col), items, length)
    bad = written(found.filter(contaminated(min_share)).select(
        F.col("doc_id").alias("__llm_id"), F.col("row_hash").alias("__llm_hash")).distinct(), "contaminated")
    same = docs[id_col].eqNullSafe(bad["__llm_id"]) & (F.xxhash64(docs[text_col]) == bad["__llm_hash"])
    return docs.join(bad, same, "left_anti")


def contaminated(min_share: int = 20) -> F.Column:
    """Some hit, and hits are at least one in `min_share` words."""
    return (F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words"))


ship(__name__)
