"""Lines repeated over many documents, found by two Bloom filters and confirmed exactly.

Method. Every long line's key is hashed. Pieces of the input build a once-seen and a twice-seen filter of
what they have read; the pieces are merged so that a bit seen by two of them enters the twice-seen filter.
A key whose bits are all in the merged twice-seen filter may repeat; no repeated key is missed. Only those
keys, with the places where they stand, are shuffled, counted exactly by their text, and the document with the
largest id is chosen to keep its lines.

Filters are cut into blocks by the hash, and their number follows the number of lines, so that the share of
false suspects is the same at any size. The blocks of the twice-seen filter are broadcast while they are small
(checked); beyond that, distinct hashes alone meet their block. Confirmed keys go to the documents, which do not move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fold_ascii, ship, written

SPACES = " \t\n\x0b\x0c\r"  # stripped at both ends of a line
SPACE_BYTES = SPACES.encode()
BLOCK_BITS = 1 << 16
BITS_PER_LINE = 16
GROUP = 16  # blocks that are merged by one task at a time
FLUSH = 500_000  # hashes a piece of the input gathers before it hands on its filters
BROADCAST_BLOCKS = 4096  # 8 KB each
FEW_HASHES = 500_000  # suspected hashes that go to the lines
FEW_KEYS, FEW_BYTES = 200_000, 32 << 20  # repeated keys that go to the documents


def line_key(line) -> F.Column:
    """The line without spaces at both ends, A-Z in lower case."""
    return fold_ascii(F.btrim(line, F.lit(SPACES)))


def _keys(docs: DataFrame, text: str, min_chars: int) -> F.Column:
    """(pos, key) of the text's lines that are long enough."""
    lines = F.split(F.col(text), "\n", -1)
    keyed = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key")))
    return F.filter(keyed, lambda x: F.length(x["key"]) >= min_chars)


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash and its two bits there, as places counted over the whole filter."""
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    base = block * np.uint64(BLOCK_BITS)
    return base + (h & np.uint64(0xFFFF)), base + ((h >> np.uint64(16)) & np.uint64(0xFFFF))


def _sketches(blocks: int):
    """Batches of hashes to rows (group of blocks, places once seen, places twice seen) per piece."""
    span = BLOCK_BITS * GROUP

    def cut(places: np.ndarray) -> dict[int, bytes]:
        group = places // np.uint64(span)
        at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        parts = np.split(places, at[1:]) if len(places) else []
        return {int(p[0]) // span: (p % np.uint64(span)).astype(np.uint32).tobytes() for p in parts}

    def flush(parts: list[np.ndarray]):
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        once = cut(np.unique(np.concatenate(_bits(h, blocks))))
        twice = cut(np.unique(np.concatenate(_bits(h[n > 1], blocks))))
        return pa.RecordBatch.from_pydict({
            "part": pa.array(list(once), pa.int64()), "once": pa.array(list(once.values()), pa.binary()),
            "twice": pa.array([twice.get(k, b"") for k in once], pa.binary())})

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                size += b.num_rows
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _merged(table: pa.Table) -> pa.Table:
    """One group of blocks: places that two pieces have, or one piece twice, as the words of the bit sets."""
    once = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in table["once"]]
    twice = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in table["twice"]]
    seen = np.zeros(BLOCK_BITS * GROUP, dtype=bool)
    again = np.zeros(BLOCK_BITS * GROUP, dtype=bool)
    for a, b in zip(once, twice):
        again[a[seen[a]]] = True
        seen[a] = True
        again[b] = True
    words = np.packbits(again, bitorder="little").view(np.int64).reshape(GROUP, -1)
    some = np.flatnonzero(words.any(axis=1))
    part = table["part"][0].as_py()
    return pa.table({"block": pa.array([part * GROUP + int(i) for i in some], pa.int64()),
                     "words": pa.array([words[i].tolist() for i in some], pa.list_(pa.int64()))})


def repeated_bits(hashes: DataFrame, blocks: int) -> DataFrame:
    """The twice-seen filter: (block, words) of the blocks that are not empty."""
    pieces = hashes.mapInArrow(_sketches(blocks), "part long, once binary, twice binary")
    return pieces.groupBy("part").applyInArrow(_merged, "block long, words array<long>")


def _suspects(base: DataFrame, min_chars: int) -> tuple[DataFrame, bool]:
    """(id, row_hash, key, pos) of the lines whose hash may come twice, and whether key is the line's key itself.

    Up to BROADCAST_BLOCKS blocks the filter goes to the lines. Beyond it, distinct hashes alone meet the blocks, and
    the suspected hashes go to the lines if they are few. If they are many too, lines are dealt by hash with the SHA-256 of
    their key in its place: no text moves but that of suspects.
    """
    text_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    lines = base.agg(F.sum(text_lines)).first()[0] or 0
    blocks = max(1, -(-lines * BITS_PER_LINE // BLOCK_BITS))

    found = base.select("id", F.xxhash64("text").alias("row_hash"), F.explode(_keys(base, "text", min_chars)).alias("l"))
    found = found.select("id", "row_hash", "l.pos", "l.key").withColumn("h", F.xxhash64("key"))
    distinct = base.select(F.explode(F.array_distinct(F.transform(
        _keys(base, "text", min_chars), lambda x: F.xxhash64(x["key"])))).alias("h"))
    twice = written(repeated_bits(distinct, blocks), "twice-seen")

    # The same places as _bits, in expressions. A shift without sign keeps the upper half not negative.
    def marked(rows: DataFrame, side: DataFrame) -> DataFrame:
        def has(place) -> F.Column:
            word = F.get(F.col("words"), F.shiftright(place, 6).cast("int"))
            return F.bit_get(word, (place % 64).cast("int")) == 1

        low = F.col("h").bitwiseAND(F.lit(0xFFFF))
        high = F.shiftrightunsigned("h", 16).bitwiseAND(F.lit(0xFFFF))
        own = rows.withColumn("block", F.shiftrightunsigned("h", 32) % blocks)
        return own.join(side, "block").filter(has(low) & has(high)).drop("block", "words")

    if twice.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        return marked(found, F.broadcast(twice)).drop("h"), True
    hashes = written(marked(distinct.distinct(), twice), "suspected")
    if hashes.count() <= FEW_HASHES:
        return found.join(F.broadcast(hashes), "h").drop("h"), True
    digests = found.withColumn("key", F.sha2(F.col("key").cast("binary"), 256))
    return digests.join(hashes, "h").drop("h"), False


def _confirmed(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> tuple[DataFrame, DataFrame, bool]:
    """Places of the suspects (key, id, row_hash, pos), confirmed (key, keeper), and whether key is the line's key itself."""
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    suspects, plain = _suspects(base, min_chars)
    # Rows that repeat both id and text are one document.
    places = written(suspects.groupBy("key", "id", "row_hash").agg(F.collect_set("pos").alias("pos")), "suspects")
    confirmed = (places.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper"))
                 .filter(F.col("docs") >= min_docs).select("key", "keeper"))
    # Written, so that later joins deal both sides anew and a key that many documents hold can be split.
    return places, written(confirmed, "repeated-keys"), plain


def _drops(places: DataFrame, confirmed: DataFrame) -> DataFrame:
    return (places.join(confirmed, "key").filter(~F.col("id").eqNullSafe(F.col("keeper")))
            .select("id", "row_hash", F.explode("pos").alias("pos")))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                   min_docs: int = 5) -> DataFrame:
    """(id, row_hash, pos): the lines to drop, by document (see `drop_repeated_lines`) and number of the line from 0.

    NULL texts have no lines; rows that repeat id and text are listed once; an empty table gives no rows.
    """
    places, confirmed, _ = _confirmed(docs, id_col, text_col, min_chars, min_docs)
    return _drops(places, confirmed)


_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _without(keepers, id_at: int, text_at: int):
    """Batches of documents without the lines whose key is in the table `keepers` of another document's id."""

    def run(batches):
        known = keepers.value
        for b in batches:
            texts, totals, dropped = [], [], []
            for own, text in zip(b.column(id_at).to_pylist(), b.column(text_at).to_pylist()):
                keys = [k.strip(SPACE_BYTES) for k in (text or "").encode().translate(_FOLD).split(b"\n")]
                gone = {i for i, k in enumerate(keys) if k in known and known[k] != own}
                if gone:
                    text = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone)
                texts.append(text)
                totals.append(len(keys))
                dropped.append(len(gone))
            columns = list(b.columns)
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())],
                                             names=[*b.schema.names, "n_lines", "n_dropped"])

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                        min_docs: int = 5) -> DataFrame:
    """All rows and columns of `docs`, with the text without its repeated lines, and `n_lines` (before) and
    `n_dropped` behind the other columns. Input columns of those two names are replaced.

    NULL text counts as one empty line; it stays NULL when nothing is dropped. Lines of fewer than `min_chars`
    code points are never dropped. A document is a distinct pair of id and text. All its lines
    with a repeated key go, unless it has the largest id among the holders (a NULL id is the smallest; if no
    holder has an id, those without keep their lines). An empty table stays empty.

    Repeated keys up to FEW_KEYS and FEW_BYTES (as a rule few: a key is listed once however many documents hold it) go to
    the documents, which do not move. Beyond that, documents are joined with their drops by id.
    """
    places, confirmed, plain = _confirmed(docs, id_col, text_col, min_chars, min_docs)
    own = docs.drop("n_lines", "n_dropped")
    n, size = confirmed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    if plain and n <= FEW_KEYS and size <= FEW_BYTES:
        keepers = {r["key"].encode(): r["keeper"] for r in confirmed.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(keepers)
        schema = T.StructType([*own.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        return own.mapInArrow(_without(shared, own.columns.index(id_col), own.columns.index(text_col)), schema)
    drops = _drops(places, confirmed).groupBy("id", "row_hash").agg(F.collect_set("pos").alias("__llm_drop"))
    keyed = own.withColumns({"__llm_id": F.col(id_col), "__llm_hash": F.xxhash64(F.col(text_col))})
    drops = drops.withColumnsRenamed({"id": "__llm_drop_id", "row_hash": "__llm_drop_hash"})
    on = keyed["__llm_id"].eqNullSafe(drops["__llm_drop_id"]) & (keyed["__llm_hash"] == drops["__llm_drop_hash"])
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    keep = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__llm_drop")))
    kept = F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")
    return keyed.join(drops, on, "left").withColumns({
        "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size("__llm_drop"), F.lit(0)).cast("long"),
        text_col: F.when(F.col("__llm_drop").isNull(), F.col(text_col)).otherwise(kept),
    }).drop("__llm_id", "__llm_hash", "__llm_drop_id", "__llm_drop_hash", "__llm_drop")


ship(__name__)
