"""Product codes of vectors: exact nearest entries of per-part codebooks, with few distances computed.

Method. A part of a vector is hashed by its coarse grid cell. For a cell, every entry of the part's codebook has a least
and a greatest distance to the points of the cell's box; an entry whose least distance exceeds some other
entry's greatest one is dominated there and can be nearest to none of its points. The entries left are remembered per
cell, and only these are compared exactly. All arithmetic is on integers.

Vectors never move: a round is one pass over a written table that sends one line per part and entry of each task, and the
driver gets the sums of these (parts x entries lines).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach
from .common import bound_batches, ship, written
from .words import mix

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
CELL_BITS = 8  # a cell is 2^8 units wide in every component, a sixteenth of 1.0
LARGEST = 1 << 26  # components from here on (16,384.0) would leave 64 bits in sums of squares
KEPT_CELLS = 1 << 17  # cells of one part that a worker remembers before it starts anew


def _quantised(batches):
    """Batches (id, label, vector) to those with the integer components as bytes; unusable vectors go."""
    for b in batches:
        vectors = b.column(2)
        sizes = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
        sizes[vectors.is_null().to_numpy(zero_copy_only=False)] = 0
        flat = vectors.flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a missing component is not a number
        with np.errstate(invalid="ignore", over="ignore"):
            q = np.floor(x * SCALE)
            bad = ~np.isfinite(x) | ~(np.abs(q) < LARGEST)
        row = np.repeat(np.arange(len(sizes)), sizes)
        good = (np.bincount(row[bad], minlength=len(sizes)) == 0) & (sizes > 0)
        whole = np.where(bad, 0, q).astype(np.int32).tobytes()
        ends = np.cumsum(sizes) * 4
        keep = np.flatnonzero(good)
        data = [whole[ends[i] - 4 * sizes[i] : ends[i]] for i in keep]
        rows = pa.array(keep)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(rows), b.column(1).take(rows), pa.array(sizes[keep].astype(np.int32)), pa.array(data, pa.binary())],
            names=["id", "label", "size", "q"])


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, size, q): q holds floor(4096 x) of every component as 32-bit integers. Written to the shared folder.

    Vectors that are NULL or empty, or hold a component that is NULL, not finite or of size 16,384 or more, are dropped.
    """
    bound_batches(vectors.sparkSession)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    plain = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                           F.col(vector_col).cast("array<double>").alias("vector"))
    return written(plain.mapInArrow(
        _quantised, f"id {kinds[id_col]}, label {kinds[label_col]}, size int, q binary"), "quantised")


class Cells:
    """Nearest entries of one set of codebooks (parts, entries, width), remembering what each grid cell leaves open."""

    def __init__(self, books: np.ndarray, bits: int = CELL_BITS) -> None:
        self.books, self.bits = books.astype(np.int64), bits
        self.known: list[dict] = [{} for _ in books]
        self.cells = self.compared = 0
        width = books.shape[2]
        self.factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def open_entries(self, part: int, corners: np.ndarray) -> list[np.ndarray]:
        """Entries that are not dominated in the boxes with these cell coordinates."""
        book = self.books[part][None]
        low = (corners << self.bits)[:, None, :]
        high = low + (1 << self.bits) - 1
        least = (np.maximum(np.maximum(low - book, book - high), 0) ** 2).sum(axis=2)
        greatest = (np.maximum(np.abs(book - low), np.abs(high - book)) ** 2).sum(axis=2)
        left = least <= greatest.min(axis=1, keepdims=True)
        return np.split(np.nonzero(left)[1], np.cumsum(left.sum(axis=1))[:-1])

    def _candidates(self, part: int, codes: list[int], corners: np.ndarray) -> list[np.ndarray]:
        known = self.known[part]
        if len(known) > KEPT_CELLS:
            known.clear()
        names = [r.tobytes() for r in corners]
        found = [known.get(c) for c in codes]
        # Equal hashes of different cells are told apart by the coordinates.
        new = [i for i, (f, n) in enumerate(zip(found, names)) if f is None or f[0] != n]
        if new:
            self.cells += len(new)
            for i, entries in zip(new, self.open_entries(part, corners[new])):
                found[i] = known[codes[i]] = (names[i], entries)
        return [f[1] for f in found]

    def nearest(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row; of equally near entries the first."""
        corners = x >> self.bits
        codes = mix((corners.view(np.uint64) * self.factors).sum(axis=1, dtype=np.uint64))
        codes, at, cell = np.unique(codes, return_index=True, return_inverse=True)
        lists = self._candidates(part, codes.tolist(), corners[at])
        # A row whose hash belongs to another cell of this batch is compared with all entries.
        cell[(corners != corners[at][cell]).any(axis=1)] = len(lists)
        lists.append(np.arange(len(self.books[part])))
        sizes = np.array([len(e) for e in lists])
        flat, start = np.concatenate(lists), np.cumsum(sizes) - sizes
        n = sizes[cell]
        ends = np.cumsum(n)
        row = np.repeat(np.arange(len(x)), n)
        entry = flat[np.arange(ends[-1]) + np.repeat(start[cell] - (ends - n), n)]
        self.compared += len(entry)
        gap = x[row] - self.books[part][entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        best = np.minimum.reduceat(distance, ends - n)
        first = np.where(distance == np.repeat(best, n), entry, len(self.books[part]))
        return np.minimum.reduceat(first, ends - n), best

    def assign(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and distances (rows, parts) of whole vectors."""
        parts, _, width = self.books.shape
        both = [self.nearest(p, np.ascontiguousarray(q[:, p * width : (p + 1) * width])) for p in range(parts)]
        return np.stack([c for c, _ in both], axis=1), np.stack([d for _, d in both], axis=1)


def _vectors(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32).reshape(-1, size).astype(np.int64)


def _sums(books: np.ndarray):
    """Vectors to one line per part and entry: sums of the components assigned to it, and their number."""

    def run(batches):
        cells = Cells(books)
        parts, entries, width = books.shape
        sums, counts = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            q = _vectors(b.column(0), parts * width)
            codes, _ = cells.assign(q)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], q[:, p * width : (p + 1) * width])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p), pa.array(e), pa.array(counts[p, e]), *[pa.array(sums[p, e, i]) for i in range(width)]],
            names=["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    return run


def _codes(books: np.ndarray):
    def run(batches):
        cells = Cells(books)
        parts, _, width = books.shape
        for b in batches:
            if not b.num_rows:
                continue
            codes, distance = cells.assign(_vectors(b.column(2), parts * width))
            text = codes.astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()),
                 pa.array(distance.sum(axis=1))], names=["id", "label", "code", "error"])

    return run


def learn(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of a table of `quantised`, all of whose vectors have `parts * width` components.

    They start as the parts of the vectors with the smallest ids (NULL ids last; of equal ids by the vectors' bytes) and
    are fewer than `entries` where there are fewer vectors. Each round assigns every vector and replaces each entry by the
    floor of its mean; entries without a vector stay.
    """
    first = kept.orderBy(F.asc_nulls_last("id"), "q").select("q").limit(entries).collect()
    books = np.stack([np.frombuffer(r["q"], dtype=np.int32).astype(np.int64).reshape(parts, -1) for r in first], axis=1)
    width = books.shape[2]
    names = [f"s{i}" for i in range(width)]
    lines = "part long, entry long, n long, " + ", ".join(f"{s} long" for s in names)
    for _ in range(rounds):
        sums = kept.select("q").mapInArrow(_sums(books), lines).groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect()
        books = books.copy()
        for r in sums:
            books[r["part"], r["entry"]] = [r[s] // r["n"] for s in names]
    return books


def usable(table: DataFrame, parts: int = PARTS) -> DataFrame:
    """The vectors of one length: that of the smallest id among those that can be cut into equal parts."""
    cut = table.filter(F.col("size") % parts == 0)
    first = cut.orderBy(F.asc_nulls_last("id"), "q").select("size").limit(1).collect()
    return cut.filter(F.col("size") == (first[0]["size"] if first else 0))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, in decimal, with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id column, label column, code, error, label_error) per kept vector, and the codebooks.

    code has two hex digits per part, error is the squared distance to the coded vector, label_error its sum over
    all vectors of the label (NULL labels together). `quantised` says which vectors are dropped; those of another
    length than the first (see `usable`) are dropped too. Repeated rows are coded alike; without any usable
    vector there are no rows and the codebooks are empty.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kept = usable(quantised(vectors, id_col, vector_col, label_col), parts)
    books = learn(kept, parts, entries, rounds) if kept.limit(1).count() else np.zeros((parts, 0, 0), dtype=np.int64)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    coded = written(kept.select("id", "label", "q").mapInArrow(
        _codes(books), f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error long"), "codes")
    keys = {"_missing": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))}
    errors = coded.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.sum("error").alias("label_error"))
    met = attach(coded.withColumns(keys), errors, list(keys))
    return met.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books


ship(__name__)
