"""Documents packed into training windows without changing their order.

Method. A partition's documents are one stream of tokens, each document closed by an end token. Windows
are stretches of the stream of at most `width` tokens, cut at document ends, at sentence ends or, where neither
comes within a window's width, at forced places. The cuts minimise padding plus penalties for cutting inside
a document: best[j] = penalty[j] + width - at[j] + min over i within reach of (best[i] + at[i]). The
minimum over the sliding reach comes from a monotone queue, so that each place enters and leaves once.

The stream is packed in blocks; what follows a block's last good cut is carried into the next, so only the last
window of a partition may be short. Nothing is shuffled, and memory is bounded by a block and one document.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, ship
from .tokens import words_of
from .words import binaries

WIDTH = 2048
END = 1  # id that closes a document
SENTENCE_PENALTY = 16  # cutting a document at a sentence end costs as much as so many padded places
FORCED_PENALTY = 256
BLOCK_TOKENS = 1_000_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def best_cuts(at: np.ndarray, penalty: np.ndarray, width: int, closed: bool) -> list[int]:
    """Indexes into `at` of the chosen cuts, the first place (0) left out.

    `at` ascends from 0 with steps of at most `width`. If closed, the last place is a cut; else the last cut is the
    best one among those from which the end can be reached.
    """
    places, cost = at.tolist(), penalty.tolist()
    n = len(places)
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque()  # (best + at, index), ascending
    for j in range(1, n):
        key = best[j - 1] + places[j - 1]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j - 1))
        here = places[j]
        while here - places[queue[0][1]] > width:
            queue.popleft()
        least, i = queue[0]
        best[j] = least + width - here + cost[j]
        back[j] = i
    j = n - 1
    if not closed:
        # Nothing is paid yet for the open rest; a longer rest is dearer by what a full window would hold.
        j = min((i for i in range(n) if places[-1] - places[i] <= width), key=lambda i: best[i] + places[i])
    cuts = []
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def _with_forced(at: np.ndarray, penalty: np.ndarray, width: int, forced: int) -> tuple[np.ndarray, np.ndarray]:
    """Places added where a step is wider than a window."""
    wide = np.flatnonzero(np.diff(at) > width)
    if len(wide) == 0:
        return at, penalty
    more = np.concatenate([np.arange(at[i] + width, at[i + 1], width) for i in wide])
    where = np.searchsorted(at, more)
    return np.insert(at, where, more), np.insert(penalty, where, forced)


class _Stream:
    """The open part of a partition's token stream."""

    def __init__(self, part: int, width: int, sentence: int, forced: int) -> None:
        self.width, self.sentence, self.forced = width, sentence, forced
        self.number = part << 32
        self.ids = np.empty(0, dtype=np.uint32)
        self.at = np.empty(0, dtype=np.int64)  # ends of documents and sentences
        self.penalty = np.empty(0, dtype=np.int64)
        self.first = np.empty(0, dtype=np.int64)  # where each document starts; the first may be below 0
        self.doc, self.tokens = np.empty(0, dtype=object), np.empty(0, dtype=np.int64)

    def add(self, doc, ids, starts, word_ends, closes) -> None:
        """Documents with their ids, each closed by the end token."""
        n = np.diff(starts)
        ids = np.insert(ids, starts[1:], END)
        row = np.searchsorted(starts[1:], word_ends[closes], side="left")
        sentence = word_ends[closes] + row
        ends = starts[1:] + np.arange(1, len(starts))
        at, kind = np.unique(np.concatenate((ends, sentence)), return_index=True)
        base = len(self.ids)
        self.at = np.concatenate((self.at, at + base))
        self.penalty = np.concatenate((self.penalty, np.where(kind < len(ends), 0, self.sentence)))
        self.first = np.concatenate((self.first, base + ends - n - 1))
        self.ids = np.concatenate((self.ids, ids))
        self.doc = np.concatenate((self.doc, np.array(doc, dtype=object)))
        self.tokens = np.concatenate((self.tokens, n + 1))

    def take(self, closed: bool) -> pa.RecordBatch | None:
        """The pieces of all windows that are settled; the rest stays."""
        if len(self.ids) == 0:
            return None
        at, penalty = np.insert(self.at, 0, 0), np.insert(self.penalty, 0, 0)
        at, penalty = _with_forced(at, penalty, self.width, self.forced)
        windows = np.insert(at[best_cuts(at, penalty, self.width, closed)], 0, 0)
        end = int(windows[-1])
        if end == 0:
            return None
        starts = np.union1d(self.first[(self.first > 0) & (self.first < end)], windows[:-1])
        doc = np.searchsorted(self.first, starts, side="right") - 1
        window = np.searchsorted(windows, starts, side="right") - 1
        edges = np.append(starts, end)
        out = pa.RecordBatch.from_arrays([
            pa.array(self.doc[doc].tolist(), pa.int64()), pa.array(starts - self.first[doc]), pa.array(np.diff(edges)),
            binaries(self.ids[:end].astype("<u4"), edges), pa.array(self.tokens[doc]),
            pa.array(self.number + window), pa.array(starts - windows[window])],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        self.number += len(windows) - 1
        kept = int(np.searchsorted(self.first + self.tokens, end, side="right"))
        self.ids = self.ids[end:]
        self.penalty, self.at = self.penalty[self.at > end], self.at[self.at > end] - end
        self.first, self.doc, self.tokens = self.first[kept:] - end, self.doc[kept:], self.tokens[kept:]
        return out


def _packed(tokenizer: str, width: int, sentence: int, forced: int):
    def run(batches):
        stream = _Stream(TaskContext.get().partitionId(), width, sentence, forced)
        words = words_of(tokenizer)
        for b in batches:
            if b.num_rows:
                stream.add(b.column(0).to_pylist(), *words.encode(b.column(1)))
            if len(stream.ids) >= BLOCK_TOKENS:
                out = stream.take(closed=False)
                if out is not None:
                    yield out
        out = stream.take(closed=True)
        if out is not None:
            yield out

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
         sentence_penalty: int = SENTENCE_PENALTY, forced_penalty: int = FORCED_PENALTY) -> DataFrame:
    """One row per piece of a document in a window: doc_id, start (ids of the document before the piece),
    length, ids (little-endian unsigned 32-bit), doc_tokens (with the end token), sequence_id, offset.

    Windows follow the order of the rows in each partition; sequence ids ascend with it and are distinct over all
    partitions. Each id of a document lies in exactly one piece. NULL and empty texts are the end token alone; a
    NULL id stays NULL; repeated rows are packed once each. Other columns are not read. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packed(tokenizer, width, sentence_penalty, forced_penalty), PIECES)


ship(__name__)
