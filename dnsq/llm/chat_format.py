"""Conversations as training texts with a loss mask, put together as bytes of whole batches.

Method. For a batch of turns the lengths of all segments (marks, role, text, escapes) are computed as arrays, cumulative
sums give their offsets, and every byte of the roles and texts gets the index of its place; marks and bytes are
then copied into one buffer allocated once, which is the Arrow column. No turn is a Python string on the way.

A turn is `### `, its role, a line end, its text, `</turn>` and a line end. In roles and texts, `\\` comes before
every `\\` and before every place where `### ` or `</turn>` begins (in roles, before line ends too), so all
texts can be read back. The loss mask covers the text of the turns of one role.

Turns are sorted by ranges of (conversation, turn), so a conversation with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, ship
from .words import text_buffer

OPEN, CLOSE, ESCAPE = b"### ", b"</turn>", b"\\"
TAIL = CLOSE + b"\n"
LEARNED = "assistant"
PIECE_BYTES = 16 << 20  # roles and texts from which a conversation is written in several pieces
_STEP = 4 << 20  # bytes whose places are computed at a time

_TURN = re.compile(r"### ((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def marks(data: np.ndarray, offsets: np.ndarray, controls: tuple[bytes, ...]) -> np.ndarray:
    """Places of the bytes that get an escape: of `\\` and of the first byte of each control string within one text."""
    places = [np.flatnonzero(data == ESCAPE[0])]
    for c in controls:
        at = np.flatnonzero(data == c[0])
        at = at[at + len(c) <= offsets[np.searchsorted(offsets, at, side="right")]] if len(at) else at
        for i in range(1, len(c)):
            at = at[data[at + i] == c[i]]
        places.append(at)
    return np.sort(np.concatenate(places))


def _scatter(out: np.ndarray, data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, escapes: np.ndarray) -> None:
    """Copies all texts into `out`, each from its place `begin` on, with the escapes before the marked bytes."""
    before = np.searchsorted(escapes, offsets[:-1])
    shift = begin - offsets[:-1] - before
    for lo in range(0, len(data), _STEP):
        hi = min(len(data), lo + _STEP)
        rows = slice(np.searchsorted(offsets, lo, side="right") - 1, np.searchsorted(offsets, hi, side="left"))
        sizes = np.minimum(offsets[1:][rows], hi) - np.maximum(offsets[:-1][rows], lo)
        place = np.arange(lo, hi) + np.repeat(shift[rows], sizes)
        mine = escapes[np.searchsorted(escapes, lo) : np.searchsorted(escapes, hi)]
        passed = np.zeros(hi - lo, dtype=np.int64)
        passed[mine - lo] = 1
        place += np.cumsum(passed) + np.searchsorted(escapes, lo)
        out[place] = data[lo:hi]
        out[place[mine - lo] - 1] = ESCAPE[0]


def _points(out: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Code points between consecutive edges."""
    first = (out & 0xC0) != 0x80
    sizes = np.diff(edges)
    counts = np.zeros(len(sizes), dtype=np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        counts[some] = np.add.reduceat(first, edges[:-1][some], dtype=np.int64)
    return counts


def assemble(roles: pa.Array, texts: pa.Array, learned: str = LEARNED):
    """Buffer of all turns one after the other, the n + 1 byte offsets of the turns, and per turn its code points, the
    code points before its text and of its text, and whether the loss mask covers it."""
    r, r_at = text_buffer(roles)
    t, t_at = text_buffer(texts)
    r_marks, t_marks = marks(r, r_at, (OPEN, CLOSE, b"\n")), marks(t, t_at, (OPEN, CLOSE))
    r_size = np.diff(r_at) + np.diff(np.searchsorted(r_marks, r_at))
    t_size = np.diff(t_at) + np.diff(np.searchsorted(t_marks, t_at))
    size = len(OPEN) + r_size + 1 + t_size + len(TAIL)
    start = np.concatenate(([0], np.cumsum(size)))
    role_at = start[:-1] + len(OPEN)
    text_at = role_at + r_size + 1
    tail_at = text_at + t_size
    buffer = pa.allocate_buffer(int(start[-1]))
    out = np.frombuffer(buffer, dtype=np.uint8)
    out[start[:-1, None] + np.arange(len(OPEN))] = np.frombuffer(OPEN, dtype=np.uint8)
    out[text_at - 1] = 0x0A
    out[tail_at[:, None] + np.arange(len(TAIL))] = np.frombuffer(TAIL, dtype=np.uint8)
    _scatter(out, r, r_at, role_at, r_marks)
    _scatter(out, t, t_at, text_at, t_marks)
    edges = np.stack((start[:-1], text_at, tail_at), axis=1).reshape(-1)
    head, body, tail = _points(out, np.append(edges, start[-1])).reshape(-1, 3).T
    masked = pc.fill_null(pc.equal(roles, learned), False).to_numpy(zero_copy_only=False)
    return buffer, start, head + body + tail, head, body, masked


def _runs(ids) -> np.ndarray:
    """First row of each stretch of equal ids; NULLs are equal."""
    if len(ids) < 2:
        return np.arange(len(ids))
    a, b = ids[:-1], ids[1:]
    same = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.and_(pc.is_null(a), pc.is_null(b)), pc.equal(a, b))
    return np.concatenate(([0], np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1))


def _pieces(learned: str):
    def formatted(rows: pa.RecordBatch, begins: np.ndarray, number: int, open_first: bool, open_last: bool):
        """One row per conversation of `rows`, whose conversations begin at these rows."""
        buffer, start, points, head, body, masked = assemble(rows.column(1), rows.column(2), learned)
        ends = np.append(begins[1:], rows.num_rows)
        before = np.concatenate(([0], np.cumsum(points)))[:-1]
        base = np.repeat(before[begins], ends - begins)
        spans = pa.StructArray.from_arrays(
            [pa.array((before - base + head)[masked]), pa.array((before - base + head + body)[masked])], names=["start", "end"])
        masks = np.concatenate(([0], np.cumsum(masked)))[np.append(begins, rows.num_rows)]
        offsets = start[np.append(begins, rows.num_rows)]
        texts = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(offsets.astype(np.int32)), buffer])
        whole = np.ones(len(begins), dtype=bool)
        whole[0] &= not open_first
        whole[-1] &= not open_last
        return pa.RecordBatch.from_arrays(
            [rows.column(0).take(pa.array(begins)), pa.array(number + np.arange(len(begins))), pa.array(whole),
             pa.array(ends - begins), texts, pa.ListArray.from_arrays(pa.array(masks.astype(np.int32)), spans)],
            names=["id", "piece", "whole", "n_turns", "text", "loss"])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held, open_first = None, True
        for b in batches:
            if not b.num_rows:
                continue
            rows = b if held is None else pa.concat_batches([held, b])
            begins = _runs(rows.column(0))
            last = int(begins[-1])
            if last:
                yield formatted(rows.slice(0, last), begins[:-1], number, open_first, False)
                number, open_first = number + len(begins) - 1, False
            held = rows.slice(last)
            if held.get_total_buffer_size() > PIECE_BYTES and sum(c.nbytes for c in held.columns) > PIECE_BYTES:
                yield formatted(held, np.array([0]), number, open_first, True)
                number, held, open_first = number + 1, None, True
        if held is not None:
            yield formatted(held, np.array([0]), number, open_first, True)

    return run


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", learned: str = LEARNED) -> DataFrame:
    """(conversation column, piece, whole, n_turns, text, loss) per piece of a conversation.

    A conversation is one piece, unless it holds more than PIECE_BYTES or lies on the edge of two ranges; its pieces in order
    of `piece`, joined, are its text, and no turn is cut. `whole` is true where a piece is known to be all of its
    conversation. loss lists the (start, end) of the texts under the mask, in code points of the piece. NULL roles and texts are
    empty. Turns with equal numbers are ordered by role, then text; repeated rows stay. NULL turns come first; NULL
    conversations are one. An empty table gives no rows.
    """
    bound_batches(turns.sparkSession)
    kind = turns.schema[conv_col].dataType.simpleString()
    plain = turns.select(
        F.col(conv_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = plain.repartitionByRange("id", "turn", "role").sortWithinPartitions("id", "turn", "role", "text")
    return ordered.select("id", "role", "text").mapInArrow(
        _pieces(learned), f"id {kind}, piece long, whole boolean, n_turns long, text string, "
                          "loss array<struct<start:long, end:long>>").withColumnRenamed("id", conv_col)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def turns_of(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted piece."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        out.append((unescaped(m.group(1)), unescaped(m.group(2))))
        at = m.end()
    return out


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, loss: list[dict]) -> None:
        for role, said in turns_of(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        for span in loss:
            said = unescaped(text[span["start"] : span["end"]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_COLUMNS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_TYPES = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_whole(batches):
    """Digests of whole conversations; other pieces keep their text for the next step."""
    for b in batches:
        rows = []
        for whole, text, loss in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()):
            if whole:
                d = _Digest()
                d.add(text, loss)
                rows.append((*d.row(), None, None))
            else:
                rows.append((None, None, None, None, None, text, loss))
        columns = list(zip(*rows)) or [()] * 7
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(),
                 pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(columns, types)]],
            names=["id", "piece", *_COLUMNS, "text", "loss"])


def _read_pieces(batches):
    """Sorted rows of `_read_whole` to one row per conversation; the digest of one is open at a time."""
    current, digest, kind = None, None, None

    def closed():
        return pa.RecordBatch.from_arrays(
            [pa.array([current], kind), *[pa.array([v]) for v in digest.row()]], names=["id", *_COLUMNS])

    for b in batches:
        ids, kind, done = b.column(0).to_pylist(), b.column(0).type, []
        for i, text in enumerate(b.column(7).to_pylist()):
            if digest is not None and (text is None or ids[i] != current):
                yield closed()
                digest = None
            if text is None:
                done.append(i)
                continue
            if digest is None:
                current, digest = ids[i], _Digest()
            digest.add(text, b.column(8)[i].as_py())
        yield b.take(pa.array(done, pa.int64())).select(["id", *_COLUMNS])
    if digest is not None:
        yield closed()


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What a reader of the formatted pieces sees, one row per conversation: (conversation column, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars). Texts of pieces that are not whole move to the task of their conversation,
    where one piece is in memory at a time; of the others only digests do. No pieces give no rows."""
    kind = formatted.schema[conv_col].dataType.simpleString()
    read = formatted.select(F.col(conv_col).alias("id"), "piece", "whole", "n_turns", "text", "loss").mapInArrow(
        _read_whole, f"id {kind}, piece long, {_TYPES}, text string, loss array<struct<start:long, end:long>>")
    return read.repartition("id").sortWithinPartitions("id", "piece").mapInArrow(
        _read_pieces, f"id {kind}, {_TYPES}").withColumnRenamed("id", conv_col)


ship(__name__)
