"""Token shards in training order: a keyed permutation gives every sequence its place in the run.

Method. The tokens of a partition's documents (each closed by an end token) are one stream, cut into sequences of
`length` ids. Sequences are numbered through all partitions, 0 to N - 1. A Feistel network over the next power of
four is a keyed bijection; numbers that fall beyond N are sent through it again until they fall inside
(cycle-walking), which makes it a permutation of 0 to N - 1. So a sequence's slot follows from its number and the key
alone: no sort, no shared state, and the order of the run can be repeated or resumed.

Slots are cut into ranges of equal size. One task writes one range as one shard: sequence s of a shard lies at
byte s * stride, so a reader seeks to any slot and reads on from there. A shard is written under another name and
moved into its place, and a task that runs again writes the same bytes.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, ship, written
from .tokens import words_of
from .words import mix

LENGTH = 2048
SHARD_SEQUENCES = 2048  # 8 MB of 2-byte ids
BLOCK_SEQUENCES = 512
END, PAD = 1, 0
ROUNDS = 6


def slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The permutation of 0 to n - 1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & ((1 << 64) - 1)))

    def through(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << shift) | right

    out = through(numbers.astype(np.uint64))
    beyond = np.flatnonzero(out >= n)
    while len(beyond):
        out[beyond] = through(out[beyond])
        beyond = beyond[out[beyond] >= n]
    return out.astype(np.int64)


def _blocks(tokenizer: str, length: int, dtype: str):
    """Batches of texts to rows (part, first, n, ids): compressed runs of whole sequences."""

    def run(batches):
        part, first = TaskContext.get().partitionId(), 0
        words, held = words_of(tokenizer), np.empty(0, dtype=dtype)
        codec = pa.Codec("zstd", 3)

        def rows(ids: np.ndarray):
            nonlocal first
            step = BLOCK_SEQUENCES * length
            for i in range(0, len(ids), step):
                raw = ids[i : i + step].tobytes()
                n = len(ids[i : i + step]) // length
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int64()), "first": pa.array([first], pa.int64()), "n": pa.array([n], pa.int64()),
                    "ids": pa.array([codec.compress(raw, asbytes=True)], pa.binary())})
                first += n

        for b in batches:
            ids, starts, *_ = words.encode(b.column(0))
            if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
                raise ValueError("this vocabulary needs wider ids")
            held = np.concatenate((held, np.insert(ids, starts[1:], END).astype(dtype)))
            whole = len(held) // (BLOCK_SEQUENCES * length) * BLOCK_SEQUENCES * length
            yield from rows(held[:whole])
            held = held[whole:]
        if len(held):
            yield from rows(np.concatenate((held, np.full(-len(held) % length, PAD, dtype=dtype))))

    return run


def _dealt(bases: dict[int, int], n: int, key: int, shard: int, length: int, dtype: str):
    """Blocks to rows (shard, slot, sequence, ids) of one sequence each."""
    stride = length * np.dtype(dtype).itemsize

    def run(batches):
        codec = pa.Codec("zstd", 3)
        for b in batches:
            for part, first, count, blob in zip(*(c.to_pylist() for c in b.columns)):
                raw = codec.decompress(blob, count * stride, asbytes=True)
                number = np.arange(count) + (bases[part] + first)
                slot = slots(number, n, key)
                cut = [codec.compress(raw[i * stride : (i + 1) * stride], asbytes=True) for i in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot // shard), pa.array(slot), pa.array(number), pa.array(cut, pa.binary())],
                    names=["shard", "slot", "sequence", "ids"])

    return run


def file_system(path: str):
    """File system and path of a folder given by address or by absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def shard_name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def _shard_writer(path: str, shard_size: int, length: int, dtype: str):
    stride = length * np.dtype(dtype).itemsize

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        codec = pa.Codec("zstd", 3)
        shard = table["shard"][0].as_py()
        parts = [codec.decompress(x.as_py(), stride, asbytes=True) for x in table["ids"]]
        system, folder = file_system(path)
        name = shard_name(folder, shard)
        other = f"{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(other) as out:
            for p in parts:
                out.write(p)
        system.move(other, name)
        slot = table["slot"].to_numpy()
        return pa.table({"slot": slot, "sequence": table["sequence"], "shard": table["shard"],
                         "byte_offset": (slot - shard * shard_size) * stride,
                         "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())})

    return run


def materialise(docs: DataFrame, tokenizer: str, key: int, path: str | None = None, text_col: str = "text",
                length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, dtype: str = "<u2") -> tuple[DataFrame, str]:
    """Writes the shards under `path` (default: a new folder among the shared ones) and returns one row per
    sequence with that path: slot, sequence, shard, byte_offset, ids_crc32. The frame is lazy, and computing it
    writes the files.

    Tokens keep the order of the rows within a partition. NULL and empty texts are the end token alone, repeated
    rows are tokens again, other columns are not read, and an empty table gives no rows and no files. The last sequence
    of a partition is filled up with PAD.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or fresh_path(spark, "shards")
    system, folder = file_system(path)
    system.create_dir(folder, recursive=True)
    blocks = docs.select(F.col(text_col).alias("text")).mapInArrow(
        _blocks(tokenizer, length, dtype), "part long, first long, n long, ids binary")
    blocks = written(blocks, "token-blocks", "uncompressed")
    # One line per task of the step above.
    sizes = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
    bases, n = {}, 0
    for part, size in sizes:
        bases[part], n = n, n + size
    dealt = blocks.mapInArrow(_dealt(bases, n, key, shard_sequences, length, dtype),
                              "shard long, slot long, sequence long, ids binary")
    return dealt.groupBy("shard").applyInArrow(
        _shard_writer(path, shard_sequences, length, dtype),
        "slot long, sequence long, shard long, byte_offset long, ids_crc32 long"), path


def read_slots(path: str, first: int, count: int, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES,
               dtype: str = "<u2"):
    """Sequences from slot `first` on, read in order: what a training run does when it starts or resumes."""
    stride = length * np.dtype(dtype).itemsize
    system, folder = file_system(path)
    while count > 0:
        shard, at = divmod(first, shard_sequences)
        take = min(count, shard_sequences - at)
        with system.open_input_file(shard_name(folder, shard)) as f:
            f.seek(at * stride)
            raw = f.read(take * stride)
        for i in range(0, len(raw), stride):
            yield np.frombuffer(raw[i : i + stride], dtype=dtype)
        first, count = first + take, count - take if len(raw) == take * stride else 0


ship(__name__)
