"""Shared pieces: reading, tables written to the shared folder, batch sizes, size-checked joins."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

# Rows of one Arrow batch. A row holds a whole text, so batches stay small; Spark cuts them by bytes too.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20
# Rows of (key) up to which a side of a join is broadcast: 16 bytes each, some 30 MB.
SMALL_KEYS = 500_000


def ship(name: str) -> None:
    """Functions of this module travel with the task; executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches bounded in rows and bytes, for texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


PART_ROWS = 200_000


def written(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back. It cuts lineage, survives lost
    executors and is computed once however often it is used.

    `rows` is about how many narrow rows it has, where the caller knows: they are then written by as many
    tasks as they need rather than by one per shuffle partition.
    """
    path = fresh_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(8, rows // PART_ROWS))
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side(table: DataFrame) -> DataFrame:
    """A written table of narrow rows as the side of a join: broadcast up to SMALL_KEYS rows (counted from the file
    footers), else joined as the optimiser sees fit."""
    return F.broadcast(table) if table.count() <= SMALL_KEYS else table


def fold_ascii(text) -> F.Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id, folds: int = 5) -> F.Column:
    """Documents kept out of training: crc32 of the id's text, remainder 0. A missing id counts as "" (0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


ship(__name__)
