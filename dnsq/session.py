"""Session helpers: settings, lineage cuts and size-checked joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows, and bytes of their text form, up to which a side of a join may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Rows of one key from which a join treats the key as hot. N rows have at most N / HOT_ROWS hot keys,
# so the list of them is short for any N.
HOT_ROWS = 5_000_000
SALTS = 32


def build_session(app: str = "dnsq", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library relies on; `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a fresh local one only for a local master (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dnsq-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a cached or local copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
           rows: int | None = None) -> DataFrame:
    """Equi-join whose small side is unique on `on`, safe when one key of `big` is hot.

    `rows` is an upper bound of the small side (of narrow rows) where the caller knows one; else at most
    BROADCAST_ROWS + 1 of its rows are counted and measured. Up to the limits it is broadcast, so the big side
    does not move. Beyond it, the hot keys of `big` are looked up first (a partial aggregation);
    rows with a hot key get a salt, and only those keys of the small side are repeated per salt.
    """
    size = 0
    if rows is None:
        rows, size = small.limit(BROADCAST_ROWS + 1).agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    hot = cut_lineage(
        big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS)
        .select(*on, F.lit(True).alias("_hot")))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = small.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    # The salt is taken from the row itself, so a task that runs again salts the same way. Maps cannot be hashed.
    hashed = [f.name for f in big.schema.fields if "map<" not in f.dataType.simpleString()]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")).otherwise(0)
    spread = big.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_hot")
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")
