"""Streaming jobs. Sources are directories of finished files; progress is kept in the checkpoint.

Batches are written into a folder of their own that is replaced when a batch runs again, so a
restart after a failure neither loses nor repeats rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import alerts as A, delays as DL, domains as DO, flow_features as FF, models as MO
from ..operators.flows import FlowLimits, assign_flows
from ..plans.jobs import dga_detection, typo_detection
from ..session import cut_lineage


def start(rows: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
          interval: str | None = "1 second", fmt: str = "json") -> StreamingQuery:
    """Run `handle` on every micro-batch and write its result to `out`/batch=<id>.

    `interval` None processes what is there and stops.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        handle(batch).write.mode("overwrite").format(fmt).save(f"{out}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def start_chain(rows: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], out: str, checkpoint: str,
                interval: str | None = "1 second") -> StreamingQuery:
    """Run every micro-batch through all `steps`, each on what the step before it wrote.

    Step `name` writes Parquet to `out`/name/batch=<id> and the next one reads that folder, so no step is computed
    twice. A batch that runs again replaces its folders from the first step on, so all steps stay in line.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        for name, step in steps.items():
            done = step(batch)
            place = f"{out}/{name}/batch={batch_id}"
            done.write.mode("overwrite").parquet(place)
            batch = batch.sparkSession.read.schema(done.schema).parquet(place)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


# Handlers for `start`: micro-batch in, alerts out. A batch is scored per distinct name.

def dga_handler(bundle: MO.Bundle, threshold: float = A.DGA_THRESHOLD) -> Callable[[DataFrame], DataFrame]:
    return lambda lines: dga_detection(lines, bundle, threshold=threshold)


def typo_handler(bundle: MO.Bundle | None, protected: DataFrame, threshold: float = A.TYPO_THRESHOLD,
                 top_n: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """With a bundle the model scores the candidates, else `matching.linear_scorer` does."""
    return lambda lines: typo_detection(lines, protected, bundle, top_n, threshold=threshold)


def tunnel_handler(bundle: MO.Bundle, threshold: float = A.TUNNEL_THRESHOLD) -> Callable[[DataFrame], DataFrame]:
    """Flow rows to alerts, named by `alerts.row_index`."""
    def handle(flows: DataFrame) -> DataFrame:
        seen = flows.withColumn("row_index", A.row_index(flows))
        scored = MO.score_flows(seen, bundle, batch=False)
        missing = MO.missing_columns(bundle.feature_columns, flows.columns)
        return A.tunnel_alerts(scored, F.current_timestamp(), F.current_timestamp(), threshold, missing,
                               hard_labels=not MO._has_probabilities(bundle))

    return handle


def chunk_handler(features: Callable[[DataFrame], DataFrame], limits: FlowLimits = FlowLimits(),
                  keep: bool = True) -> Callable[[DataFrame], DataFrame]:
    """Packet files to flow features, every file by itself: no flow crosses a file.

    The rows need a column `chunk` (the file's name), which joins the transaction id and the
    addresses in the key. Files number their packets from 0 each, so `flow_uid` becomes the text
    chunk:number, which is unique over all files. A file is read by few tasks, so its packets are spread and kept
    (`keep`, see `assign_flows`).
    """
    def handle(packets: DataFrame) -> DataFrame:
        if "chunk" not in packets.columns:
            raise ValueError("packet rows need the column chunk")
        return features(assign_flows(packets, limits, keep).withColumn("flow_uid", F.concat_ws(":", "chunk", "flow_uid")))

    return handle


def live_chain(bundle: MO.Bundle, limits: FlowLimits = FlowLimits(), threshold: float = A.TUNNEL_THRESHOLD,
               **options) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Steps for `start_chain`: packet files to flow features to tunnelling alerts. `options` are those of
    `flow_features`; the assignment feeds several aggregations, so it is kept."""
    return {
        "flows": chunk_handler(lambda assigned: FF.flow_features(cut_lineage(assigned), **options), limits, False),
        "alerts": tunnel_handler(bundle, threshold),
    }


# Delay report over two streams. Each stream adds one row per name and micro-batch, the earliest time in it; the
# report takes the earliest of these rows, so it equals the batch report over all lines and alerts read so far,
# however late a line or an alert comes.

def seen_handler(lines: DataFrame) -> DataFrame:
    """Log lines to the first time of each name in this micro-batch."""
    return DL.first_seen(DO.parse_queries(lines))


def detected_handler(alerts: DataFrame) -> DataFrame:
    """Alert rows to the first tunnelling alert of each name in this micro-batch."""
    return DL.first_detected(alerts)


def delays_so_far(seen: DataFrame, detected: DataFrame) -> DataFrame:
    """`delays.delay_rows` of what both streams have written."""
    first_seen = seen.groupBy("domain").agg(F.min("first_seen_at").alias("first_seen_at"))
    first_detected = detected.groupBy("domain").agg(F.min("first_detected_at").alias("first_detected_at"))
    return DL.delay_rows(first_seen, first_detected)
