"""Time values of alerts: normalisation and delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def parse_time(text: Column) -> Column:
    """Epoch digits or ISO text as a timestamp; NULL for anything else."""
    stripped = F.trim(text)
    epoch = F.timestamp_seconds(F.when(stripped.rlike(r"^\d+$"), stripped).try_cast("double"))
    iso = F.when(stripped.rlike(r"^\d{4}-\d\d-\d\d"), stripped).try_cast("timestamp")
    return F.coalesce(epoch, iso)


def normalise_time(text: Column) -> Column:
    """ISO text with microseconds; NULL for blank; a text that is no time is kept as it is."""
    stripped = F.trim(text)
    return F.when(stripped != "", F.coalesce(F.date_format(parse_time(text), ISO_MICROS), text))


def delay_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end to 6 places; NULL when either is missing or it is negative."""
    gap = F.unix_micros(end) - F.unix_micros(start)
    return F.when(gap >= 0, F.round(gap / 1_000_000, 6))


def stage_delays(logged: Column, row_seen: Column, detected: Column) -> Column:
    return F.struct(
        delay_seconds(logged, row_seen).alias("source_to_row_seen_seconds"),
        delay_seconds(row_seen, detected).alias("row_seen_to_detected_seconds"),
        delay_seconds(logged, detected).alias("source_to_detected_seconds"),
    )
