"""Structured Streaming forms of the segmentations, for recordings that are still arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def amplitude_flags(samples: DataFrame, ts: str, key: str, channel: str, value: str, window: str, step: str, late: str, reject: float, flat: float) -> DataFrame:
    """Sliding windows by recording and channel with a flag where their peak-to-peak amplitude is out of range.

    Batch or stream; in a stream, windows close once the watermark passes them (append mode).
    """
    rows = samples.withWatermark(ts, late) if samples.isStreaming else samples
    ptp = rows.groupBy(F.window(ts, window, step), key, channel).agg((F.max(value) - F.min(value)).alias("ptp"), F.count("*").alias("n"))
    flag = F.when(F.col("ptp") > reject, "BAD_peak").when(F.col("ptp") < flat, "BAD_flat")
    return ptp.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, channel, "ptp", "n", flag.alias("flag"))


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Stretches of events without a pause of the gap; an event exactly the gap after another begins a new one.

    Spark joins sessions that touch, so its gap is a microsecond, the step of timestamps, less.
    """
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    s = F.session_window(ts, f"{gap} -1 microseconds").alias("s")
    end = F.col("s.end") + F.expr("INTERVAL 1 MICROSECOND")
    return rows.groupBy(s, key).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), end.alias("end"), key, "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Events without repeats that arrive within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
