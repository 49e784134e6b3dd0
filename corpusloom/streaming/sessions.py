"""Idle-gap sessions, as a batch query and as a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def idle_sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, started, n) of runs of events less than ``gap`` apart."""
    window = F.session_window(time, gap)
    return events.groupBy(key, window.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), "n")


def idle_sessions_stream(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """The same on a stream: a session comes out once the watermark has passed its end; later events are dropped."""
    return idle_sessions(events.withWatermark(time, late), key, time, gap)
