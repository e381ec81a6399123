"""Monitoring of a stream: rows are scored one by one, faults are counted in event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.monitor import Monitor, faults


def scored(stream: DataFrame, monitor: Monitor, keep: list[str]) -> DataFrame:
    """T2, Q and fault of each arriving row; stateless."""
    return faults(stream, monitor, keep)


def fault_counts(stream: DataFrame, monitor: Monitor, time: str, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(start, end, fault, n) of tumbling windows; rows later than the watermark are left out."""
    rows = faults(stream.withWatermark(time, late), monitor, [time])
    return rows.groupBy(F.window(time, window), "fault").agg(F.count("*").alias("n")).select("window.start", "window.end", "fault", "n")
