"""Append-only turn log from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def turn_log(stream: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Turns with an event-time watermark, each (session, turn) once; late repeats are dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark(["session_id", "turn_index"])
