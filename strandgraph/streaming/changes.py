"""Streams of changes against fixed relations; an extension of the impact query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touched(changes: DataFrame, relations: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """How often each id was reached in a window of event time: window, id, n.

    ``changes`` is a stream of (id, ts); ``relations`` (src, dst) is static.
    Late changes are dropped after ``watermark``.
    """
    reached = changes.withWatermark("ts", watermark).join(relations, changes.id == relations.src).select("ts", F.col("dst").alias("id"))
    return reached.groupBy(F.window("ts", window), "id").agg(F.count("*").alias("n"))


def latest(changes: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """The last change of each path in a window: window, path, status."""
    last = F.max_by("status", "ts").alias("status")
    return changes.withWatermark("ts", watermark).groupBy(F.window("ts", window), "path").agg(last)
