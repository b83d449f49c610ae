"""Lineage cut through the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Used only where the session names no shared folder and runs in one JVM.
LOCAL_DEFAULT = "file:///tmp/checkpoints"


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` as written to the checkpoint folder; survives the loss of executors."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or LOCAL_DEFAULT)
    return frame.checkpoint()
