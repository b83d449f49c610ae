"""Shared-folder tables that cut lineage, and the joins that isolate hot keys."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs in one JVM.
LOCAL_DEFAULT = "file:///tmp/checkpoints"

#: Keys that hold more than 1/HOT_SHARE of the rows are joined by broadcast;
#: there can be no more than HOT_SHARE of them, whatever the size of the data.
HOT_SHARE = 1000

#: Rows among which frequent keys are looked for.
SAMPLE_ROWS = 400_000

#: What a table takes in memory, at most, for a byte of its compressed files.
BROADCAST_BLOWUP = 8

#: Bytes of a kept table that one task works on, where a step's rows are no more than the table's.
TASK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is set to a local folder only where it is unset and the master is local.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_DEFAULT


class Scratch:
    """Intermediate tables of one operator run, written to the shared folder.

    A written table survives the loss of any executor and is read back with
    no lineage. ``drop`` frees a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, operator: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{operator}-{uuid.uuid4().hex}"

    def keep(self, frame: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}"
        frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, label: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written_bytes(frame: DataFrame) -> int:
    """Bytes of the files that a kept table is read from, as its plan knows them."""
    return int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def dealt_like(frame: DataFrame, kept: DataFrame) -> DataFrame:
    """``frame`` in as many tasks, at most, as the size of the kept table asks for: small steps don't take all partitions of a shuffle."""
    return frame.coalesce(1 + written_bytes(kept) // TASK_BYTES)


def fits(kept: DataFrame, megabytes: int) -> bool:
    """Whether the files of a kept table times BROADCAST_BLOWUP are within the bound."""
    return written_bytes(kept) * BROADCAST_BLOWUP <= megabytes << 20


def bounded_bytes(frame: DataFrame, megabytes: int) -> DataFrame:
    """A kept table, to be broadcast if its files times BROADCAST_BLOWUP are within the bound; else joins shuffle it."""
    return F.broadcast(frame) if fits(frame, megabytes) else frame


def frequent(scratch: Scratch, rows: DataFrame, key: str) -> DataFrame:
    """Keys with more than 1/HOT_SHARE of the rows, as a sample of them tells; no more than HOT_SHARE of them.

    It only decides where rows meet: a key that the sample misses is handled
    as any other, and one that it finds in vain as a frequent one.
    """
    share = max(1, rows.count() // SAMPLE_ROWS)
    drawn = rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(share)) == 0)
    counts = scratch.keep(drawn.groupBy(key).agg(F.count("*").alias("rows")), f"drawn-{key}")
    least = max(1, (counts.agg(F.sum("rows")).first()[0] or 0) / HOT_SHARE)
    return counts.filter(F.col("rows") > least).select(key)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for what is planned inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: Column, megabytes: int = 0) -> DataFrame:
    """Left join to ``right``, which has one row a key and in ``weight`` the left rows of that key.

    A kept table within ``megabytes`` (see ``bounded_bytes``) is broadcast.
    Else keys above 1/HOT_SHARE of all rows (at most HOT_SHARE keys) meet in a
    broadcast join; the rest meet in a shuffle join in which no key is hot.
    ``spread`` gives a left row a value of the last key that no right row has,
    so that rows already served do not gather under one key.
    """
    values = [c for c in right.columns if c not in keys]
    if megabytes and fits(right, megabytes):
        return left.join(F.broadcast(right), keys, "left").select(*left.columns, *values)
    total = right.agg(F.sum(weight)).first()[0] or 0
    least = total / HOT_SHARE
    hot = right.filter(F.col(weight) > least)
    cold = right.filter(F.col(weight) <= least)
    served = left.join(F.broadcast(hot.select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in values])), keys, "left")
    found = F.col(f"_hot_{weight}").isNotNull()
    last = keys[-1]
    served = served.withColumn("_join", F.when(found, spread).otherwise(F.col(last)))
    cold = cold.select(*keys[:-1], F.col(last).alias("_join"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    joined = served.join(cold, [*keys[:-1], "_join"], "left")
    return joined.select(*left.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values])
