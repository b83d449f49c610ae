"""Running sums and interval joins that no key, however frequent, gathers in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut


def running_sum(rows: DataFrame, group: str, order: list[str], value: Column) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of the same group that come before, in a total ``order``.

    Rows are sorted over all tasks by group and order. A task sums its own
    rows of a group; what the tasks before it hold of the group is added from
    one row for each task and group, of which there are as many as tasks and
    groups together. ``order`` has to tell rows of a group apart. Nulls count
    as nothing.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0))).repartitionByRange(parts, group, *order).withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt)
    own = W.partitionBy("_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = dealt.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0)))
    totals = dealt.groupBy(group, "_part").agg(F.sum("_value").alias("_total"))
    # the parts of a group are few: at most one for each task
    earlier = totals.withColumn("_earlier", F.coalesce(F.sum("_total").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    joined = inner.join(earlier.withColumnsRenamed({group: "_group", "_part": "_at"}), (F.col("_group").eqNullSafe(F.col(group))) & (F.col("_at") == F.col("_part")))
    return joined.withColumn("before", F.col("_earlier") + F.col("_own")).select(*rows.columns, "before")


#: Lines in a bin; a span meets others where they share one.
BIN = 256


def _binned(rows: DataFrame, first: str, last: str) -> DataFrame:
    """``rows`` for each bin that the interval has lines in, with ``_a`` and ``_b``: its part of the bin."""
    start = F.col("_bin") * BIN
    each = rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(first) / BIN), F.floor(F.col(last) / BIN))))
    return each.withColumns({"_a": F.greatest(F.col(first).cast("long"), start), "_b": F.least(F.col(last).cast("long"), start + BIN - 1)})


def meeting(spans: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``spans`` (keys, line, end_line) that meet one of ``others`` (keys, first, last), each once.

    Both are cut at the borders of bins. Of the others, a bin keeps the longest
    from each line on, so it has no more of them than lines, however many
    there are. A part of a span looks for them in its own bin alone, so a
    crowded key costs no more than its rows. Intervals that end before they
    start meet nothing.
    """
    used = _binned(others.filter("first <= last").select(*keys, "first", "last").distinct(), "first", "last")
    longest = used.groupBy(*keys, "_bin", "_a").agg(F.max("_b").alias("_b"))
    held = longest.groupBy(*keys, "_bin").agg(F.collect_list(F.struct("_a", "_b")).alias("_held"))
    own = spans.filter("line <= end_line").select(*keys, "line", "end_line").distinct()
    looked = _binned(own, "line", "end_line").join(held, [*keys, "_bin"])
    met = looked.filter(F.exists("_held", lambda x: (x["_a"] <= F.col("_b")) & (x["_b"] >= F.col("_a")))).select(*own.columns).distinct()
    return spans.join(met, own.columns, "left_semi").distinct()
