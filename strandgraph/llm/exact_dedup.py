"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. Distinct blocks are
sorted and numbered: a block's number is its name. Adjacent names are then
paired, distinct pairs are sorted and numbered, and so on until a text has one
name. Two texts end with the same name at the same level exactly if all their
blocks are equal, so the name is an identity without collisions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table
from ._scratch import Scratch, join_counted

BLOCK_BYTES = 4096


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        body.alias("body"),
        F.greatest(F.lit(1), F.ceil(F.octet_length(body) / block_bytes)).cast("int").alias("blocks"),
    )
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("pos"))
    return rows.withColumn("block", F.substring("body", F.col("pos") * block_bytes + 1, F.lit(block_bytes)))


def _numbered(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows sorted within the partitions they were dealt to, and numbered."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _first_names(scratch: Scratch, docs: DataFrame, block_bytes: int, route: Callable[[Column], Column]) -> DataFrame:
    """Every block occurrence with its name.

    Contents are shuffled once, after equal ones have met on the map side.
    Occurrences then find their name by a 64-bit route. Routes that more than
    one distinct block has taken are found, and settled by content.
    """
    routed = _blocks(docs, block_bytes).withColumn("route", route(F.col("block")))
    distinct = routed.groupBy("block").agg(F.count("*").alias("uses"))
    names = scratch.keep(_numbered(distinct, ["block"]).select(route(F.col("block")).alias("route"), "name", "uses"), "names")
    shared = scratch.keep(names.groupBy("route").count().filter("count > 1").select("route"), "shared")
    sha = F.when(F.col("pos") == 0, F.sha2("body", 256)).alias("text_sha256")
    columns = ["rid", "doc_id", "pos", "blocks", sha]
    if shared.isEmpty():
        return join_counted(routed.select(*columns, "route"), names, ["route"], "uses", -1 - F.col("rid")).drop("route", "uses")
    clash = routed.join(shared, "route", "left_semi").groupBy("block").agg(F.count("*").alias("uses"))
    settled = scratch.keep(_numbered(clash, ["block"]).withColumn("name", -1 - F.col("name")), "settled")
    alone = join_counted(routed.join(shared, "route", "left_anti"), names, ["route"], "uses", -1 - F.col("rid"))
    rest = routed.join(shared, "route", "left_semi").join(settled, "block")
    return alone.select(*columns, "name").unionByName(rest.select(*columns, "name"))


def identities(scratch: Scratch, docs: DataFrame, block_bytes: int = BLOCK_BYTES, route: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, text_sha256, level, name.

    (level, name) is equal for two rows exactly if their texts are equal; a
    null text counts as empty. ``route`` only decides where contents meet.
    """
    at = scratch.keep(_first_names(scratch, docs, block_bytes, route), "level0")
    done = at.filter("blocks = 1").select("rid", "doc_id", "text_sha256", F.lit(0).alias("level"), "name")
    level = 0
    at = at.filter("blocks > 1")
    while not at.isEmpty():
        level += 1
        pairs = scratch.keep(
            at.groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(
                F.first("doc_id").alias("doc_id"),
                F.max("text_sha256").alias("text_sha256"),
                F.shiftright(F.first("blocks") + 1, 1).alias("blocks"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-(2**63)).cast("long")).alias("b"),
            ),
            f"pairs{level}",
        )
        distinct = pairs.groupBy("a", "b").agg(F.count("*").alias("uses"))
        names = scratch.keep(_numbered(distinct, ["a", "b"]), f"names{level}")
        named = join_counted(pairs, names, ["a", "b"], "uses", -(2**62) - F.col("rid")).drop("a", "b", "uses")
        at = scratch.keep(named, f"level{level}")
        scratch.drop(f"pairs{level}")
        done = done.unionByName(at.filter("blocks = 1").select("rid", "doc_id", "text_sha256", F.lit(level).alias("level"), "name"))
        at = at.filter("blocks > 1")
    return done


def exact_dedup(spark: SparkSession, docs: DataFrame, block_bytes: int = BLOCK_BYTES, route: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by equal text, a null text counting as empty. The row
    with the largest doc_id stays (a null doc_id is smaller than any other; of
    rows that repeat a doc_id, exactly one stays). Every input row is
    returned, repeated ones as often as they occur; other columns are ignored.
    An empty input gives an empty result.
    """
    scratch = Scratch(spark, "exact-dedup")
    rows = identities(scratch, docs.select("doc_id", "text"), block_bytes, route)
    groups = scratch.keep(
        rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")),
        "groups",
    )
    joined = join_counted(rows, groups, ["level", "name"], "group_size", -(2**62) - F.col("rid"))
    return joined.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        "text_sha256",
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_dedup`` of ``documents``: every row, of equal texts the one with the largest doc_id stays; null counts as empty."""
    return exact_dedup(spark, table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
