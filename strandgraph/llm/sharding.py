"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number for every key; the key goes to the shard with the
best draw. A shard that is added wins some keys and changes no other draw, so
records move only into it; one that is removed gives up its own keys alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._io import table
from ._scratch import Scratch

SHARDS = 24
#: Rows that one task numbers; the number of slot ranges follows the input.
RANGE_ROWS = 50_000


def draw(key: Column, shard: int) -> Column:
    """The draw of one shard for a key: 60 bits as hexadecimal digits."""
    return F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 15)


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard of a key. A shard of twice the weight wins twice the keys.

    With equal weights the largest draw wins; else the draw u in (0, 1) counts
    as weight / -ln(u). Of equal draws the larger shard number wins.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("at least one shard, and positive weights")
    if len(set(weights.values())) == 1:
        scores = [F.struct(draw(key, s).alias("score"), F.lit(s).alias("shard")) for s in sorted(weights)]
    else:
        unit = {s: (F.conv(F.substring(draw(key, s), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48 for s in weights}
        scores = [F.struct((-weights[s] / F.log(unit[s])).alias("score"), F.lit(s).alias("shard")) for s in sorted(weights)]
    return (scores[0] if len(scores) == 1 else F.greatest(*scores))["shard"]


def shard(spark: SparkSession, docs: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The shard depends on doc_id and the weights alone. ``size`` is the UTF-8
    length of the text plus 8; ``slot`` numbers the rows of a shard from 0
    without gaps, in the order of a hash of doc_id and text. A null text has
    no bytes; rows without a doc_id share the key ``null`` and so a shard.
    Repeated rows get a slot each; other columns are ignored. ``grown_shard``
    is the shard under ``grown`` and null without it. An empty input gives an
    empty result.
    """
    scratch = Scratch(spark, "sharding")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", rendezvous(key, weights).cast("int"))
    rows = rows.withColumn("grown_shard", rendezvous(key, grown).cast("int") if grown else F.lit(None).cast("int"))
    rows = scratch.keep(rows.withColumn("turn", F.md5(F.concat_ws(":", key, F.col("text_crc32")))), "rows")
    ranges = max(1, rows.count() // (len(weights) * RANGE_ROWS))
    digits = math.ceil(math.log(ranges, 16)) if ranges > 1 else 0
    rows = rows.withColumn("range", F.substring("turn", 1, digits) if digits else F.lit(""))
    before = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = scratch.keep(
        rows.groupBy("shard", "range").agg(F.count("*").alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")),
        "starts",
    )
    inside = W.partitionBy("shard", "range").orderBy("turn", "doc_id", "size")
    numbered = rows.withColumn("ordinal", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "range"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("ordinal")).cast("long").alias("slot"),
        "grown_shard",
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shard`` of ``documents`` over 24 even shards by key, and with one more; null texts have no bytes, null doc_ids one shard."""
    even = dict.fromkeys(range(SHARDS), 1.0)
    return shard(spark, table(spark, sf_dir, "documents"), even, even | {SHARDS: 1.0})


#: DuckDB has no crc32: ``bits`` is its table, by the polynomial of the standard, and ``list_reduce`` goes over the bytes.
ORACLE = f"""
WITH bits AS (
  SELECT list(list_reduce([i] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)
), d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, strlen(coalesce(text, '')) + 8 AS size,
         xor(list_reduce([4294967295::BIGINT] || list_transform(range(strlen(coalesce(text, ''))),
           lambda i: ((instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)::BIGINT),
           lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
  FROM (SELECT *, hex(coalesce(text, '')) AS h FROM documents), bits
), draws AS (
  SELECT DISTINCT key, s::INTEGER AS s, substr(md5(key || ':' || s), 1, 15) AS draw FROM d, range({SHARDS + 1}) r(s)
), won AS (
  SELECT key, max_by(s, draw || lpad(s::VARCHAR, 4, '0')) FILTER (s < {SHARDS}) AS shard, max_by(s, draw || lpad(s::VARCHAR, 4, '0')) AS grown_shard
  FROM draws GROUP BY key
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(key || ':' || text_crc32), doc_id, size) - 1 AS slot, grown_shard
FROM d JOIN won USING (key)
"""
