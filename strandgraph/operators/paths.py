"""Paths against many globs at once, and the deepest of many roots above a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialects import Trie
from .storage import cut

#: Edges of a trie, in number, that are broadcast; a larger one is shuffled.
BROADCAST_EDGES = 200_000
#: Segments of paths that one plan goes through.
LEVELS = 12


def matched(paths: DataFrame, patterns: list[str], dialect: str) -> DataFrame:
    """path and pattern of each distinct path of ``paths`` and glob of a dialect that match; null paths match none.

    The globs are one trie of segments. Paths are dealt out once; then a
    segment after the other leads from the nodes that a path has reached to the
    next by a join on node and segment, so a path meets the globs that share
    its beginning, or start with a wildcard, and no others.
    """
    spark, trie = paths.sparkSession, Trie(patterns, dialect)
    small = len(trie.edges) + len(trie.ends) <= BROADCAST_EDGES
    held = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema)) if small else spark.createDataFrame(rows, schema)
    edges = held(trie.edges, "node int, key string, regex string, to int")
    ends = held(trie.ends, "node int, pattern string")
    rows = paths.select("path").filter("path IS NOT NULL").distinct().withColumn("segments", F.split("path", "/", -1))
    depth = (rows.agg(F.max(F.size("segments"))).first()[0] or 0) if trie.edges else 0
    rows = rows.withColumn("node", F.explode(F.array(*[F.lit(n) for n in trie.start])))
    for level in range(depth):
        segment = F.get("segments", F.lit(level))
        over = F.size("segments") <= level
        keys = F.when(over, F.array(F.lit(""))).otherwise(F.array(F.concat(F.lit("="), segment), F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[^.]*)$", 1)), F.lit("?")))
        # a path that is through stays where it is
        tried = rows.withColumn("_segment", segment).withColumn("key", F.explode(keys))
        met = tried.join(edges, ["node", "key"], "left").filter((F.col("key") == "") | F.col("to").isNotNull() & (F.col("regex").isNull() | F.expr("_segment RLIKE regex")))
        rows = met.select("path", "segments", F.coalesce("to", "node").alias("node")).groupBy("path", "node").agg(F.first("segments").alias("segments"))
        if level % LEVELS == LEVELS - 1:
            rows = cut(rows)
    return rows.join(ends, "node").select("path", "pattern").distinct()


def matching(paths: DataFrame, patterns: list[str], dialect: str) -> DataFrame:
    """The rows of ``paths`` whose path a glob matches."""
    return paths.join(matched(paths, patterns, dialect).select("path").distinct(), "path", "left_semi") if patterns else paths.limit(0)


def kept(paths: DataFrame, patterns: list[str], dialect: str) -> DataFrame:
    """The rows of ``paths`` whose path no glob matches."""
    return paths.join(matched(paths, patterns, dialect).select("path").distinct(), "path", "left_anti") if patterns else paths


def ancestors(path: Column, separator: str = "/") -> Column:
    """All beginnings of a path up to a separator, the path itself the last."""
    parts = F.split(path, separator, -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def deepest(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path and the deepest root (``roots``: root) that is the path or lies above it; paths without one are left out.

    Each distinct path meets the roots by equality with its own beginnings, so
    the work grows with the length of paths, not with the number of roots.
    """
    own = paths.select("path").filter("path IS NOT NULL").distinct()
    each = own.select("path", F.posexplode(ancestors(F.col("path"))).alias("level", "root"))
    met = each.join(roots.select("root").filter("root IS NOT NULL").distinct(), "root")
    return met.groupBy("path").agg(F.max_by("root", "level").alias("root"))


def docs_directories(sources: DataFrame, docs_roots: list[str]) -> DataFrame:
    """path and ``directory``: where the documents of each source file belong.

    A documents root serves the files below the directory that holds it, but
    not those right in it. Of several, the deepest serves; the file's own
    directory is repeated below it.
    """
    spark = sources.sparkSession
    holders = spark.createDataFrame([(r.rpartition("/")[0], r) for r in sorted(set(docs_roots))], "root string, docs string")
    # a file right in a holder has no package there, so its own directory is no holder for it
    above = sources.select("path").filter("path LIKE '%/%'").distinct().select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("place"))
    each = above.select("path", "place", F.explode(F.concat(F.array(F.lit("")), F.filter(ancestors(F.col("place")), lambda x: x != F.col("place")))).alias("root"))
    met = each.join(F.broadcast(holders) if len(docs_roots) <= BROADCAST_EDGES else holders, "root")
    best = met.groupBy("path", "place").agg(F.max_by(F.struct("root", "docs"), F.length("root")).alias("b"))
    rest = F.when(F.col("b.root") == "", F.col("place")).otherwise(F.expr("substring(place, length(b.root) + 2)"))
    return best.select("path", F.concat_ws("/", "b.docs", rest).alias("directory"))
