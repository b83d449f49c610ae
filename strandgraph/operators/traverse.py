"""Bounded traversals: trace of one or several roots, and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import TRACE_DEPTH_MAX
from .storage import cut


def check_query(root: str, depth: int) -> None:
    """Refuses an empty or malformed id, and a depth outside the limits."""
    import re

    if not root or root != root.strip():
        raise ValueError("an id without white space around it is needed")
    if not re.fullmatch(r"(?:SPEC|CONTRACT|TEST|DESIGN)-[A-Z0-9_]+-[0-9]+|(?:component|contract):[^#\s]+#\S.*|[a-z_]+:\S+", root):
        raise ValueError(f"not an id: {root}")
    if not 0 <= depth <= TRACE_DEPTH_MAX:
        raise ValueError(f"a depth from 0 to {TRACE_DEPTH_MAX} is needed")


def _both_ways(relations: DataFrame) -> DataFrame:
    out = relations.select("*", F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.lit(0).alias("way"))
    return out.unionByName(relations.select("*", F.col("dst").alias("from_id"), F.col("src").alias("to_id"), F.lit(1).alias("way")))


#: Ends of more than 1/HOT_SHARE of all relations are looked at by themselves; there can be no more than 2 * HOT_SHARE of them.
HOT_SHARE = 1000
#: Buckets that ends are counted in at first; a bucket without a frequent end holds far less than 1/HOT_SHARE.
END_BUCKETS = 65536


def idle_ends(relations: DataFrame, inside: DataFrame) -> DataFrame:
    """Frequent ends of ``relations`` that are not among ``inside`` (id), so that no traversal goes on from them: id.

    A place in code is the end of many relations; in a join by id they would
    all gather in one task, and meet nothing there. Ends are counted by
    buckets of their hashes, and one by one only in buckets that are large
    enough to hold a frequent one, so that few ids are shuffled.
    """
    ends = relations.select(F.explode(F.array("src", "dst")).alias("id")).withColumn("_bucket", F.pmod(F.xxhash64("id"), F.lit(END_BUCKETS)).cast("int"))
    sizes = cut(ends.groupBy("_bucket").agg(F.count("*").alias("n")))
    bound = (sizes.agg(F.sum("n")).first()[0] or 0) // 2 // HOT_SHARE
    large = sizes.filter(F.col("n") > bound).select("_bucket")
    hot = cut(ends.join(F.broadcast(large), "_bucket", "left_semi").groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > bound).select("id"))
    held = cut(inside.select("id").join(F.broadcast(hot), "id", "left_semi").distinct())
    return hot.join(F.broadcast(held), "id", "left_anti")


def without_ends(steps: DataFrame, end: str, idle: DataFrame) -> DataFrame:
    return steps.join(F.broadcast(idle.select(F.col("id").alias(end))), end, "left_anti")


def trace(roots: DataFrame, relations: DataFrame, entities: DataFrame, depth: int, mentions: bool = False, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """What lies within ``depth`` relations of each root (root_id), in either direction.

    Returns (root_id, id, depth) of the entities reached, and the relations
    with root_id, the depth at which each is first seen, and its direction:
    outbound or inbound, as the first frontier id that sees it decides,
    outbound before inbound. Endpoints that are no entity are not entered.
    A round joins the frontier only; at most five rounds are possible. The
    first is dealt by root_id, and so is what it finds. With ``carried``,
    entities are unique, ids reached keep those columns of theirs, and the
    last frontier, from which nothing goes on, is not written.
    """
    if not 0 <= depth <= TRACE_DEPTH_MAX:
        raise ValueError(f"a depth from 0 to {TRACE_DEPTH_MAX} is needed")
    used = relations if mentions else relations.filter("type <> 'mentions'")
    idle = idle_ends(used, entities.select("id").union(roots.select("root_id")))
    ways = without_ends(_both_ways(used), "from_id", idle)
    known, how = entities.select(F.col("id").alias("to_id"), *carried), "inner" if carried else "left_semi"
    own = roots.select("root_id").distinct()
    reached = own.select("root_id", F.col("root_id").alias("id"), F.lit(0).alias("depth"))
    frontier, seen = reached, None
    for level in range(1, depth + 1):
        if level == 1:
            # roots are distinct; a semi join would be made once in each part of the union, and what it finds dealt anew
            steps = ways.withColumn("root_id", F.col("from_id")).join(own, "root_id")
        else:
            steps = frontier.select("root_id", F.col("id").alias("from_id")).join(ways, "from_id")
        steps = steps.withColumn("depth", F.lit(level))
        seen = steps if seen is None else seen.unionByName(steps)
        new = without_ends(steps.select("root_id", "to_id").filter("to_id <> root_id"), "to_id", idle).distinct().join(known, "to_id", how).withColumnRenamed("to_id", "id")
        new = new if level == 1 else new.join(reached, ["root_id", "id"], "left_anti")
        frontier = new.withColumn("depth", F.lit(level))
        frontier = frontier if carried and level == depth else cut(frontier)
        reached = reached.unionByName(frontier.select("root_id", "id", "depth", *carried), allowMissingColumns=True)
    if seen is None:
        seen = roots.select("root_id").join(ways, F.lit(False)).withColumn("depth", F.lit(0))
    keys = [c for c in ("src", "dst", "type", "path", "line", "field", "record_id") if c in relations.columns]
    first = W.partitionBy("root_id", *keys).orderBy("depth", "from_id", "way")
    found = seen.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return reached, found.select("root_id", *relations.columns, "depth", F.when(F.col("way") == 0, F.lit("outbound")).otherwise(F.lit("inbound")).alias("direction"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges without those that start where none ends, or end where none starts."""
    starts, ends = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
    return edges.join(starts, "dst", "left_semi").join(ends, "src", "left_semi").select("src", "dst")


def _followed(edges: DataFrame) -> DataFrame | None:
    """Nodes that one edge enters and one leaves, each with the end of its path: id, ptr, low, last.

    ``ptr`` is the node behind the path, and ``last`` the last node of it. On
    a ring of such nodes ``ptr`` stays on the ring, and ``low`` is its smallest
    id. Pointers double their reach in every round, so a path of n nodes
    takes log2(n) rounds.
    """
    leave = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("ptr")).filter("n = 1").select(F.col("src").alias("id"), "ptr")
    enter = edges.groupBy("dst").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("dst").alias("id"))
    path = cut(leave.join(enter, "id", "left_semi").select("id", "ptr", F.col("id").alias("low"), F.col("id").alias("last")))
    size, reach = path.count(), 1
    if not size:
        return None
    while reach <= size:
        ahead = path.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("low").alias("_low"), F.col("last").alias("_last"))
        moved = path.join(ahead, "ptr", "left").select("id", F.coalesce("_ptr", "ptr").alias("ptr"), F.least("low", "_low").alias("low"), F.coalesce("_last", "last").alias("last"), F.col("_ptr").isNotNull().alias("moved"))
        path, reach = cut(moved), reach * 2
        if path.filter("moved").isEmpty():
            break
    return path.drop("moved")


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """The edges with an edge in place of each path, the edges that stand for paths (src, dst, via), their nodes (via, id), and rings (id, label)."""
    path = _followed(edges)
    if path is None:
        return None
    onward = path.join(path.select(F.col("id").alias("ptr")), "ptr", "left_semi")
    rings = onward.select("id", F.col("low").alias("label"))
    open_ = path.join(path.select(F.col("id").alias("ptr")), "ptr", "left_anti")
    bare = edges.join(path.select(F.col("id").alias("src")), "src", "left_anti")
    entered = bare.join(path.select(F.col("id").alias("dst"), "ptr", "last"), "dst", "left")
    entered = cut(entered.select("src", F.coalesce("ptr", "dst").alias("dst"), F.col("last").alias("via")))
    return cut(entered.filter("src <> dst").select("src", "dst").distinct()), entered.filter("via IS NOT NULL"), open_.select(F.col("last").alias("via"), "id"), cut(rings)


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (id, label), each the smallest of all labels that lead to the id."""
    while True:
        come = edges.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("come"))
        after = cut(labels.join(come, "id", "left").select("id", F.least("label", "come").alias("label"), (F.col("come") < F.col("label")).alias("moved")))
        moved = not after.filter("moved").isEmpty()
        labels = after.select("id", "label")
        if not moved:
            return labels


def _led_both_ways(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that reach, and are reached by, the smallest id that reaches them (id, label), and the edges between the others."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    labels = _spread(edges, nodes.withColumn("label", F.col("id")))
    inside = edges.join(labels.withColumnsRenamed({"id": "src", "label": "a"}), "src").join(labels.withColumnsRenamed({"id": "dst", "label": "b"}), "dst").filter("a = b")
    back = cut(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # against the edges, the label itself spreads to the nodes that reach it
    roots = labels.select("id", F.when(F.col("id") == F.col("label"), F.col("label")).alias("label"))
    ring = _spread_known(back, roots).filter("label IS NOT NULL")
    rest = edges.join(ring.select(F.col("id").alias("src")), "src", "left_anti").join(ring.select(F.col("id").alias("dst")), "dst", "left_anti")
    several = ring.groupBy("label").count().filter("count > 1").select("label")
    return cut(ring.join(several, "label", "left_semi").select("id", "label")), cut(rest.select("src", "dst"))


def cycles(links: DataFrame) -> DataFrame:
    """The nodes of ``links`` (src, dst) that reach themselves, in any number of steps: id, cycle, members.

    ``cycle`` is the smallest id of the nodes that reach each other, and
    ``members`` their number. Paths of nodes that one edge enters and one
    leaves become single edges, and what lies on no way between cycles goes,
    again and again, so rings, paths and trees take a number of rounds that
    grows as the logarithm of their size. In what is left, a node takes the
    smallest id that reaches it; the nodes that reach this id in turn make a
    cycle with it. At last the nodes of a path belong to a cycle if both its
    ends do. There is no limit to the length of a cycle, and no list of all
    pairs that reach each other.
    """
    pairs = cut(links.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    edges, levels = pairs.filter("src <> dst"), []
    labels = pairs.filter("src <> dst").select(F.col("src").alias("id"), F.col("src").alias("label")).limit(0)
    left = edges.count()
    while left:
        short = _contracted(edges)
        if short:
            edges, ways, nodes, rings = short
            levels.append((ways, nodes))
            labels = labels.unionByName(rings)
        edges = cut(_trimmed(edges))
        before, left = left, edges.count()
        if left == before:
            found, edges = _led_both_ways(edges)
            labels, left = labels.unionByName(found), edges.count()
    for ways, nodes in reversed(levels):
        labels = cut(labels)
        turns = ways.filter("src = dst").select(F.col("src").alias("id")).distinct().join(labels, "id", "left_anti")
        labels = labels.unionByName(turns.select("id", F.col("id").alias("label")))
        held = ways.join(labels.withColumnsRenamed({"id": "src", "label": "a"}), "src").join(labels.withColumnsRenamed({"id": "dst", "label": "b"}), "dst").filter("a = b")
        labels = labels.unionByName(nodes.join(held.select("via", F.col("a").alias("label")), "via").select("id", "label"))
    own = pairs.filter("src = dst").select(F.col("src").alias("id")).join(labels, "id", "left_anti")
    labels = cut(labels.unionByName(own.select("id", F.col("id").alias("label"))))
    named = labels.groupBy("label").agg(F.min("id").alias("cycle"), F.count("*").alias("members"))
    return labels.join(named, "label").select("id", "cycle", "members")


def _spread_known(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (id, label) where ids without a label take one along the edges, until none does."""
    while True:
        come = edges.join(labels.filter("label IS NOT NULL").withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("come"))
        after = cut(labels.join(come, "id", "left").select("id", F.coalesce("label", "come").alias("label"), (F.col("label").isNull() & F.col("come").isNotNull()).alias("moved")))
        moved = not after.filter("moved").isEmpty()
        labels = after.select("id", "label")
        if not moved:
            return labels


def hops(links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """root_id, id and the least number of links (src, dst), taken in either direction."""
    ways = links.select("src", "dst").union(links.select("dst", "src")).distinct()
    reached = roots.select("root_id", F.col("root_id").alias("id"), F.lit(0).alias("depth"))
    frontier = reached
    for level in range(1, depth + 1):
        new = frontier.select("root_id", F.col("id").alias("src")).join(ways, "src").select("root_id", F.col("dst").alias("id")).distinct()
        frontier = cut(new.join(reached.select("root_id", "id"), ["root_id", "id"], "left_anti").withColumn("depth", F.lit(level)))
        reached = reached.unionByName(frontier)
    return reached
