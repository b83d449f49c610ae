"""Connected groups of similar things, found without listing all pairs of a group.

Things that share a key may be linked. Every thing is first compared with the
leader of each of its keys; the links found give components. Only keys whose
things are still in different components are looked at again: first, what
stands outside a key's largest component is compared with a few of its
members, drawn anew each round; in the end all pairs from different components
are compared. So no link between different components is lost, and a group of
n copies costs some n comparisons.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch, bounded_bytes, dealt_like, fits, join_counted

#: Members of a key's largest component that the rest of the key is compared with in one round.
PIVOTS = 4
#: Rounds with pivots at most, and the share of linked pairs below which no other follows; all pairs left are compared after them.
PIVOT_ROUNDS = 6
#: Pairs by key that are compared at once rather than after another round.
FEW_PAIRS = 1_000_000
LEAST_HITS = 0.1
#: Megabytes within which a table of ids or keys is broadcast (see ``bounded_bytes``).
SMALL = 64
#: The same for tables of keys, of which there are about as many as rows: few sizes are between those that are broadcast and those that are shuffled at any rate.
SMALL_KEYS = 4
#: The share of the pairs by key that a round with pivots has to leave at most, or no other follows.
MOST_LEFT = 0.75


def _led(scratch: Scratch, rows: DataFrame, step: DataFrame, label: str) -> DataFrame:
    """``rows`` (id, to) whose ``to`` goes where the kept table ``step`` (id, to) says; it stays if that says nothing."""
    step = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
    if fits(step, SMALL):
        met = rows.join(F.broadcast(step), "to", "left")
    else:
        rows = scratch.keep(rows, f"{label}-rows")
        sizes = rows.groupBy("to").agg(F.count("*").alias("ids"))
        met = join_counted(rows, scratch.keep(sizes.join(step, "to", "left"), f"{label}-sizes"), ["to"], "ids", -1 - F.col("id"))
    return met.select("id", F.coalesce("next", "to").alias("to"))


def components(scratch: Scratch, links: DataFrame, label: str) -> DataFrame:
    """The smallest id that each id of ``links`` (a, b) reaches: id, root.

    In each round an id moves to the neighbour that comes first in the order
    of the round, unless it comes first itself, and on to where that moved;
    the edges, each written once, move along: what was connected stays so. The
    first order is that of the ids, which settles stars around their smallest
    id at once; the others are drawn anew, so that a fixed share of the ids is
    left behind in each round, whatever the shape. The last id of an order
    always is, so the rounds end without a limit. Ids without a link are absent.
    """
    once = lambda rows, a, b: rows.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    edges = scratch.keep(once(links, "a", "b"), f"{label}-edges-0")
    steps: list[DataFrame] = []
    while not steps or not edges.isEmpty():
        turn = len(steps)
        place = lambda c: F.struct((F.xxhash64(c, F.lit(turn)) if turn else F.col(c)).alias("draw"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(place("b")).alias("near"))
        near = near.select(F.col("a").alias("id"), F.least(place("a"), F.col("near"))["to"].alias("to"))
        step = scratch.keep(dealt_like(near, edges), f"{label}-near-{turn}")
        step = scratch.keep(dealt_like(_led(scratch, step, step, f"{label}-jump-{turn}"), edges), f"{label}-step-{turn}")
        steps.append(step)
        ends = bounded_bytes(step, SMALL)
        moved = edges.join(ends.withColumnsRenamed({"id": "a", "to": "to_a"}), "a").join(ends.withColumnsRenamed({"id": "b", "to": "to_b"}), "b")
        edges = scratch.keep(dealt_like(once(moved, "to_a", "to_b"), edges), f"{label}-edges-{turn + 1}")
        scratch.drop(f"{label}-edges-{turn}")
    if len(steps) == 1:
        return steps[0].withColumnRenamed("to", "root")  # every id moved to a smaller one, and all to the same
    labels = steps[0]
    for turn in range(1, len(steps)):
        labels = _led(scratch, labels, steps[turn], f"{label}-on-{turn}")
    labels = scratch.keep(dealt_like(labels.withColumnRenamed("to", "root"), steps[0]), f"{label}-labels")
    smallest = labels.groupBy("root").agg(F.min("id").alias("smallest"), F.count("*").alias("ids"))
    named = join_counted(labels, scratch.keep(dealt_like(smallest, labels), f"{label}-smallest"), ["root"], "ids", -1 - F.col("id"), SMALL)
    return scratch.keep(dealt_like(named.select("id", F.col("smallest").alias("root")), labels), f"{label}-named")


def groups(
    scratch: Scratch,
    postings: DataFrame,
    possible: Callable[[str, str], Column],
    narrowed: Callable[[DataFrame], DataFrame],
    linked: Callable[[DataFrame], DataFrame],
    before: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """id and root of every id that has a link.

    ``postings``: key, id and attributes of the id, whose names end in neither
    _l nor _r; keys with one id are left out by the caller. ``possible(l, r)``
    says from the attributes (with those suffixes) whether two ids may be
    linked; ``narrowed`` takes all joined postings of pairs and returns the
    pairs (a, b) that their shared keys still allow; ``linked`` compares
    pairs (a, b) and returns those that are linked.
    """
    values = [c for c in postings.columns if c != "key"]
    others = [c for c in values if c != "id"]
    apart = -1 - F.col("id")

    def sided(frame: DataFrame, side: str, *more) -> DataFrame:
        return frame.select("key", *more, *[F.col(c).alias(f"{c}_{side}") for c in [*values, "root"]])

    def compared(pairs: DataFrame, before: DataFrame | None, label: str) -> tuple[DataFrame, DataFrame]:
        """The new pairs, and those of them that are linked."""
        new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = scratch.keep(new if before is None else new.join(before, ["a", "b"], "left_anti"), f"pairs-{label}")
        return new, scratch.keep(linked(new).select("a", "b"), f"links-{label}")

    def mixed_keys(links: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        """The roots of linked ids, and the postings of keys with several roots, with the most common one as ``main``."""
        roots = components(scratch, links, f"roots-{label}")
        placed = scratch.keep(postings.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), f"placed-{label}")
        sizes = placed.groupBy("key", "root").agg(F.count("*").alias("ids"))
        mixed = sizes.groupBy("key").agg(F.max_by("root", F.struct("ids", "root")).alias("main"), F.max("ids").alias("most"), F.sum("ids").alias("ids"), F.count("*").alias("roots"))
        mixed = scratch.keep(mixed.filter("roots > 1").select("key", "main", "ids", (F.col("ids") - F.col("most")).alias("left")), f"mixed-{label}")
        return roots, scratch.keep(join_counted(placed, mixed, ["key"], "ids", apart, SMALL_KEYS).filter("main IS NOT NULL"), f"marked-{label}")

    leaders = scratch.keep(postings.groupBy("key").agg(F.min(F.struct("id", *others)).alias("leader"), F.count("*").alias("ids")), "leaders")
    led = join_counted(postings, leaders, ["key"], "ids", apart, SMALL_KEYS).filter("id <> leader.id")
    led = led.select(*[F.col(f"leader.{c}").alias(f"{c}_l") for c in values], *[F.col(c).alias(f"{c}_r") for c in values]).filter(possible("l", "r"))
    seen, links = compared(led.select(F.col("id_l").alias("a"), F.col("id_r").alias("b")), None, "led")
    roots, marked = mixed_keys(links, "0")
    last = None
    for turn in range(1, PIVOT_ROUNDS + 1):
        rest = marked.filter("root <> main")
        full = rest.agg(F.sum("ids")).first()[0] or 0
        if full <= max(FEW_PAIRS, PIVOTS * marked.count()):
            break  # all pairs cost no more than another round
        if last and full > MOST_LEFT * last:
            break  # pivots are not linked with what is left
        last = full
        draws = [F.min(F.struct(F.xxhash64("id", F.lit(turn * PIVOTS + j)).alias("draw"), F.struct(*values, "root").alias("pivot"))).alias(f"p{j}") for j in range(PIVOTS)]
        pivots = marked.filter("root = main").groupBy("key").agg(*draws).select("key", F.array_distinct(F.array(*[F.col(f"p{j}.pivot") for j in range(PIVOTS)])).alias("pivots"))
        pivots = scratch.keep(pivots.join(rest.groupBy("key").agg(F.count("*").alias("ids")), "key"), f"pivots-{turn}")
        met = join_counted(rest.drop("ids", "main", "left"), pivots, ["key"], "ids", apart, SMALL_KEYS)
        met = sided(met, "l", F.explode("pivots").alias("p")).select("*", *[F.col(f"p.{c}").alias(f"{c}_r") for c in values]).filter(possible("l", "r"))
        new, found = compared(met.select(F.col("id_l").alias("a"), F.col("id_r").alias("b")), seen, f"pivot{turn}")
        seen, links = seen.unionByName(new), links.unionByName(found)
        if found.count() < LEAST_HITS * new.count():
            roots = None  # what these links connect is left to the last components
            break
        roots, marked = mixed_keys(links, str(turn))
    again = F.lit(False)
    if before:
        marked, again = before(marked), F.arrays_overlap("before_l", "before_r")
        values = [*values, "before"]
    rest, every = sided(marked.filter("root <> main"), "l"), sided(marked, "r", "main")
    pairs = rest.join(every, "key").filter("root_l <> root_r AND (root_r = main OR root_l < root_r)").filter(possible("l", "r") & ~again)
    _, found = compared(narrowed(pairs), seen, "cross")
    return roots if roots is not None and found.isEmpty() else components(scratch, links.unionByName(found), "roots-all")
