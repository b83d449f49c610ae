"""Components of an n-gram Jaccard join over the document by n-gram incidence.

Rows are documents with distinct sets, columns are hashed shingles, ordered so
that frequent ones come last. A row enters the product with its first columns
only, as many as the size-derived bound needs: two sets that are similar
enough share one of them, and all that they share stands behind the first in
both. Pairs of rows that meet under a column are discarded if their sizes, the
places of the column, or the number of columns that the one whose prefix ends
first shares with any other row cannot give the overlap that is needed. Of the rest the overlap is
added up block by block of columns, and a pair goes as soon as overlap plus the
smaller rest is too little. Rows are paired with leaders and drawn pivots of a
column first, and then only with rows of other components. Links inside a
component are not listed: the result has the components only, no pairs,
overlaps or numbers of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._grams import text_bytes
from ._groups import groups
from ._io import table
from ._scratch import Scratch, bounded_bytes, frequent, join_counted
from .bpe import arrow_rows

WIDTH = 5
PERCENT = 75
#: Counters of the frequency sketch that orders the columns; its size is fixed.
SKETCH = 1 << 20
BATCH_ROWS = 1000
#: Blocks of columns in which overlaps are added up.
BLOCKS = 8
#: Columns before a posting that are looked at for an earlier meeting of two rows.
BEFORE = 8
#: Bytes of text that are cut into shingles at once.
PIECE_BYTES = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: A-Z as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: The first bytes of a block of eight.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space of texts one after the other, A-Z as a-z, and the bounds of each text's words.

    Blocks of eight bytes of a word are mixed in one after the other, so no
    regular pattern of bytes, such as defeats polynomials modulo 2^64, cancels out.
    """
    n = len(data)
    inside = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)  # a text begins
    edge[offsets[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    ends = np.empty(n, bool)
    if n:
        ends[:-1] = inside[:-1] & (~inside[1:] | edge[1:n])
        ends[-1] = inside[-1]
    first, last = np.flatnonzero(start), np.flatnonzero(ends) + 1
    padded = np.r_[_LOWER[data], np.zeros(8, np.uint8)]
    blocks = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1))
    left = last - first
    found = _mixed(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at, own = first, np.arange(len(first))
    while len(at):
        block = blocks[at].view("<u8").ravel() & _MASKS[np.minimum(left, 8)]
        found[own] = _mixed((found[own] ^ _mixed(block + np.uint64(0xD1342543DE82EF95))) * np.uint64(0xF1357AEA2E62A9C5))
        more = left > 8
        at, own, left = at[more] + 8, own[more], left[more] - 8
    return found, np.searchsorted(first, offsets)


def _piece_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word, bounds = word_hashes(data, offsets)
    n = np.diff(bounds)
    full = np.zeros(max(0, len(word) - WIDTH + 1), np.uint64)
    for i in range(WIDTH):
        full = _mixed(full + word[i : i + len(full)] + np.uint64(i + 1))
    many = np.maximum(n - WIDTH + 1, 0)
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    sizes = many.copy()
    sizes[short] = 1
    edges = np.r_[0, np.cumsum(sizes)]
    hashes = np.zeros(edges[-1], np.uint64)
    owner = np.repeat(np.arange(len(n)), many)
    hashes[np.arange(len(owner)) + np.repeat(edges[:-1] - np.r_[0, np.cumsum(many)][:-1], many)] = full[np.arange(len(owner)) + np.repeat(bounds[:-1] - np.r_[0, np.cumsum(many)][:-1], many)]
    for d in short:
        x = np.zeros(1, np.uint64)
        for i, w in enumerate(word[bounds[d] : bounds[d + 1]]):
            x = _mixed(x + w + np.uint64(i + 1 + 97 * n[d]))
        hashes[edges[d]] = x[0]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[edges[:-1][sizes > 0]] = True
    return hashes[keep], np.r_[0, np.cumsum(keep)][edges]


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit shingle hashes of every text, in order, and their bounds; texts are read in pieces of some PIECE_BYTES."""
    data, offsets = text_bytes(texts)
    found, bounds, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1)
        hashes, edges = _piece_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        bounds.append(bounds[-1][-1] + edges[1:])
        found.append(hashes)
        first = last
    return np.concatenate(found), np.concatenate(bounds)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, _ = shingle_sets(batch.column("text"))
        found, counts = np.unique(hashes, return_counts=True)
        many = counts >= 2
        cell, counts = (found[many] % np.uint64(SKETCH)).astype(np.int64), counts[many]
        order = np.lexsort((-counts, cell))
        first = np.r_[True, cell[order][1:] != cell[order][:-1]] if len(order) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(cell[order][first]), pa.array(counts[order][first].astype(np.int64))], names=["cell", "count"])


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """For every cell of the sketch the logarithm of the count of its most frequent shingle.

    All documents are counted; a shingle that a batch holds once adds
    nothing, since only the order of columns depends on the levels.
    """
    rows = docs.select("text").mapInArrow(_frequent, "cell long, count long").groupBy("cell").agg(F.sum("count").alias("count")).toArrow()
    levels = np.zeros(SKETCH, np.uint8)
    levels[rows["cell"].to_numpy()] = np.log2(rows["count"].to_numpy() + 1.0).astype(np.uint8) if len(rows) else 0
    return levels


def _columns(levels: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = shingle_sets(batch.column("text"))
            sizes = np.diff(bounds)
            sums = np.r_[np.uint64(0), np.cumsum(hashes)]
            others = np.r_[np.uint64(0), np.cumsum(_mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)))]
            # a column's key puts frequent ones last; 56 bits of its hash are enough to look for candidates
            keys = levels[(hashes % np.uint64(SKETCH)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8)
            prefix = np.where(sizes > 0, sizes - -(-PERCENT * sizes // 100) + 1, 0)
            inside = np.zeros(len(keys), bool)
            for a, b, n in zip(bounds[:-1].tolist(), bounds[1:].tolist(), prefix.tolist(), strict=True):
                keys[a:b].sort()
                inside[a : a + n] = True
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(prefix)].astype(np.int32)), pa.array(keys[inside].view(np.int64)))
            f1 = (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)
            f2 = (others[bounds[1:]] - others[bounds[:-1]]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("version"), pa.array(sizes.astype(np.int64)), pa.array(f1), pa.array(f2), lists],
                names=["rid", "doc_id", "version", "n", "f1", "f2", "keys"],
            )

    return rows


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, bounds = shingle_sets(batch.column("text"))
        cell = np.repeat(np.arange(len(batch)), np.diff(bounds)) * BLOCKS + (hashes >> np.uint64(64 - BLOCKS.bit_length() + 1)).astype(np.int64)
        inner = np.r_[0, np.cumsum(np.bincount(cell, minlength=len(batch) * BLOCKS))].astype(np.int32)
        blocks = pa.ListArray.from_arrays(pa.array(inner), pa.array(hashes.view(np.int64)))
        rows = pa.ListArray.from_arrays(pa.array((np.arange(len(batch) + 1) * BLOCKS).astype(np.int32)), blocks)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(bounds).astype(np.int64)), rows], names=["id", "n", "blocks"])


def similar(x: Column, y: Column, n_x: Column, n_y: Column) -> Column:
    """Whether two rows, in blocks of columns, have the overlap that their sizes demand.

    The overlap is added up block by block, until what it and the smaller rest
    can reach is too little.
    """
    enough = lambda overlap: (100 + PERCENT) * overlap >= PERCENT * (n_x + n_y)
    state = lambda overlap, a, b: F.struct(overlap.cast("long").alias("overlap"), a.cast("long").alias("a"), b.cast("long").alias("b"))

    def add(s: Column, i: Column) -> Column:
        a, b = F.get(x, i), F.get(y, i)
        return F.when(enough(s["overlap"] + F.least(s["a"], s["b"])), state(s["overlap"] + F.size(F.array_intersect(a, b)), s["a"] - F.size(a), s["b"] - F.size(b))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), state(F.lit(0), n_x, n_y), add, lambda s: enough(s["overlap"]))


def jaccard_classes(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """rid, doc_id, version, n_shingles, root and component_id of every row of ``docs``; rows of one root are one group."""
    docs = docs.select("doc_id", "text").withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    with arrow_rows(scratch.spark, BATCH_ROWS):
        levels = frequency_levels(docs)
        numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "version", "text")
        rows = scratch.keep(numbered.mapInArrow(_columns(levels), f"rid long, doc_id {kind}, version long, n long, f1 long, f2 long, keys array<long>"), "rows")
    blank = scratch.keep(rows.filter("n = 0").select("rid", "doc_id", "version", "n"), "blank")
    classes = rows.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("rid").alias("id"), F.min("doc_id").alias("smallest"), F.count("*").alias("copies"))
    classes = scratch.keep(classes, "classes")
    copies = join_counted(rows.filter("n > 0").select("rid", "doc_id", "version", "n", "f1", "f2"), classes, ["n", "f1", "f2"], "copies", -1 - F.col("rid"))
    copies = scratch.keep(copies.select("rid", "doc_id", "version", "n", "id"), "copies")
    others = scratch.keep(copies.filter("rid <> id").select("rid"), "others")
    heads = rows.filter("n > 0").select("rid", "n", "keys").join(bounded_bytes(others, 64), "rid", "left_anti")
    each = heads.select(F.col("rid").alias("id"), F.posexplode("keys").alias("pos", "key"))
    often = F.broadcast(frequent(scratch, each.select("key", "id"), "key"))
    counted = each.join(often, "key", "left_anti").withColumn("ids", F.count("*").over(W.partitionBy("key"))).filter("ids > 1").drop("ids")
    shared = scratch.keep(counted.unionByName(each.join(often, "key", "left_semi")), "shared")
    # what holds for a whole row meets its shared columns only after those that no other row has are gone
    sized = rows.filter("n > 0").select(F.col("rid").alias("id"), "n", F.size("keys").alias("columns"), F.element_at("keys", -1).alias("last"))
    # a set can have no more in common with one whose prefix ends no earlier than its columns that are shared and those
    # beyond its prefix; if the other prefix ends earlier, columns of this prefix may stand behind it
    reach = F.col("n") - F.col("columns") + F.count("*").over(W.partitionBy("id"))
    shared = scratch.keep(shared.join(sized, "id").withColumn("reach", reach).drop("columns"), "postings")
    scratch.drop("rows")
    scratch.drop("shared")
    places = copies.filter("rid = id").select("id", "doc_id", "version", "n")
    turn = count()

    def possible(left: str, right: str):
        a, b, pa, pb = F.col(f"n_{left}"), F.col(f"n_{right}"), F.col(f"pos_{left}"), F.col(f"pos_{right}")
        ends = F.col(f"last_{left}"), F.col(f"last_{right}")
        # the first column that two sets share has all others behind it in both
        most = F.least(a - pa, b - pb, F.when(ends[0] <= ends[1], F.col(f"reach_{left}")), F.when(ends[1] <= ends[0], F.col(f"reach_{right}")))
        return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b)) & ((100 + PERCENT) * most >= PERCENT * (a + b))

    def before(postings: DataFrame) -> DataFrame:
        """Some columns of the row that come before, which two rows that share them meet under."""
        return postings.withColumn("before", F.collect_list("key").over(W.partitionBy("id").orderBy("pos").rowsBetween(-BEFORE, -1)))

    def linked(pairs: DataFrame) -> DataFrame:
        k = next(turn)
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(places, "id")
        wanted = scratch.keep(wanted.select("id", F.col("doc_id").alias("d"), F.col("version").alias("v")), f"wanted{k}")
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))
        texts = docs.join(bounded_bytes(wanted, 128), same).select("id", "text")
        with arrow_rows(scratch.spark, BATCH_ROWS):
            sets = scratch.keep(texts.mapInArrow(_sets, "id long, n long, blocks array<array<long>>").dropDuplicates(["id"]), f"sets{k}")
        if k:
            scratch.drop(f"sets{k - 1}")  # the links of that call have been kept
        halves = pairs.join(sets.withColumnsRenamed({"id": "b", "n": "nb", "blocks": "y"}), "b")
        leaders = sets.join(pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("pairs")), "id").withColumnsRenamed({"id": "a", "n": "na", "blocks": "x"})
        whole = join_counted(halves, leaders, ["a"], "pairs", -1 - F.col("b"))
        return whole.filter(similar(F.col("x"), F.col("y"), F.col("na"), F.col("nb"))).select("a", "b")

    both = lambda rows: rows.select(F.col("id_l").alias("a"), F.col("id_r").alias("b"))
    roots = groups(scratch, shared, possible, both, linked, before)
    classes = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = classes.groupBy("root").agg(F.min("smallest").alias("component_id"), F.count("*").alias("classes"))
    labelled = scratch.keep(join_counted(classes.select("id", "root", "copies"), scratch.keep(smallest, "smallest"), ["root"], "classes", -1 - F.col("id")).select("id", "copies", "root", "component_id"), "labelled")
    joined = join_counted(copies, labelled, ["id"], "copies", -1 - F.col("rid")).select("rid", "doc_id", "version", F.col("n").alias("n_shingles"), "root", "component_id")
    return joined.unionByName(blank.select("rid", "doc_id", "version", F.col("n").alias("n_shingles"), (-1 - F.col("rid")).alias("root"), F.col("doc_id").alias("component_id")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    The set of a text has its distinct shingles of five words, or the whole
    sequence if it has fewer; null, empty and blank texts have an empty set
    and no link. Rows whose sets have a Jaccard similarity of 0.75 or more are
    linked; ``component_id`` is the smallest doc_id that links reach (null
    doc_ids count only if there is no other). Shingles are told apart by 64
    bits. Repeated rows are in one component; other columns are ignored.
    """
    return jaccard_classes(Scratch(spark, "jaccard"), docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of linked rows: that with the smallest doc_id."""
    scratch = Scratch(spark, "jaccard")
    rows = scratch.keep(jaccard_classes(scratch, docs).select("doc_id", "version", "root"), "groups")
    stay = rows.groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("stay"), F.count("*").alias("rows")).filter("rows > 1")
    met = join_counted(rows, scratch.keep(stay, "stay"), ["root"], "rows", F.lit(-(2**62)) - F.abs(F.col("version") / 4).cast("long")).filter("stay IS NOT NULL")
    other = ~(F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("version") == F.col("stay.version")))
    gone = scratch.keep(met.filter(other).select(F.col("doc_id").alias("_d"), F.col("version").alias("_v")).distinct(), "gone")
    repeated = not rows.groupBy("doc_id", "version").count().filter("count > 1").isEmpty()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_w"))
    left = keyed.join(bounded_bytes(gone, 128), F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_w") == F.col("_v")), "left_anti")
    return (left.dropDuplicates(["_i", "_w"]) if repeated else left).select("row.*")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ngram_jaccard`` of ``documents``: every row with the size of its set and its component; empty sets are alone."""
    return ngram_jaccard(spark, table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(w[i + 1 : i + 5], ' ') AS g
  FROM (SELECT rid, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
link AS (
  SELECT p.a, p.b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL) p
  JOIN n na ON na.rid = p.a JOIN n nb ON nb.rid = p.b WHERE 100 * o >= 75 * (na.n + nb.n - o)
), reach AS (
  SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (rid)
JOIN (SELECT reach.a AS rid, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.rid = reach.b GROUP BY 1) c USING (rid)
"""
