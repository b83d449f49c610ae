"""Benchmark decontamination through a distributed positional inverted index.

The index stores a posting (term, row, position) for every corpus word that
is a term of the benchmark, and for every row its length. A phrase is found
from its rarest terms: the postings of the rarest one, shifted by its offset
in the phrase, give possible starts; those of the second rarest, shifted by
its own offset, must contain the same start; what is left is compared word by
word with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._io import table
from ._scratch import Scratch

WINDOW = 13
#: Benchmark terms, phrases or documents up to which a side is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000
#: The term number of the posting that carries a row's length.
LENGTH = -1


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def bounded(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``frame``, to be broadcast if it has no more than ``limit`` rows."""
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def build_index(scratch: Scratch, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (rid, term_id, pos) of the ``terms`` (term, term_id) in ``docs``.

    One more posting a row has term_id LENGTH, the number of words as ``pos``,
    doc_id and a hash of the text.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), words(F.col("text")).alias("words"))
    slots = F.concat(F.col("words"), F.array(F.lit(None).cast("string")))
    each = rows.select("rid", "doc_id", "version", F.posexplode(slots).alias("pos", "term"))
    found = each.join(bounded(terms), "term", "left").filter("term_id IS NOT NULL OR term IS NULL")
    tail = F.col("term").isNull()
    return scratch.keep(
        found.select(
            "rid",
            F.coalesce("term_id", F.lit(LENGTH)).alias("term_id"),
            "pos",
            F.when(tail, F.col("doc_id")).alias("doc_id"),
            F.when(tail, F.col("version")).alias("version"),
        ),
        "index",
    )


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The windows of each item: item_id (as text), phrase (array of words), once each."""
    listed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    cut = listed.select("item_id", "words", F.explode(starts).alias("start"))
    return cut.select("item_id", F.slice("words", F.col("start"), F.lit(window)).alias("phrase")).distinct()


def rarest(scratch: Scratch, windows: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct phrases whose terms all occur, with the two rarest: phrase, length, o1, t1, o2, t2.

    A phrase of one distinct term has the same term twice.
    """
    counts = index.filter(F.col("term_id") != LENGTH).groupBy("term_id").agg(F.count("*").alias("uses"))
    known = scratch.keep(terms.join(counts, "term_id", "left"), "terms-counted")
    each = windows.select("phrase").distinct().select("phrase", F.posexplode("phrase").alias("o", "term")).join(known, "term")
    ranked = each.groupBy("phrase").agg(
        F.array_sort(F.collect_list(F.struct("uses", "o", F.col("term_id").alias("t")))).alias("r"),
        F.count("uses").alias("present"),
    )
    ranked = ranked.filter(F.col("present") == F.size("phrase"))
    other = F.filter("r", lambda x: x["t"] != F.col("r")[0]["t"])
    second = F.when(F.size(other) > 0, F.get(other, F.lit(0))).otherwise(F.element_at("r", -1))
    picked = ranked.select("phrase", F.size("phrase").alias("length"), F.col("r")[0].alias("first"), second.alias("second"))
    return scratch.keep(
        picked.select("phrase", "length", F.col("first.o").alias("o1"), F.col("first.t").alias("t1"), F.col("second.o").alias("o2"), F.col("second.t").alias("t2")),
        "rarest",
    )


def starts(index: DataFrame, picked: DataFrame) -> DataFrame:
    """Where the two rarest terms of a phrase stand as in the phrase: rid, start, phrase."""
    postings = index.filter(F.col("term_id") != LENGTH).select("rid", "term_id", "pos")
    one = postings.withColumnRenamed("term_id", "t1").join(bounded(picked), "t1")
    one = one.select("rid", (F.col("pos") - F.col("o1")).alias("start"), "phrase", "o2", "t2").filter("start >= 0")
    needed = bounded(picked.select(F.col("t2").alias("term_id")).distinct())
    two = postings.join(needed, "term_id", "left_semi").select("rid", F.col("term_id").alias("t2"), (F.col("pos")).alias("at"))
    return one.withColumn("at", F.col("start") + F.col("o2")).join(two, ["rid", "t2", "at"]).select("rid", "start", "phrase")


def proximity(index: DataFrame, picked: DataFrame, within: int) -> DataFrame:
    """Proximity matches: rid, phrase, at, distance.

    The two rarest terms of a phrase stand at most ``within`` words apart, in
    any order. ``at`` is the place of the rarest; the nearest match counts.
    """
    postings = index.filter(F.col("term_id") != LENGTH).select("rid", "term_id", "pos")
    one = postings.withColumnRenamed("term_id", "t1").join(bounded(picked), "t1").select("rid", "phrase", "t2", F.col("pos").alias("at"))
    needed = bounded(picked.select(F.col("t2").alias("term_id")).distinct())
    two = postings.join(needed, "term_id", "left_semi").select("rid", F.col("term_id").alias("t2"), F.col("pos").alias("other"))
    cell = lambda c: F.floor(F.col(c) / max(1, within)).cast("int")
    near = one.withColumn("cell", F.explode(F.array(cell("at") - 1, cell("at"), cell("at") + 1)))
    joined = near.join(two.withColumn("cell", cell("other")), ["rid", "t2", "cell"])
    joined = joined.withColumn("distance", F.abs(F.col("at") - F.col("other"))).filter((F.col("distance") > 0) & (F.col("distance") <= within))
    return joined.groupBy("rid", "phrase", "at").agg(F.min("distance").alias("distance"))


def matches(scratch: Scratch, docs: DataFrame, index: DataFrame, windows: DataFrame, picked: DataFrame) -> DataFrame:
    """Exact occurrences of phrases: doc_id, version, start, length, item_id."""
    lengths = index.filter(F.col("term_id") == LENGTH).select("rid", "doc_id", "version")
    possible = scratch.keep(starts(index, picked).join(lengths, "rid").select("doc_id", "version", "start", "phrase").distinct(), "possible")
    touched = bounded(possible.select(F.col("doc_id").alias("d"), F.col("version").alias("v")).distinct())
    texts = docs.withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = texts.join(touched, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "version"]).select("doc_id", "version", words(F.col("text")).alias("words"))
    at = possible.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "start", "phrase")
    same = (F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("version") == F.col("v"))
    checked = texts.join(at, same).filter(F.slice("words", F.col("start") + 1, F.size("phrase")) == F.col("phrase"))
    found = checked.select("doc_id", "version", "start", F.size("phrase").alias("length"), "phrase")
    return scratch.keep(found.join(bounded(windows), "phrase").select("doc_id", "version", "start", "length", "item_id"), "matches")


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, version, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item; an item with fewer
    words, but some, is one window. A word inside any occurrence of a window
    is hit; a row is contaminated if at least a twentieth of its words, and
    one, are hit. Null and empty texts have no words; items without words have
    no window; a null item_id counts as ``null``. Repeated rows are judged
    alike and all returned. ``version`` is a hash of the text.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    scratch = Scratch(spark, "decontamination")
    windows = scratch.keep(phrases(items, window), "windows")
    terms = scratch.keep(windows.select(F.explode("phrase").alias("term")).distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms")
    index = build_index(scratch, docs, terms)
    picked = rarest(scratch, windows, terms, index)
    found = matches(scratch, docs, index, windows, picked)
    spans = found.groupBy("doc_id", "version", "start").agg(F.max("length").alias("length"))
    before = W.partitionBy("doc_id", "version").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    ends = F.col("start") + F.col("length")
    covered = spans.withColumn("from", F.greatest("start", F.coalesce(F.max(ends).over(before), F.lit(0)))).withColumn("new", F.greatest(F.lit(0), ends - F.col("from")))
    hits = covered.groupBy("doc_id", "version").agg(F.sum("new").alias("n_hit"))
    ids = found.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    verdicts = hits.alias("h").join(ids.alias("i"), F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("h.version") == F.col("i.version")))
    verdicts = verdicts.select(F.col("h.doc_id").alias("d"), F.col("h.version").alias("v"), "n_hit", "ids")
    rows = index.filter(F.col("term_id") == LENGTH).select("doc_id", "version", F.col("pos").cast("long").alias("n_words"))
    joined = rows.join(verdicts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "version",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def uncontaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = decontaminate(spark, docs, items, window).filter("contaminated").select(F.col("doc_id").alias("_d"), F.col("version").alias("_v")).distinct()
    gone = bounded(Scratch(spark, "decontamination").keep(found, "contaminated"))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_w"))
    return keyed.join(gone, F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_w") == F.col("_v")), "left_anti").select("row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``decontaminate`` of ``documents`` against ``benchmark``: every row with its hits; null texts have no words."""
    return decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("version")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s + 1 : s + 13], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 12))) AS s FROM b WHERE len(w) > 0)
), occ AS (
  SELECT DISTINCT t.rid, t.s, t.n, win.item_id
  FROM (SELECT rid, n, s, array_to_string(w[s + 1 : s + n], ' ') AS g
        FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)) t
  JOIN win ON win.n = t.n AND win.g = t.g
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM occ) GROUP BY rid
), it AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM occ GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
