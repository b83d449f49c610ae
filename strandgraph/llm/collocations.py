"""Collocations by contiguous pattern growth from frequent prefixes.

Chunks of texts keep their words as codes and count each distinct word once.
Words that are frequent over all chunks are the prefixes of length one. A
chunk projects each occurrence of a frequent prefix: a pointer to it becomes
what stands to its right, up to the end of the piece, the longest phrase, or
an infrequent word, behind which no frequent phrase goes on. Equal pointers of
a chunk are one, with their number. Pointers are dealt by prefix, those of a
very frequent word by the word after it too, and every prefix is grown to the
right depth first within one task, as long as it is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _words
from ._grams import text_bytes
from ._io import table
from ._scratch import Scratch, setting
from .bpe import _opened, _pressed, _whole, arrow_rows

#: Least frequency, longest phrase, phrases returned for each language.
LEAST, LONGEST, TOP = 10, 3, 2000
#: A phrase goes if a longer one around it has so many hundredths of its occurrences.
COVERED = 50
#: Bytes of text in a chunk.
CHUNK_BYTES = 12_000_000
#: Pointers in a bucket, in the mean and at most; a word that might fill a quarter of one is dealt by the word after it.
BUCKET_POINTERS = 4_000_000
#: Pointers whose prefixes grow together.
PORTION = 500_000
#: Rows that cross to Python at once.
BATCH_ROWS = 256
UNKNOWN = "und"


def _bytes_of(*ranges: tuple[int, int]) -> np.ndarray:
    found = np.zeros(256, bool)
    for low, high in ranges:
        found[low : high + 1] = True
    return found


#: What ends a piece, and what stands between words.
BREAKS = _bytes_of((0x2E, 0x2E), (0x2C, 0x2C), (0x3B, 0x3B), (0x3A, 0x3A), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
GAPS = _bytes_of((0x20, 0x20), (0x09, 0x09))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts in their order; the text of each, and whether it goes on a piece with the word before it."""
    held, ends = text_bytes(texts)
    if not len(held):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, bool)
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    data = lower[held]
    breaks = BREAKS[data]
    inner = ~(breaks | GAPS[data])
    opens = inner & ~np.r_[False, inner[:-1]]
    first = np.unique(ends[:-1][np.diff(ends) > 0])
    opens[first] = inner[first]
    at = np.flatnonzero(opens)
    # between the start of a word and that of the next stand only its own bytes and separators
    offsets = np.r_[np.cumsum(inner)[at] - 1, np.count_nonzero(inner)].astype(np.int64)
    owner = np.searchsorted(ends, at, side="right") - 1
    piece = np.cumsum(breaks)[at]
    follows = np.r_[False, (owner[1:] == owner[:-1]) & (piece[1:] == piece[:-1])] if len(at) else np.zeros(0, bool)
    joined = np.ascontiguousarray(data[inner])
    spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    return spelt, owner, follows


#: Rows of chunks: the words as codes, or one distinct word of a language with its number in the chunk.
CHUNKS = "chunk long, n int, payload binary, lang array<string>, word array<string>, times array<long>"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: its words as codes, with marks of those that go on a piece, and what each code means."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    for part in _words.portions(batches, "text", CHUNK_BYTES):
        spelt, owner, follows = words(part["text"].combine_chunks())
        langs = part["lang"].combine_chunks().dictionary_encode()
        langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
        coded = spelt.dictionary_encode()
        # one code for each word of each language
        own = langs.indices.to_numpy()[owner].astype(np.int64) * max(1, len(coded.dictionary)) + coded.indices.to_numpy() if len(owner) else np.zeros(0, np.int64)
        distinct, codes, times = np.unique(own, return_inverse=True, return_counts=True)
        lang, word = np.divmod(distinct, max(1, len(coded.dictionary)))
        row = {
            "chunk": [chunk],
            "n": [len(codes)],
            "payload": [_pressed(codes.astype(np.int32), follows.view(np.uint8))],
            "lang": [langs.dictionary.take(pa.array(lang))],
            "word": [coded.dictionary.take(pa.array(word)).cast(pa.binary()).view(pa.string())],
            "times": [times],
        }
        chunk += 1
        if len(codes):
            lists = {k: pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), pa.array(v[0]) if isinstance(v[0], np.ndarray) else v[0].cast(pa.string())) for k, v in row.items() if k in ("lang", "word", "times")}
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(row["chunk"], pa.int64()), "n": pa.array(row["n"], pa.int32()), "payload": pa.array(row["payload"], pa.binary())} | lists)


def _projected(buckets: int, longest: int):
    """Pointers of a chunk's frequent words to what stands to their right, dealt into buckets."""

    def project(texts: pa.Table, known: pa.Table) -> pa.Table:
        n = texts["n"][0].as_py()
        codes, follows = _opened(texts["payload"][0].as_py(), n)
        size = int(codes.max()) + 1 if n else 0
        dense, hot = np.full(size, -1, np.int64), np.zeros(known.num_rows, bool)
        names = known["gid"].to_numpy()
        order = np.argsort(names)
        dense[known["code"].to_numpy()[order]] = np.arange(len(order))
        hot, names = known["hot"].to_numpy()[order], names[order]
        word = np.r_[dense[codes], np.full(longest, -1)]
        goes = np.r_[follows[:n].astype(bool), np.zeros(longest, bool)]
        at = np.flatnonzero(word[:n] >= 0)
        columns = [word[at]]
        for k in range(1, longest):
            # an infrequent word, or the end of the piece, ends the pointer
            columns.append(np.where((columns[-1] >= 0) & goes[at + k], word[at + k], -1))
        keep = columns[1] >= 0 if longest > 1 else np.ones(len(at), bool)
        columns = [c[keep] for c in columns]
        base, key = len(names) + 1, np.zeros(int(keep.sum()), np.int64)
        for c in columns:
            # the rank of what came before keeps the key within 64 bits
            key = np.unique(key, return_inverse=True)[1] * base + (c + 1) if len(key) else key
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        columns = [c[first] for c in columns]
        mixed = columns[0].copy() if len(columns) else np.zeros(0, np.int64)
        mixed = names[mixed].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) if len(first) else np.zeros(0, np.uint64)
        if len(first):
            mixed = np.where(hot[columns[0]], (mixed ^ (names[columns[1]].astype(np.uint64) + np.uint64(1))) * np.uint64(0xC2B2AE3D27D4EB4F), mixed)
        deal = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(deal, kind="stable")
        edges = np.flatnonzero(np.r_[True, deal[by][1:] != deal[by][:-1], True]) if len(by) else np.zeros(1, int)
        found = {"bucket": [], "n": [], "payload": []}
        spread = np.r_[names, -1]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = by[a:b]
            wide = np.concatenate([*(spread[c[own]] for c in columns), times[own]]).astype(np.int64)
            found["bucket"].append(int(deal[own[0]]))
            found["n"].append(len(own))
            found["payload"].append(_pressed(*wide.view(np.int32).reshape(-1, 2).T.copy()))
        return pa.table({"bucket": pa.array(found["bucket"], pa.int32()), "n": pa.array(found["n"], pa.int32()), "payload": pa.array(found["payload"], pa.binary())})

    return project


def grow(columns: list[np.ndarray], times: np.ndarray, least: int, prefix: tuple[np.ndarray, ...] = ()) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """The frequent phrases among pointers (``columns`` of words, -1 behind their end).

    The pointers of the prefixes are split by the word at their depth; sums
    below ``least`` go with all that they lead to, and what is left grows on
    by the next word.
    """
    depth = len(prefix)
    if depth == len(columns) or not len(times):
        return
    rank = prefix[-1] if prefix else np.zeros(len(times), np.int64)
    real = columns[depth] >= 0
    columns, times, rank = [c[real] for c in columns], times[real], rank[real]
    order = np.lexsort((columns[depth], rank))
    columns, times, rank = [c[order] for c in columns], times[order], rank[order]
    starts = np.flatnonzero(np.r_[True, (columns[depth][1:] != columns[depth][:-1]) | (rank[1:] != rank[:-1])]) if len(times) else np.zeros(0, np.int64)
    sums = np.add.reduceat(times, starts) if len(starts) else np.zeros(0, np.int64)
    kept = sums >= least
    yield tuple(c[starts[kept]] for c in columns[: depth + 1]), sums[kept]
    place = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(times)]))
    on = kept[place]
    yield from grow([c[on] for c in columns], times[on], least, (*prefix, place[on]))


def _grown(least: int, longest: int):
    def run(rows: pa.Table) -> pa.Table:
        counts = rows["n"].to_pylist()
        parts = []
        for payload, n in zip(rows["payload"].to_pylist(), counts, strict=True):
            low, high, _ = _opened(payload, n * (longest + 1), n * (longest + 1))
            parts.append(np.stack([low, high], axis=1).ravel().view(np.int64).reshape(longest + 1, n))
        whole = np.concatenate(parts, axis=1)
        phrases, sums = [], []
        whole = whole[:, np.argsort(whole[0], kind="stable")]
        begins = np.flatnonzero(np.r_[True, whole[0][1:] != whole[0][:-1]])
        # prefixes in portions of pointers, each grown to its full depth before the next
        places = np.searchsorted(begins, np.arange(0, whole.shape[1], PORTION), side="right") - 1
        edges = np.r_[begins[np.unique(places)], whole.shape[1]] if len(begins) else np.zeros(1, np.int64)
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            for found, a in grow(list(whole[:longest, x:y]), whole[longest, x:y], least):
                if len(found) > 1:
                    lists = np.stack(found, axis=1)
                    phrases.append(pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * len(found)), pa.array(lists.ravel())))
                    sums.append(a)
        empty = pa.array([], pa.list_(pa.int64()))
        return pa.table({"phrase": pa.concat_arrays([empty, *phrases]), "a": pa.array(np.concatenate([np.zeros(0, np.int64), *sums]))})

    return run


def mine(spark: SparkSession, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The frequent words, all frequent longer phrases, and the number of words, of each language of ``docs`` (text, lang).

    Returns kept tables (gid, lang, word, a), (phrase: array of gid, a) and
    (lang, n). Counts are over all texts; none is left out or cut.
    """
    scratch = scratch or Scratch(spark, "collocations")
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with arrow_rows(spark, BATCH_ROWS):
        chunks = scratch.keep(rows.mapInArrow(_chunked, CHUNKS), "chunks")
        single = chunks.select("chunk", F.posexplode(F.arrays_zip("lang", "word", "times")).alias("code", "w")).select("chunk", "code", "w.*")
        totals = scratch.keep(single.groupBy("lang", "word").agg(F.sum("times").alias("a")), "words")
        sizes = totals.groupBy("lang").agg(F.sum("a").alias("n"))
        named = scratch.keep(totals.filter(F.col("a") >= least).select(F.monotonically_increasing_id().alias("gid"), "lang", "word", "a"), "frequent")
        tokens = chunks.agg(F.sum("n").alias("n")).first()["n"] or 0
        buckets = max(parts, -(-tokens // BUCKET_POINTERS))
        hot = tokens / buckets / 4
        known = single.join(named.withColumn("hot", F.col("a") > hot), ["lang", "word"]).select(F.col("chunk").alias("of_chunk"), "code", "gid", "hot")
        pointers = chunks.select("chunk", "n", "payload").groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(_projected(buckets, longest), "bucket int, n int, payload binary")
        # a bucket is as large as it is planned, so none is put together with others
        with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
            phrases = scratch.keep(pointers.groupBy("bucket").applyInArrow(_grown(least, longest), "phrase array<long>, a long"), "phrases")
    return named, phrases, sizes


def score() -> Column:
    """floor(1000000 a a / (l r)) of the columns a, l and r, by decimals of 38 digits; exact up to counts of 10^15."""
    return F.expr("cast((1000000 * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)")


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The first ``top`` phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts all occurrences of a phrase within pieces of texts, overlaps
    included; a phrase needs ``least``. Of the cuts into two parts with
    frequencies l and r, the one with the lowest floor(1000000 a a / (l r))
    counts, the first of equals. A phrase inside a longer one that has
    ``covered`` hundredths of its occurrences or more goes. Null langs are
    ``und``, null texts empty; repeated rows count each; other columns are
    ignored; no text gives an empty result.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    scratch = Scratch(spark, "collocations")
    named, phrases, sizes = mine(spark, docs, least, longest, scratch)
    single = named.select(F.array("gid").alias("phrase"), "a")
    every = single.unionByName(phrases)
    candidates = phrases.select("phrase", "a", F.size("phrase").alias("words"))
    # all cuts as rows, with the frequency of either part
    cuts = candidates.select("phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")).alias("right"))
    parts = cuts.join(every.select(F.col("phrase").alias("left"), F.col("a").alias("l")), "left").join(every.select(F.col("phrase").alias("right"), F.col("a").alias("r")), "right")
    best = parts.withColumn("score", score()).groupBy("phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("s")).select("phrase", "s.*")
    # phrases of any length inside a longer one, with the highest frequency of such
    lengths = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("length")
    longer = candidates.filter("words > 2").select("phrase", "a", "words", lengths)
    longer = longer.select("a", F.col("phrase").alias("around"), "length", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)).alias("at"))
    inside = longer.select(F.slice("around", F.col("at"), F.col("length")).alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("around"))
    kept = best.join(inside, "phrase", "left").filter(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a")))
    # words by the order of their places; a gid belongs to one language
    spelt = kept.select("phrase", "a", "l", "r", "score", F.posexplode("phrase").alias("pos", "gid")).join(named.select("gid", "lang", "word"), "gid")
    put = spelt.groupBy("phrase").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("l").alias("l"), F.first("r").alias("r"), F.first("score").alias("score"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    rows = scratch.keep(put.select("lang", F.array_join("w.word", " ").alias("phrase"), "a", "l", "r", "score"), "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of each share of a language, then of ever fewer shares
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while shares > 1:
        dealt = rows.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
        rows = dealt.withColumn("_n", F.row_number().over(W.partitionBy("lang", "_share").orderBy(*order))).filter(F.col("_n") <= top).drop("_n", "_share")
        shares //= 32
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``collocations`` of ``documents``: every row and whole text."""
    return collocations(spark, table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
lists AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM lists
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists
), f AS (SELECT lang, words, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND a >= 10),
cuts AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM c
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE words = 3
), scored AS (
  SELECT cuts.*, l.a AS l, r.a AS r, (1000000::HUGEINT * cuts.a * cuts.a) // (l.a::HUGEINT * r.a) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp JOIN f r ON r.lang = cuts.lang AND r.phrase = rp
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS around FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE words = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE words = 3
  ) GROUP BY ALL
), kept AS (SELECT best.* FROM best LEFT JOIN inside i ON i.lang = best.lang AND i.phrase = best.phrase WHERE i.around IS NULL OR 100 * i.around < 50 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
