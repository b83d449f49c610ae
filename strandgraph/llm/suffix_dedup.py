"""Suffix-array dedup: repeated byte strings found by merging Burrows-Wheeler transforms.

Every window of LENGTH bytes is led by one of its grams, the one with the
smallest hash, so equal windows have the same leader. Consecutive windows with
one leader form a segment. Windows whose leader occurs once in the corpus
cannot repeat. Segments that are equal as a whole are represented by the
first. For leaders with several different segments the suffixes of these are
put in order: small shards of segments are sorted and transformed, and the
transforms are merged by refining an interleave of the shards, one round for
every symbol, until LENGTH bytes are told apart. Rounds also carry the
borders between suffixes that differ so far, the common prefixes; what stays
between two borders is a repeated interval, whose first window stays. Leaders
with more than LEADER_SEGMENTS different segments are split by the windows'
own hashes, so that no leader has to fit into one merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._grams import text_bytes
from ._io import table
from ._scratch import Scratch, bounded_bytes, frequent, join_counted
from .bpe import arrow_rows

LENGTH = 100
GRAM = 32
#: Bytes that one symbol of a transform holds: the most for which a merge has no more than SYMBOLS different ones. A merge of
#: MERGE_BYTES has hardly more places than that, so it takes the longest and the fewest rounds; that of a large leader may not.
STEPS = (10, 4, 2)
SYMBOLS = 1 << 16
#: Bytes that a number of 64 bits holds.
WORD = 8
#: Different segments of a leader that meet in one merge, at most.
LEADER_SEGMENTS = 4096
#: Groups that the segments of a frequent leader are dealt into before copies meet.
SALTS = 256
#: Bytes of segments in a shard, in one merge (a task has DEALT merges on average), and of text that is cut into segments at once.
SHARD_BYTES = 1 << 15
MERGE_BYTES = 1 << 16
DEALT = 16
PIECE_BYTES = 1 << 20
#: Megabytes up to which segments and spans are broadcast to the documents.
BROADCAST_MB = 10
BATCH_ROWS = 500


def version_of(text: Column) -> Column:
    """32 bits that tell apart rows with one doc_id and different texts."""
    return F.hash(F.coalesce(text, F.lit("")))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every place on."""
    wide = data.astype(np.uint64)
    for shift in (1, 2, 4):
        wide = wide[:-shift] | (wide[shift:] << np.uint64(8 * shift))
    eight, n = _mixed(wide), len(data) - GRAM + 1
    total = np.zeros(n, np.uint64)
    for i in range(0, GRAM, 8):
        total = (total * np.uint64(0x9E3779B97F4A7C15)) ^ eight[i : i + n]
    return _mixed(total)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after the other: each segment's text, first window, number of windows, and leader's hash and place."""
    import xxhash

    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    hashes = _gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[: n], best[span - width : span - width + n])
    leader = (best & low).astype(np.int64)
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths - LENGTH + 1, 0))
    skipped = np.repeat(offsets[:-1] - np.r_[0, np.cumsum(np.maximum(lengths - LENGTH + 1, 0))][:-1], np.maximum(lengths - LENGTH + 1, 0))
    at = np.arange(len(owner)) + skipped
    leader = leader[at]
    first = np.flatnonzero(np.r_[True, (leader[1:] != leader[:-1]) | (owner[1:] != owner[:-1])]) if len(at) else none
    windows = np.diff(np.r_[first, len(at)])
    text, start, leader = owner[first], at[first], leader[first]
    view, shift = memoryview(data.tobytes()), leader - start
    whole = [xxhash.xxh3_64_intdigest(view[a : a + w + LENGTH - 1], seed=s) for a, w, s in zip(start.tolist(), windows.tolist(), shift.tolist(), strict=True)]
    return text, start - offsets[text], windows, hashes[leader].view(np.int64), np.array(whole, np.uint64).view(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1)
            for a, b, base in _pieces(offsets[first : last + 1]):
                text, start, windows, leader, whole = segments(data[a:b], base)
                if len(text):
                    start = start + (a - offsets[first] if last == first + 1 else 0)
                    row = pa.array(text + first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leader), pa.array(whole), batch.column("doc_id").take(row), batch.column("version").take(row), pa.array(start << 32 | windows)],
                        names=["leader", "whole", "doc_id", "version", "place"],
                    )
            first = last


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Bounds of bytes to cut at once; a longer text comes in pieces that overlap, each window in one."""
    most = 4 * PIECE_BYTES
    if offsets[-1] - offsets[0] <= most:
        yield offsets[0], offsets[-1], offsets - offsets[0]
        return
    for a in range(offsets[0], offsets[-1] - LENGTH + 1, most):
        b = min(offsets[-1], a + most + LENGTH - 1)
        yield a, b, np.array([0, b - a])


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all shards in one order, as places in the shards one after the other, and the borders.

    A transform maps a suffix to the one a symbol longer: the i-th of equal
    symbols belongs to the i-th suffix that starts with them. A round deals
    the interleave stably by the symbols before its suffixes and moves on to
    the longer ones: then it is in order by one symbol more. Suffixes stay in
    one interval while those they were dealt from were in one; a border says
    that a suffix differs from the one before in the symbols of all rounds.
    """
    symbols = np.concatenate(transforms)
    longer, start = np.empty(len(symbols), np.int32), 0
    for t in transforms:
        longer[start + np.argsort(t, kind="stable")] = np.arange(start, start + len(t), dtype=np.int32)
        start += len(t)
    at, interval = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    border = np.ones(len(symbols), bool)
    for _ in range(rounds):
        own = symbols[at]
        order = np.argsort(own, kind="stable")
        own, interval = own[order], interval[order]
        np.logical_or(own[1:] != own[:-1], interval[1:] != interval[:-1], out=border[1:])
        np.cumsum(border, out=interval)
        at = longer[at[order]]
    return at, border


def repeated_windows(bodies: list[bytes], windows: np.ndarray) -> list[np.ndarray]:
    """For segments in corpus order, which of their windows start earlier in another (or the same) segment."""
    pad = max(STEPS)
    lengths = np.array([len(b) for b in bodies], np.int64) + pad
    ends = np.cumsum(lengths)
    starts = ends - lengths
    text = np.zeros(int(ends[-1]), np.uint8)
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    inside = np.repeat(starts - np.r_[0, np.cumsum(lengths - pad)][:-1], lengths - pad) + np.arange(len(raw))
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)  # UTF-8 has no more than 243 different bytes
    text[inside] = code[raw]
    index = np.arange(len(text))
    seg_start, seg_end = np.repeat(starts, lengths), np.repeat(ends, lengths)
    after = np.zeros(len(text), np.uint64)
    for k in range(WORD):
        place = np.minimum(index + k, len(text) - 1)
        after = after << np.uint64(8) | np.where(index + k < seg_end, text[place], 0).astype(np.uint64)
    for step in STEPS:
        # the bytes before each place, a segment's end coming before its start; more than a word holds are two halves by their order
        half = step if step <= WORD else step // 2
        before = np.zeros(len(text), np.uint64)
        for k in range(half):
            place = index - half + k
            before = before << np.uint64(8) | text[np.where(place < seg_start, place + (seg_end - seg_start), place)]
        if half < step:
            before = np.unique(before, return_inverse=True)[1].astype(np.uint64)
            place = index - half
            before = before[np.where(place < seg_start, place + (seg_end - seg_start), place)] << np.uint64(32) | before
        found, symbols = np.unique(before, return_inverse=True)
        if len(found) <= SYMBOLS:
            break
    symbols = symbols.astype(np.uint16)
    cuts = [0]
    for i in range(1, len(bodies)):
        if ends[i] - starts[cuts[-1]] > SHARD_BYTES:
            cuts.append(i)
    cuts.append(len(bodies))
    places, transforms = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = starts[a], ends[b - 1]
        order = lo + _ordered(after[lo:hi], WORD, ends[a:b] - lo, lengths[a:b])
        transforms.append(symbols[order])
        places.append(order)
    order, border = merge_transforms(transforms, LENGTH // step)
    merged = np.concatenate(places)[order]
    interval = np.cumsum(border)
    isw = index - seg_start < np.repeat(windows, lengths)
    rows = np.flatnonzero(isw[merged])
    at, interval = merged[rows], interval[rows]
    order = np.lexsort((at, interval))
    later = np.r_[False, interval[order][1:] == interval[order][:-1]]
    flags = np.zeros(len(text), bool)
    flags[at[order[later]]] = True
    return [flags[a : a + w] for a, w in zip(starts, windows, strict=True)]


def _ordered(codes: np.ndarray, depth: int, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The suffixes of a shard in the order of LENGTH symbols, by doubling; ``codes`` are the order of their first ``depth``."""
    n, rank = len(codes), np.unique(codes, return_inverse=True)[1].astype(np.int64)
    edge, index = np.repeat(ends, lengths), np.arange(n)
    while depth < LENGTH:
        ahead = index + depth
        key = rank * (n + 1) + np.where(ahead < edge, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        depth *= 2
    return np.argsort(rank, kind="stable")


def _portions(leaders: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with whole leaders, each of MERGE_BYTES or little more."""
    first, held = 0, 0
    for i in range(len(leaders)):
        if held >= MERGE_BYTES and leaders[i] != leaders[i - 1]:
            yield first, i
            first, held = i, 0
        held += sizes[i]
    if first < len(leaders):
        yield first, len(leaders)


def _merged(rows: pa.Table) -> pa.Table:
    # a row of a repeated document comes as often as the document does
    order = pc.sort_indices(rows, [(c, "ascending") for c in ("leader", "doc_id", "version", "start")], null_placement="at_start")
    rows = rows.take(order).combine_chunks()
    new = pa.array([True], pa.bool_())
    if len(rows) > 1:
        above, below = rows.slice(0, len(rows) - 1), rows.slice(1)
        same = [pc.or_kleene(pc.fill_null(pc.equal(above[c], below[c]), False), pc.and_(pc.is_null(above[c]), pc.is_null(below[c]))) for c in ("leader", "doc_id", "version", "start")]
        differs = pc.invert(pc.and_(pc.and_(same[0], same[1]), pc.and_(same[2], same[3])))
        new = pa.concat_arrays([new, differs.combine_chunks() if isinstance(differs, pa.ChunkedArray) else differs])
    rows = rows.filter(new) if len(rows) else rows
    bodies, windows, leaders = rows["body"].to_pylist(), rows["windows"].to_numpy().astype(np.int64), rows["leader"].to_numpy()
    found = []
    for a, b in _portions(leaders, np.array([len(x) for x in bodies], np.int64)):
        for i, f in enumerate(repeated_windows(bodies[a:b], windows[a:b]), a):
            edges = np.flatnonzero(np.diff(np.r_[0, f.astype(np.int8), 0]))
            found += [(i, int(x), int(y)) for x, y in zip(edges[::2], edges[1::2], strict=True)]
    row = pa.array([x[0] for x in found], pa.int64())
    start = rows["start"].combine_chunks().take(row).to_numpy() if found else np.zeros(0, np.int64)
    low, high = np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int64)
    return pa.table({"doc_id": rows["doc_id"].take(row), "version": rows["version"].take(row), "low": pa.array(start + low), "high": pa.array(start + high + LENGTH - 1)})


def _hashed_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each segment by 128 bits."""
    import xxhash

    for batch in batches:
        bodies, windows = batch.column("body").to_pylist(), batch.column("windows").to_pylist()
        hashes = [xxhash.xxh3_128_digest(body[i : i + LENGTH]) for body, n in zip(bodies, windows, strict=True) for i in range(n)]
        pairs = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        row = pa.array(np.repeat(np.arange(len(bodies)), windows))
        start = np.concatenate([s + np.arange(n) for s, n in zip(batch.column("start").to_pylist(), windows, strict=True)]) if bodies else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), batch.column("doc_id").take(row), batch.column("version").take(row), pa.array(start)],
            names=["h1", "h2", "doc_id", "version", "start"],
        )


def _heads(scratch: Scratch, cut: DataFrame) -> DataFrame:
    """The segments whose leader occurs again: leader, doc_id, version, place, head and heads.

    ``head`` says that no equal segment comes earlier; ``heads`` is the number
    of the leader's different segments. Of the segments of frequent leaders,
    copies are found group by group first, so no task has all of them.
    """
    # no more than HOT_SHARE leaders
    often_led = F.col("leader").isin([r.leader for r in frequent(scratch, cut.select("leader", "doc_id", "version", "place"), "leader").collect()])
    columns = ["leader", "whole", "doc_id", "version", "place"]
    is_first = lambda *by: F.rank().over(W.partitionBy(*by).orderBy("doc_id", "version", "place")) == 1

    rest = cut.filter(~often_led).repartition("leader").select(*columns, is_first("leader", "whole").alias("head"))
    group = W.partitionBy("leader")
    rest = rest.select("*", F.count("*").over(group).alias("uses"), F.sum(F.col("head").cast("int")).over(group).alias("heads")).filter("uses > 1").drop("uses")

    often = cut.filter(often_led).withColumn("salt", F.pmod(F.xxhash64("doc_id", "version", "place"), F.lit(SALTS)))
    often = scratch.keep(often.select(*columns, is_first("leader", "whole", "salt").alias("near_head")), "often")
    firsts = scratch.keep(often.filter("near_head").select(*columns, is_first("leader", "whole").alias("head")), "firsts")
    heads = firsts.filter("head").groupBy("leader").agg(F.countDistinct("whole").alias("heads"))
    firsts = firsts.join(F.broadcast(heads), "leader")
    later = often.filter("NOT near_head").select(*columns, F.lit(False).alias("head"), F.lit(0).cast("long").alias("heads"))
    return scratch.keep(rest.unionByName(firsts).unionByName(later).drop("whole"), "shared")


def repeated_spans(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """Stretches of bytes to remove, which may overlap: doc_id, version, low, high."""
    docs = docs.select("doc_id", "text").withColumn("version", version_of(F.col("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    with arrow_rows(scratch.spark, BATCH_ROWS):
        long_enough = docs.filter(F.octet_length("text") >= LENGTH)
        cut = scratch.keep(long_enough.mapInArrow(_cut, f"leader long, whole long, doc_id {kind}, version int, place long"), "segments")
    shared = _heads(scratch, cut)
    scratch.drop("segments")
    start, windows = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    copies = shared.filter("NOT head").select("doc_id", "version", start.alias("low"), (start + windows + LENGTH - 1).alias("high"))
    at = F.struct("leader", start.alias("start"), windows.alias("windows"), (F.col("heads") > LEADER_SEGMENTS).alias("deep"))
    wanted = shared.filter("head AND heads > 1").groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v")).agg(F.collect_set(at).alias("at"))
    wanted = bounded_bytes(scratch.keep(wanted, "wanted"), BROADCAST_MB)
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))).select("doc_id", "version", "text", F.explode("at").alias("x"))
    body = F.substring(F.col("text").cast("binary"), F.col("x.start") + 1, F.col("x.windows") + LENGTH - 1)
    bodies = scratch.keep(texts.select("x.*", "doc_id", "version", body.alias("body")), "bodies")
    total = bodies.filter("NOT deep").agg(F.sum(F.octet_length("body"))).first()[0] or 0
    deal = F.pmod(F.xxhash64("leader"), F.lit(max(1, total // (DEALT * MERGE_BYTES))))
    spans = bodies.filter("NOT deep").withColumn("deal", deal).groupBy("deal").applyInArrow(_merged, f"doc_id {kind}, version int, low long, high long")
    with arrow_rows(scratch.spark, 10 * BATCH_ROWS):
        each = scratch.keep(bodies.filter("deep").mapInArrow(_hashed_windows, f"h1 long, h2 long, doc_id {kind}, version int, start long"), "windows")
    firsts = each.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "version", "start")).alias("first"), F.count("*").alias("uses")).filter("uses > 1")
    met = join_counted(each, scratch.keep(firsts, "first-windows"), ["h1", "h2"], "uses", F.xxhash64("doc_id", "version", "start")).filter("first IS NOT NULL")
    deep = met.filter(F.struct("doc_id", "version", "start") != F.col("first")).select("doc_id", "version", F.col("start").alias("low"), (F.col("start") + LENGTH).alias("high"))
    return scratch.keep(copies.unionByName(spans).unionByName(deep), "spans")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            merged: list[list[int]] = []
            for x in sorted((x["low"], x["high"]) for x in spans or []):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append(list(x))
            edges = [0, *[e for m in merged for e in m], len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "length": b - a} for a, b in merged]))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def dedup_substrings(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans.

    A byte is removed if a string of LENGTH bytes that covers it also starts
    earlier: in a row with a smaller doc_id (null is smallest) or further left
    in the same text. Rows that repeat doc_id and text are one document; rows
    that share only the doc_id are ordered by a hash of their text. ``kept``
    is the rest, which may cut characters; ``spans`` are the removed runs.
    Null counts as empty; other columns are ignored.
    """
    scratch = scratch or Scratch(spark, "suffix-dedup")
    docs = docs.select("doc_id", "text")
    spans = repeated_spans(scratch, docs)
    gone = scratch.keep(spans.groupBy("doc_id", "version").agg(F.collect_set(F.struct("low", "high")).alias("spans")), "gone")
    gone = bounded_bytes(gone, BROADCAST_MB).select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "spans")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("version", version_of(F.col("text")))
    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, length: long>>"
    return met.select("doc_id", "text", "spans").mapInArrow(_removed, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ``dedup_substrings`` of ``documents``: every row; null counts as empty."""
    scratch = Scratch(spark, "suffix-dedup")
    found = dedup_substrings(spark, table(spark, sf_dir, "documents"), scratch).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    with arrow_rows(spark, BATCH_ROWS):
        return scratch.keep(found, "digests")
