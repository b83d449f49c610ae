"""Alignment of two tokenizers' tokens by a sweep over the places where tokens end.

One pass over the texts gives, for each document and side, its token ends as
events: runs of ids whose lengths place the ends, cut at every ``WINDOW``
bytes. The events of both sides are united, dealt by document and sorted by
offset; a machine walks through them and holds no more than the group that is
open: the tokens since both sides last ended at the same byte. It emits groups
and links. Counts of linked pairs over the corpus are added up from the
distinct pairs of chunks of links, and go back to the chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from . import _words
from ._io import table
from ._scratch import Scratch
from .bpe import _opened, _pressed, _whole, arrow_rows

#: Bytes of a document whose events make one row of a side.
WINDOW = 1 << 20
#: Links after which a chunk is closed.
CHUNK_LINKS = 3_000_000
#: Distinct pairs of chunks in a bucket, in the mean and at most.
BUCKET_PAIRS = 4_000_000
#: Bytes of runs of ids that the machine takes at once.
EVENT_BYTES = 1_500_000
#: Rows that cross to Python at once, of texts and of events.
BATCH_ROWS = 256
#: An id of either side is below this, so a pair fits 32 bits.
IDS = 1 << 16


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _encoders(paths: tuple[str, str]) -> list[_words.Encoder]:
    found = [_words.byte_level(paths[0], False), _words.sentence_pieces(paths[1])]
    if any(len(e.spelling) > IDS for e in found):
        raise ValueError(f"a vocabulary of over {IDS} ids")
    return found


def _windows(ids: np.ndarray, sizes: np.ndarray, window: int) -> Iterator[tuple[int, bytes]]:
    """The ids of a document by the window in which they end."""
    if not len(ids):
        return
    place = (np.cumsum(sizes[ids]) - 1) // window
    edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(place[a]) * window, ids[a:b].astype("<u2").tobytes()


def _events(paths: tuple[str, str], window: int):
    """Rows of events: side 0 and 1 are runs of ids; side -1, once for each document, carries its doc_id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(paths)
        for part in _words.portions(batches, "text"):
            sides = _words.encoded(part["text"], encoders, [], " ")
            right = sides[0][2] & sides[1][2]
            rids = part["rid"].to_pylist()
            row, rid, at, side, ids = [], [], [], [], []
            for i, r in enumerate(rids):
                row.append(i), rid.append(r), at.append(-1), side.append(-1), ids.append(b"")
                for s, (all_ids, bounds, _) in enumerate(sides) if right[i] else ():
                    for place, run in _windows(all_ids[bounds[i] : bounds[i + 1]], encoders[s].sizes, window):
                        row.append(None), rid.append(r), at.append(place), side.append(s), ids.append(run)
            doc_id = _whole(part["doc_id"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), doc_id, pa.array(at, pa.int64()), pa.array(side, pa.int8()), pa.array(ids, pa.binary())], names=["rid", "doc_id", "at", "side", "ids"])

    return emit


def _decimals() -> pa.Array:
    """Every id in decimals with a comma, a bar or a semicolon after it."""
    return pa.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(IDS)], pa.binary())


@dataclass
class _Open:
    """The document that the machine is in."""

    rid: int
    doc_id: pa.Array
    counts: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    spelt: object = field(default_factory=hashlib.sha256)
    links: int = 0


class _Chunk:
    """Links of documents, in their order, and what is known of the documents."""

    def __init__(self, number: int, schema: pa.Schema) -> None:
        self.number, self.schema, self.codes, self.held, self.rows = number, schema, [], 0, []

    def rows_out(self, buckets: int) -> pa.RecordBatch:
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        pairs, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(pairs), np.int32)
        rank[order] = np.arange(len(pairs), dtype=np.int32)
        pairs, counts = pairs[order], counts[order]
        deal = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
        docs = {
            "chunk": self.number,
            "bucket": -1,
            "n": len(codes),
            "payload": _pressed(rank[place.astype(np.int64)]),
            "rid": [r[0] for r in self.rows],
            "links": [r[2] for r in self.rows],
            "counts": [int(v) for r in self.rows for v in r[3]],
            "groups_sha256": [r[4] for r in self.rows],
        }
        out = [docs]
        by = np.argsort(deal, kind="stable")
        edges = np.flatnonzero(np.r_[True, deal[by][1:] != deal[by][:-1], True]) if len(pairs) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = by[a:b]
            out.append({"chunk": self.number, "bucket": int(deal[own[0]]), "n": len(own), "payload": _pressed(pairs[own].view(np.int32), counts[own].astype(np.int32), own.astype(np.int32))})
        names = self.schema.names
        columns = [pa.array([r.get(n) for r in out], self.schema.field(n).type) for n in names if n != "doc_id"]
        ids = pa.concat_arrays([r[1] for r in self.rows]) if self.rows else pa.array([], self.schema.field("doc_id").type.value_type)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(len(out), len(ids))].astype(np.int32)), ids.cast(self.schema.field("doc_id").type.value_type))
        columns.insert(names.index("doc_id"), lists)
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _sweep(paths: tuple[str, str], schema: pa.Schema, buckets: int, chunk_links: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sizes, decimals = [e.sizes for e in _encoders(paths)], _decimals()
        chunk = _Chunk(TaskContext.get().partitionId() << 32, schema)
        rest, now = [np.zeros(0, np.int64)] * 2, None

        def leave(part: _Open | None, ended: bool) -> None:
            """Puts what is known of the open document into the chunk."""
            if part is not None and (ended or part.links):
                digest = "" if not ended or not part.counts[0] else part.spelt.hexdigest()
                chunk.rows.append((part.rid, part.doc_id, part.links, part.counts if ended else np.zeros(4, np.int64), digest))
                part.links = 0

        for part in _words.portions(batches, "ids", EVENT_BYTES):
            batch = part.combine_chunks().to_batches()[0]
            rid, side = batch.column("rid").to_numpy(), batch.column("side").to_numpy()
            begins = np.flatnonzero(side == -1)
            lists = batch.column("ids")
            runs = [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in lists]
            ids = [np.concatenate([rest[s], *(runs[i] for i in np.flatnonzero(side == s))]) for s in (0, 1)]
            ends = [np.cumsum(sizes[s][ids[s]]) for s in (0, 1)]
            # bytes before each document that begins here; what is held of the open one comes first
            lengths = np.array([sizes[0][runs[i]].sum() if side[i] == 0 else 0 for i in range(len(runs))], np.int64)
            begun = int(sizes[0][rest[0]].sum()) + np.r_[0, np.cumsum(lengths)][begins]
            merged = np.concatenate(ends)
            merged.sort(kind="stable")
            merged = merged[np.r_[True, merged[1:] != merged[:-1]]] if len(merged) else merged
            both = [e[np.minimum(np.searchsorted(e, merged), len(e) - 1)] == merged if len(e) else np.zeros(len(merged), bool) for e in ends]
            shared = both[0] & both[1]
            last = int(np.flatnonzero(shared)[-1]) + 1 if shared.any() else 0
            merged, shared, both = merged[:last], shared[:last], [b[:last] for b in both]
            done = [int(b.sum()) for b in both]
            token = [np.cumsum(b) - b for b in both]
            links = (ids[0][token[0]] << 16 | ids[1][token[1]]).astype(np.uint32) if last else np.zeros(0, np.uint32)
            # the order of the text form: the tokens of A of a group, then those of B
            group = np.cumsum(shared) - shared
            own = [group[b] for b in both]
            groups = int(shared.sum())
            each = [np.bincount(g, minlength=groups) for g in own]
            before = np.r_[0, np.cumsum(each[0] + each[1])]
            marked = np.empty(done[0] + done[1], np.int64)
            for s in (0, 1):
                first = before[own[s]] + (each[0][own[s]] if s else 0)
                within = np.arange(done[s]) - np.r_[0, np.cumsum(each[s])][own[s]]
                closing = shared[both[s]]
                marked[first + within] = ids[s][: done[s]] + np.where(closing, IDS * (s + 1), 0)
            spelt, places = _words.text_bytes_of(decimals.take(pa.array(marked)))
            # pieces of documents: the open one up to the first that begins, then one after the other
            edges = np.searchsorted(merged, np.r_[0, begun, np.inf], side="right")
            edges[0], edges[-1] = 0, last
            counts = np.array([np.r_[0, np.cumsum(b)][edges] for b in both])
            shut = np.r_[0, np.cumsum(shared)][edges]
            for k in range(len(begins) + 1):
                if k:
                    leave(now, True)
                    i = int(begins[k - 1])
                    now = _Open(int(rid[i]), batch.column("doc_id").slice(i, 1))
                    if chunk.held >= chunk_links:
                        yield chunk.rows_out(buckets)
                        chunk = _Chunk(chunk.number + 1, schema)
                a, b = int(edges[k]), int(edges[k + 1])
                if a == b:
                    continue
                x, y = places[counts[0][k] + counts[1][k]], places[counts[0][k + 1] + counts[1][k + 1]]
                if now.counts[0]:
                    now.spelt.update(b";")
                now.spelt.update(spelt[x : y - 1])
                now.counts += np.array([counts[0][k + 1] - counts[0][k], counts[1][k + 1] - counts[1][k], shut[k + 1] - shut[k], b - a])
                now.links += b - a
                chunk.codes.append(links[a:b])
                chunk.held += b - a
            if chunk.held >= chunk_links:
                leave(now, False)
                yield chunk.rows_out(buckets)
                chunk = _Chunk(chunk.number + 1, schema)
            rest = [ids[s][done[s] :] for s in (0, 1)]
        leave(now, True)
        if chunk.rows:
            yield chunk.rows_out(buckets)

    return walk


def _totalled(rows: pa.Table) -> pa.Table:
    """The pairs of a bucket with their links in all chunks; the row of chunk -1 has the highest of every B id here."""
    counts = rows["n"].to_pylist()
    opened = [_opened(p, n, n, n) for p, n in zip(rows["payload"].to_pylist(), counts, strict=True)]
    pairs = np.concatenate([x[0].view(np.uint32) for x in opened])
    distinct, place = np.unique(pairs, return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([x[1] for x in opened]), minlength=len(distinct)).astype(np.int64)
    top = np.zeros(IDS, np.int64)
    np.maximum.at(top, distinct & 0xFFFF, total)
    edges = np.r_[0, np.cumsum(counts)]
    chunks, payloads, sizes = [-1], [b""], [0]
    for chunk, x, a, b in zip(rows["chunk"].to_pylist(), opened, edges[:-1], edges[1:], strict=True):
        chunks.append(chunk)
        sizes.append(b - a)
        payloads.append(_pressed(x[2], (x[0] & 0xFFFF).astype(np.int32), *total[place[a:b]].view(np.int32).reshape(-1, 2).T.copy()))
    used = np.flatnonzero(top)
    highest = [list(zip(used.tolist(), top[used].tolist(), strict=True))] + [None] * (len(chunks) - 1)
    return pa.table(
        {"chunk": pa.array(chunks, pa.int64()), "n": pa.array(sizes, pa.int32()), "payload": pa.array(payloads, pa.binary()), "highest": pa.array([h and [{"b": b, "top": t} for b, t in h] for h in highest], HIGHEST)}
    )


HIGHEST = pa.list_(pa.struct([("b", pa.int32()), ("top", pa.int64())]))


def _summed(top: np.ndarray, doc_id: pa.DataType):
    """The documents of a chunk with what their links here add up to."""

    def add(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        parts = [_opened(p, n, n, n, n) for p, n in zip(pairs["payload"].to_pylist(), pairs["n"].to_pylist(), strict=True)]
        size = sum(pairs["n"].to_pylist())
        total, best = np.zeros(size, np.int64), np.zeros(size, bool)
        for place, b, low, high, _ in parts:
            total[place] = np.stack([low, high], axis=1).ravel().view(np.int64)
            best[place] = total[place] == top[b]
        codes = _opened(docs["payload"][0].as_py(), docs["n"][0].as_py())[0]
        links = _whole(docs["links"]).flatten().to_numpy()
        edges = np.r_[0, np.cumsum(links)]
        sums = [np.diff(np.r_[0, np.cumsum(x[codes])][edges]) for x in (total, best.astype(np.int64))]
        counts = _whole(docs["counts"]).flatten().to_numpy().reshape(-1, 4).T
        columns = [_whole(docs["rid"]).flatten(), _whole(docs["doc_id"]).flatten().cast(doc_id), *(pa.array(np.ascontiguousarray(c)) for c in counts), pa.array(sums[1]), pa.array(sums[0]), _whole(docs["groups_sha256"]).flatten()]
        return pa.table(columns, names=["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return add


def _arrow(kind: DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def align(spark: SparkSession, docs: DataFrame, paths: tuple[str, str] | None = None, window: int = WINDOW, chunk_links: int = CHUNK_LINKS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level vocabulary, B a model of pieces; special tokens in texts
    are plain text. Null and empty texts, and texts that A or B do not spell
    back byte by byte, have zeros and an empty digest. Repeated rows are
    counted as often as they stand there, doc_id may be null and of any type,
    and other columns are ignored; an empty table gives an empty result. Rows
    are numbered where they are read, so the plan of ``docs`` has to give the
    same rows in the same order when a task is run again, as a stored table does.
    """
    paths, scratch, kind = paths or default_paths(), Scratch(spark, "alignment"), docs.schema["doc_id"].dataType
    name, arrow = kind.simpleString(), _arrow(kind)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    events = rows.mapInArrow(_events(paths, window), f"rid long, doc_id {name}, at long, side byte, ids binary")
    dealt = events.repartition(buckets, "rid").sortWithinPartitions("rid", "at", "side")
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("payload", pa.binary()), ("rid", pa.list_(pa.int64())), ("doc_id", pa.list_(arrow)), ("links", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("groups_sha256", pa.list_(pa.string()))])
    ddl = f"chunk long, bucket int, n int, payload binary, rid array<long>, doc_id array<{name}>, links array<long>, counts array<long>, groups_sha256 array<string>"
    with arrow_rows(spark, BATCH_ROWS):
        swept = scratch.keep(dealt.mapInArrow(_sweep(paths, schema, buckets, chunk_links), ddl), "swept")
        pairs = swept.filter("bucket >= 0")
        size = pairs.agg(F.sum("n")).first()[0] or 0
        # a bucket is dealt again by chunk if there are so many pairs that it would not fit; its pairs stay together
        if size > bucket_pairs * buckets:
            swept, pairs = _finer(scratch, swept, -(-size // bucket_pairs))
        totals = scratch.keep(pairs.groupBy("bucket").applyInArrow(_totalled, "chunk long, n int, payload binary, highest array<struct<b: int, top: long>>"), "totals")
        # the highest count of each B id: no more rows than B has ids
        top = np.zeros(IDS, np.int64)
        for b, value in totals.filter("chunk = -1").select(F.explode("highest").alias("h")).groupBy("h.b").agg(F.max("h.top")).collect():
            top[b] = value
        own = swept.filter("bucket = -1").select("chunk", "n", "payload", "rid", "doc_id", "links", "counts", "groups_sha256")
        ddl = f"rid long, doc_id {name}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        parts = own.groupBy("chunk").cogroup(totals.filter("chunk >= 0").select("chunk", "n", "payload").groupBy("chunk")).applyInArrow(_summed(top, arrow), ddl)
        sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        whole = parts.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256"))
        return scratch.keep(whole.drop("rid"), "documents")


def _finer(scratch: Scratch, swept: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``swept`` in so many buckets, each row split by a hash of its pairs."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, n, payload in zip(batch.column("chunk").to_pylist(), batch.column("n").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                pairs, counts, place, _ = _opened(payload, n, n, n)
                deal = ((pairs.view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
                by = np.argsort(deal, kind="stable")
                edges = np.flatnonzero(np.r_[True, deal[by][1:] != deal[by][:-1], True])
                own = [by[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"chunk": pa.array([chunk] * len(own), pa.int64()), "bucket": pa.array([int(deal[o[0]]) for o in own], pa.int32()), "n": pa.array([len(o) for o in own], pa.int32()), "payload": pa.array([_pressed(pairs[o], counts[o], place[o]) for o in own], pa.binary())}
                )

    pairs = swept.filter("bucket >= 0").select("chunk", "n", "payload").mapInArrow(split, "chunk long, bucket int, n int, payload binary")
    return swept, scratch.keep(pairs, "pairs")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``align`` of ``documents``: every row and whole text."""
    return align(spark, table(spark, sf_dir, "documents"))
