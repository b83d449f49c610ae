"""Token ids as binary shard files: each document a zstandard frame of a dictionary that all share.

A shard file is a row of records with a line feed after each: a header
(``HEADER``: magic, version, bytes of an id, shard, SHA-256 of the
dictionary), one frame for each document in ascending doc_id order, and the
index with its own place and the magic at the end. The index is an Arrow
stream: doc_id, offset and length of the frame, n_tokens, and start within the
shard. ``dictionary`` beside the shards holds the dictionary, and ``index`` the
rows of all indices as a table, by which one document is read alone.

Spark's text writer writes the records as they are, so a shard appears whole
or not at all, wherever the folder lies, and a lost executor costs its tasks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _words
from ._io import table
from ._scratch import Scratch
from .bpe import _specials, arrow_rows, default_path

MAGIC = b"TOKIDSZ1"
#: Magic, version, bytes of an id, shard, SHA-256 of the dictionary.
HEADER = "<8sBBI32s"
#: Place of the index in the file, magic.
TRAILER = "<Q8s"
END_ID = 0
#: Bytes of the dictionary, of a piece that it learns from, pieces of one document, and documents, at most.
DICTIONARY_BYTES, PIECE_BYTES, PIECES, SAMPLE_DOCS = 65_536, 2048, 4, 2000
LEVEL = 3
#: Bytes of text in a shard, in the mean and at most.
SHARD_TEXT = 128_000_000
#: Rows that cross to Python at once.
BATCH_ROWS = 256


def _ids(table: pa.Table, path: str, width: int) -> Iterator[np.ndarray]:
    """The ids of each text, with the end id, in the type that files hold."""
    (ids, bounds, _), = _words.encoded(table["text"], [_words.byte_level(path, True)], _specials(path))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.append(ids[a:b], END_ID).astype(f"<u{width}")


def _width(path: str) -> int:
    return 2 if len(_words.byte_level(path, True).spelling) <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, path: str, rows: int | None = None) -> bytes:
    """A dictionary trained on serialised ids of up to SAMPLE_DOCS documents; empty for an empty table.

    Which documents depends on a hash of all rows. A document gives PIECES
    pieces of PIECE_BYTES, evenly apart, so that what reaches the driver is
    bounded. A dictionary never changes what is read back, only its size.
    """
    import zstandard

    rows = docs.count() if rows is None else rows
    turn, width = F.xxhash64("doc_id", "text"), _width(path)
    if rows > 2 * SAMPLE_DOCS:
        docs = docs.filter(turn < int(-(2**63) + 2**64 * (1.5 * SAMPLE_DOCS / rows)))
    chosen = docs.orderBy(turn).limit(SAMPLE_DOCS).select("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _words.portions(batches, "text"):
            pieces = []
            for ids in _ids(part, path, width):
                whole = ids.tobytes()
                places = range(0, len(whole), PIECE_BYTES)
                pieces += [whole[a : a + PIECE_BYTES] for a in places[:: max(1, -(-len(places) // PIECES))]]
            yield pa.RecordBatch.from_pydict({"piece": pa.array(pieces, pa.binary())})

    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        samples = chosen.mapInArrow(cut, "piece binary").toArrow()["piece"].to_pylist()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # too little to train on: the pieces themselves are the dictionary
        return b"".join(samples)[:DICTIONARY_BYTES]


def _codec(dictionary: bytes):
    import zstandard

    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, **shared), zstandard.ZstdDecompressor(**shared)


def _shard(path: str, width: int, dictionary: bytes):
    """Records of one shard from the documents of a task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        compress = _codec(dictionary)[0].compress
        header = struct.pack(HEADER, MAGIC, 1, width, TaskContext.get().partitionId(), hashlib.sha256(dictionary).digest())
        at, start, index = len(header) + 1, 0, []
        begun = False
        for part in _words.portions(batches, "text"):
            records = [] if begun else [header]
            begun = True
            lengths, counts = [], []
            for ids in _ids(part, path, width):
                records.append(compress(ids.tobytes()))
                lengths.append(len(records[-1]))
                counts.append(len(ids))
            starts, places = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(np.array(lengths) + 1)]
            columns = [part["doc_id"].combine_chunks(), pa.array(at + places[:-1]), pa.array(lengths, pa.int64()), pa.array(counts, pa.int64()), pa.array(start + starts[:-1])]
            index.append(pa.table(columns, names=["doc_id", "offset", "length", "n_tokens", "start"]))
            at, start = at + int(places[-1]), start + int(starts[-1])
            yield pa.RecordBatch.from_pydict({"record": pa.array(records, pa.binary())})
        if begun:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, index[0].schema) as stream:
                for x in index:
                    stream.write_table(x)
            yield pa.RecordBatch.from_pydict({"record": pa.array([sink.getvalue().to_pybytes() + struct.pack(TRAILER, at, MAGIC)], pa.binary())})

    return pack


def write(spark: SparkSession, docs: DataFrame, folder: str, path: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes the ids of all ``docs`` (doc_id, text) to ``folder`` and returns the index, read back from the files.

    Rows are in ascending order of doc_id, nulls first; rows of the same doc_id
    in the order of hashes of their texts. A null text is an empty one; every
    document ends with END_ID, so none is empty. Repeated rows stay, and a
    doc_id that many rows share goes over several shards. Other columns are
    ignored. An empty table gives no shard. There are ``shards`` files at
    most, by default as many as shuffles have partitions, or more if texts
    would fill over SHARD_TEXT bytes of each.
    """
    path = path or default_path()
    width = _width(path)
    rows = docs.select("doc_id", "text")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["bytes"] or 0) // SHARD_TEXT))
    dictionary = train_dictionary(rows, path, size["n"])
    whole = spark.createDataFrame([(bytearray(dictionary),)], "record binary").coalesce(1)
    whole.select(F.col("record").cast("string")).write.text(f"{folder}/dictionary")
    keys = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = rows.withColumns({"_text": keys[1], "_row": keys[2]}).repartitionByRange(shards, "doc_id", "_text", "_row").sortWithinPartitions("doc_id", "_text", "_row")
    records = dealt.select("doc_id", "text").mapInArrow(_shard(path, width, dictionary), "record binary")
    with arrow_rows(spark, BATCH_ROWS):
        records.select(F.col("record").cast("string")).write.text(f"{folder}/shards")
    found = read(spark, folder, docs.schema["doc_id"].dataType.simpleString())
    with arrow_rows(spark, 1):
        found.write.option("compression", "zstd").parquet(f"{folder}/index")
    parts = spark.read.schema(found.schema).parquet(f"{folder}/index")
    # one row for each shard, so the sum before it goes over as many rows as there are files
    totals = parts.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    before = totals.select("shard", F.coalesce(F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return parts.join(before, "shard").withColumn("start", F.col("before") + F.col("start")).drop("before")


def _dictionary(spark: SparkSession, folder: str) -> bytes:
    """The dictionary of a folder: DICTIONARY_BYTES at most."""
    rows = spark.read.format("binaryFile").load(f"{folder}/dictionary").filter("length > 0").select("content").collect()
    return bytes(rows[0]["content"])[:-1]


def _parsed(dictionary: bytes, with_ids: bool):
    """Rows of the index of whole shard files, each with the checksum of its ids."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = _codec(dictionary)[1].decompress
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                magic, version, width, shard, digest = struct.unpack(HEADER, data[: struct.calcsize(HEADER)])
                if magic != MAGIC or version != 1 or digest != hashlib.sha256(dictionary).digest():
                    raise ValueError(f"{name} is no shard of this dictionary")
                at, magic = struct.unpack(TRAILER, data[-struct.calcsize(TRAILER) - 1 : -1])
                index = pa.ipc.open_stream(pa.py_buffer(data[at : -struct.calcsize(TRAILER) - 1])).read_all()
                for part in index.to_batches(max_chunksize=2048):
                    lists, sums = [], []
                    for offset, length, n in zip(*(part.column(c).to_pylist() for c in ("offset", "length", "n_tokens")), strict=True):
                        ids = np.frombuffer(decompress(data[offset : offset + length]), f"<u{width}").astype("<u4")
                        if len(ids) != n:
                            raise ValueError(f"{name} has {len(ids)} ids at {offset}, not {n}")
                        sums.append(zlib.crc32(ids.tobytes()))
                        if with_ids:
                            lists.append(ids.astype(np.int32))
                    columns = [part.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64()), pa.array(np.full(len(sums), shard, np.int32)), pa.array([name] * len(sums)), part.column("offset"), part.column("length")]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "file", "offset", "length"]
                    if with_ids:
                        columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return parse


def read(spark: SparkSession, folder: str, doc_id: str = "bigint", with_ids: bool = False) -> DataFrame:
    """The documents of all shard files of ``folder``: doc_id, start (within the shard), n_tokens, ids_crc32, shard, file, offset, length.

    Every frame is decompressed and its number of ids checked; ``with_ids``
    adds the ids. ``doc_id`` is the type of that column. A file crosses to
    Python whole, so the caller's ``arrow.maxRecordsPerBatch`` should be low.
    """
    files = spark.read.format("binaryFile").load(f"{folder}/shards").filter("length > 0").select(F.col("path").alias("file"), "content")
    schema = f"doc_id {doc_id}, start long, n_tokens long, ids_crc32 long, shard int, file string, offset long, length long" + ", ids array<int>" * with_ids
    return files.mapInArrow(_parsed(_dictionary(spark, folder), with_ids), schema)


def document(spark: SparkSession, folder: str, condition: Column) -> list[tuple[object, np.ndarray]]:
    """doc_id and ids of the few documents whose rows in the index meet ``condition``.

    Only their own bytes and the header of their shard are read.
    """
    jvm, decompress = spark._jvm, _codec(dictionary := _dictionary(spark, folder))[1].decompress
    found = []
    for row in spark.read.parquet(f"{folder}/index").filter(condition).select("doc_id", "file", "offset", "length").collect():
        place = jvm.org.apache.hadoop.fs.Path(row["file"])
        stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
        try:
            take = lambda at, n: (stream.seek(at), bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)))[1]  # noqa: B023, E731
            _, _, width, _, digest = struct.unpack(HEADER, take(0, struct.calcsize(HEADER)))
            if digest != hashlib.sha256(dictionary).digest():
                raise ValueError(f"{row['file']} is of another dictionary")
            found.append((row["doc_id"], np.frombuffer(decompress(take(row["offset"], row["length"])), f"<u{width}").astype(np.int32)))
        finally:
            stream.close()
    return found


def op11_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``write`` of ``documents`` to the shared folder: every row, read back from the files; null and empty texts have the end id alone."""
    docs = table(spark, sf_dir, "documents")
    return write(spark, docs, f"{Scratch(spark, 'binary-output').root}").select("doc_id", "start", "n_tokens", "ids_crc32")
