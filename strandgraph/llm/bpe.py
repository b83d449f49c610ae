"""BPE encoding through a table of distinct words, and decoding through id-to-piece lookups.

Spark splits the texts into words. A chunk of documents keeps each of its
distinct words once and its texts as positions in that list. The words of all
chunks are dealt into buckets by their hash; a bucket encodes each distinct
word once. The ids go back to the chunks and take the words' positions.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._grams import text_bytes
from ._io import table
from ._scratch import Scratch

#: White space as the pattern of the vocabulary means it (Unicode White_Space).
SPACE = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The word pattern of byte-level BPE vocabularies of this kind.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^" + SPACE + r"\p{L}\p{N}]++|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]++"
)
#: Bytes of words after which a chunk is closed.
CHUNK_BYTES = 8_000_000
#: Words that the library encodes at once.
ENCODE_WORDS = 8192
#: Rows that cross to Python at once.
BATCH_ROWS = 256


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Batches of so many rows at most for what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _specials(path: str) -> list[str]:
    return [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]


def _split_exactly(path: str, text: str) -> list[str]:
    """Words of a text that holds special tokens, or letters newer than Spark's tables."""
    tokenizer, words, rest = _tokenizer(path), [], text
    while rest:
        found = [(rest.find(s), -len(s), s) for s in _specials(path) if s in rest]
        at, _, special = min(found) if found else (len(rest), 0, "")
        words += [rest[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(rest[:at])]
        words += [special] if special else []
        rest = rest[at + len(special) :]
    return words


def _pressed(*parts: np.ndarray) -> bytes:
    """Arrays of integers as planes of bytes, and arrays of bytes, compressed together."""
    planes = [x.view(np.uint8).reshape(-1, 4).T.ravel() if x.dtype == np.int32 else x for x in parts]
    whole = np.concatenate(planes)
    return len(whole).to_bytes(8, "little") + pa.compress(whole.tobytes(), codec="zstd", asbytes=True)


def _opened(payload: bytes, *counts: int) -> list[np.ndarray]:
    """The arrays of integers that ``_pressed`` took, and the bytes after them."""
    whole = np.frombuffer(pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    found, at = [], 0
    for n in counts:
        found.append(np.ascontiguousarray(whole[at : at + 4 * n].reshape(4, n).T).view(np.int32).ravel())
        at += 4 * n
    return [*found, whole[at:]]


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


#: bucket -1: the documents of a chunk, ``payload`` their words as codes. Else words of that bucket, and their codes.
CHUNKS = pa.schema(
    [
        ("chunk", pa.int64()),
        ("bucket", pa.int32()),
        ("n", pa.int32()),
        ("payload", pa.binary()),
        ("rid", pa.list_(pa.int64())),
        ("doc_id", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
    ]
)
CHUNKS_DDL = "chunk long, bucket int, n int, payload binary, rid array<long>, doc_id array<long>, sizes array<int>"


def _packer(path: str, buckets: int):
    def flush(chunk: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        import pandas as pd

        whole = pa.Table.from_batches(parts)
        lists = _whole(whole["words"])
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int32)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        rank = np.empty(len(words), np.int32)
        rank[np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")] = np.arange(len(words), dtype=np.int32)
        rows = [{"chunk": chunk, "bucket": -1, "n": len(codes), "payload": _pressed(rank[codes]), "rid": whole["rid"].to_pylist(), "doc_id": whole["doc_id"].to_pylist(), "sizes": sizes}]
        deal = (pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) % np.uint64(buckets)).astype(np.int32) if len(words) else np.zeros(0, np.int32)
        order = np.argsort(deal, kind="stable")
        bounds = np.flatnonzero(np.r_[True, deal[order][1:] != deal[order][:-1], True]) if len(words) else np.zeros(1, int)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = order[a:b]
            data, offsets = text_bytes(words.take(pa.array(own)))
            rows.append({"chunk": chunk, "bucket": int(deal[own[0]]), "n": len(own), "payload": _pressed(rank[own], np.diff(offsets).astype(np.int32), data)})
        return pa.RecordBatch.from_pylist(rows, schema=CHUNKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            lists = batch.column("words")
            if lists.null_count:
                odd = batch.column("odd").to_pylist()
                lists = pa.array([w if w is not None else _split_exactly(path, odd[i]) for i, w in enumerate(lists.to_pylist())], pa.list_(pa.string()))
            parts.append(pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), lists], names=["rid", "doc_id", "words"]))
            held += lists.nbytes
            if held >= CHUNK_BYTES:
                yield flush(chunk, parts)
                chunk, parts, held = chunk + 1, [], 0
        if parts:
            yield flush(chunk, parts)

    return pack


ENCODED_WORDS = "chunk long, n int, tokens int, payload binary"


def _word_encoder(path: str):
    def encode(rows: pa.Table) -> pa.Table:
        counts = rows["n"].to_pylist()
        opened = [_opened(p, n, n) for p, n in zip(rows["payload"].to_pylist(), counts, strict=True)]
        ends = np.r_[0, np.cumsum(np.concatenate([x[1] for x in opened]))].astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(np.concatenate([x[2] for x in opened])))
        coded = words.dictionary_encode()
        lengths, flat = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for a in range(0, len(coded.dictionary), ENCODE_WORDS):
            encoded = [e.ids for e in _tokenizer(path).encode_batch(coded.dictionary.slice(a, ENCODE_WORDS).to_pylist(), add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, encoded), np.int32, len(encoded)))
            flat.append(np.fromiter((i for ids in encoded for i in ids), np.int32, int(lengths[-1].sum())))
        lengths, flat = np.concatenate(lengths), np.concatenate(flat)
        indices = coded.indices.to_numpy()
        taken = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat)).take(pa.array(indices)).flatten().to_numpy()
        sizes = lengths[indices]
        word, token = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(sizes)]
        payloads, tokens = [], []
        for i, (codes, *_) in enumerate(opened):
            ids = taken[token[word[i]] : token[word[i + 1]]]
            payloads.append(_pressed(codes, sizes[word[i] : word[i + 1]], ids))
            tokens.append(len(ids))
        return pa.table({"chunk": rows["chunk"], "n": rows["n"], "tokens": pa.array(tokens, pa.int32()), "payload": pa.array(payloads, pa.binary())})

    return encode


def _placed(texts: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a chunk's documents, by the positions of its words."""
    parts = [_opened(p, n, n, t) for p, n, t in zip(words["payload"].to_pylist(), words["n"].to_pylist(), words["tokens"].to_pylist(), strict=True)]
    join = lambda i: np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, np.int32)
    sizes, order = join(1), np.argsort(join(0), kind="stable")
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(join(2))).take(pa.array(order))
    codes, _ = _opened(texts["payload"][0].as_py(), texts["n"][0].as_py())
    flat = lambda name: _whole(texts[name]).flatten()
    tokens = np.r_[0, np.cumsum(sizes[order][codes])].astype(np.int32)
    bounds = tokens[np.r_[0, np.cumsum(flat("sizes").to_numpy())]]
    ids = pa.ListArray.from_arrays(pa.array(bounds), lists.take(pa.array(codes)).flatten())
    return pa.table({"rid": flat("rid"), "doc_id": flat("doc_id"), "ids": ids})


def encode(spark: SparkSession, docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, ids (array<int>), and ``decoded`` (see ``decode``) if asked for.

    ``ids`` is what the tokenizers library gives for the whole text with
    add_special_tokens=False; a null or empty text has none. ``rid`` numbers
    the rows; repeated rows and null doc_ids are kept, other columns ignored.
    """
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    odd = text.rlike(r"\p{Cn}")
    for special in _specials(path):
        odd = odd | text.contains(special)
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(~odd, F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))).alias("words"),
        F.when(odd, text).alias("odd"),
    )
    # A chunk is numbered by its task and its order there, so both readings of
    # the texts give the same chunks and none is stored.
    chunks = rows.mapInArrow(_packer(path, buckets), CHUNKS_DDL)
    words = chunks.filter("bucket >= 0").select("chunk", "bucket", "n", "payload")
    coded = words.groupBy("bucket").applyInArrow(_word_encoder(path), ENCODED_WORDS)
    texts = chunks.filter("bucket = -1").select("chunk", "n", "payload", "rid", "doc_id", "sizes")
    schema = "rid long, doc_id long, ids array<int>"

    def spelt(texts: pa.Table, words: pa.Table) -> pa.Table:
        found = _placed(texts, words)
        return found.append_column("decoded", _spelt(_whole(found["ids"]), path))

    # decoding in the same worker takes half the memory of two
    return texts.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(spelt if decoded else _placed, schema + ", decoded string" * decoded)


@lru_cache(maxsize=2)
def _pieces(path: str) -> pa.Array:
    """The bytes of every id. Byte-level pieces spell a byte as a printable character."""
    shown = [b for b in range(256) if chr(b).isprintable() and b > 32 and b not in (127, 160, 173) and not 127 < b < 161]
    spelt = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    tokenizer = _tokenizer(path)
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    pieces: list[bytes] = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for piece, i in tokenizer.get_vocab(with_added_tokens=True).items():
        pieces[i] = special[i].encode() if i in special else bytes(spelt[c] for c in piece)
    return pa.array(pieces, pa.binary())


def _spelt(lists: pa.ListArray, path: str) -> pa.Array:
    """The texts that lists of ids spell, by a join of ids to the table of pieces."""
    joined = _pieces(path).take(lists.flatten())
    _, offsets, data = joined.buffers()
    ends = np.frombuffer(offsets, np.int32)[joined.offset : joined.offset + len(joined) + 1]
    whole = memoryview(data) if data else memoryview(b"")
    bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return pa.array([bytes(whole[a:b]).decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text that its ``ids`` spell.

    The table of pieces is bounded by the vocabulary, and every worker reads
    it from ``path``. Bytes that are not UTF-8 become U+FFFD, as in the
    library. No ids give an empty text.
    """

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _spelt(batch.column("ids"), path)], names=[*batch.schema.names, "decoded"])

    schema = encoded.select("*", F.lit("").alias("decoded")).schema
    return encoded.mapInArrow(look_up, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_and_decode(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_path()
    scratch = Scratch(spark, "bpe")
    done = encode(spark, docs, path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
    with arrow_rows(spark, BATCH_ROWS):
        return scratch.keep(done, "digests")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encode_and_decode`` of ``documents``: every row; null and empty texts have no token."""
    return encode_and_decode(spark, table(spark, sf_dir, "documents"))
