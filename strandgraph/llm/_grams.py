"""Hashed byte n-grams of many strings at once, and bounded labelled samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null doc_id counts as empty text."""
    text = F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None)).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % modulus == remainder


def sample(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """Up to ``limit`` rows, those with the smallest hash of doc_id.

    All rows are considered. A first threshold on the hash, set from the
    count, keeps what each task passes on in proportion to the limit.
    """
    total = rows.count()
    turn = F.xxhash64(F.lit(seed), F.col("doc_id"))
    if total > 2 * limit:
        rows = rows.filter(turn < int(-(2**63) + 2**64 * (1.5 * limit / total)))
    return rows.orderBy(turn, "doc_id").limit(limit)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, one after the other, and the offsets of each."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return held, ends - ends[0]


def grams(data: np.ndarray, sizes: tuple[int, ...], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the starts of n-grams that hold no inner space, and their buckets.

    A space may be the first or the last byte: it marks the edge of a word.
    """
    space = data == 32
    spaces = np.r_[0, np.cumsum(space)]
    wide = data.astype(np.uint64)
    found = []
    for n in sizes:
        m = len(data) - n + 1
        if m <= 0:
            found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        mixed = np.zeros(m, np.uint64)
        for i in range(n):
            mixed = mixed * np.uint64(0x100000001B3) + wide[i : i + m] + np.uint64(1)
        starts = np.flatnonzero(spaces[n - 1 : n - 1 + m] - spaces[1 : 1 + m] == 0)
        mixed = mixed[starts] * np.uint64(0x9E3779B97F4A7C15)
        found.append((starts, ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)))
    return found
