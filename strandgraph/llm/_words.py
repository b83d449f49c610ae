"""Pieces of texts that no token spans, and encoders that take each distinct piece once."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._grams import text_bytes

#: Pieces that an encoder remembers from one batch to the next.
CACHE_PIECES = 1_000_000
#: Pieces that go to the library as one string.
JOINED = 64
#: Bytes of text that are cut and encoded at once.
BATCH_BYTES = 6_000_000


def _ascii(low: int, high: int) -> np.ndarray:
    found = np.zeros(256, bool)
    found[low : high + 1] = True
    return found


VISIBLE = _ascii(0x21, 0x7E)
ALNUM = _ascii(0x30, 0x39) | _ascii(0x41, 0x5A) | _ascii(0x61, 0x7A)
PUNCT = VISIBLE & ~ALNUM


def starts(data: np.ndarray, ends: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Where pieces start: at every text, and where no token of either kind of vocabulary goes on.

    ``ends`` bounds the texts within ``data``. A piece starts at a space or a
    line feed after a character that is no white space, at a visible ASCII
    character after a line feed that stands alone, and at ASCII punctuation
    after an ASCII letter or digit; the last not in texts marked in ``whole``.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    before, here = data[:-1], data[1:]
    second, third = np.r_[np.uint8(0), data[:-2]][: len(before)], np.r_[np.zeros(2, np.uint8), data[:-3]][: len(before)]
    # the last byte of a white space beyond ASCII, or of some other character that looks like one
    gap = (second == 0xC2) & ((before == 0x85) | (before == 0xA0)) | (third >= 0xE1) & (third <= 0xE3) & ((second == 0x9A) | (second == 0x80) | (second == 0x81))
    solid = VISIBLE[before] | (before >= 0x80) & ~gap
    cut = solid & ((here == 0x20) | (here == 0x0A))
    cut[1:] |= solid[:-1] & (before[1:] == 0x0A) & VISIBLE[here[1:]]
    mark = ALNUM[before] & PUNCT[here]
    if whole is not None and whole.any():
        mark &= ~np.repeat(whole, np.diff(ends))[1:]
    cut |= mark
    first = np.zeros(len(data), bool)
    first[1:] = cut
    first[ends[:-1][np.diff(ends) > 0]] = True
    return np.flatnonzero(first)


class Encoder:
    """Ids of pieces, from ``encode`` (strings to lists of ids) of a library, and from memory.

    ``spelling`` has the bytes of every id. ``lead`` is put before a piece
    that cannot follow another, and ``drop`` ids are those of ``lead``.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], spelling: pa.Array, lead: str, drop: int, bare: int) -> None:
        self.encode, self.spelling, self.lead, self.drop, self.bare = encode, spelling, lead, drop, bare
        self.sizes = pc.binary_length(spelling).to_numpy(zero_copy_only=False).astype(np.int64)
        self.known = pa.array([], pa.large_binary())
        self.lists = pa.array([], pa.large_list(pa.int32()))
        self.good = np.zeros(0, bool)

    def _read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the strings in a row, and how many each has."""
        lists = self.encode(texts)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())), counts

    def _new(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """A list of ids for every piece, and whether they spell it."""
        data, ends = text_bytes_of(pieces)
        # pieces that start with a space and end in a visible character stay apart when they stand in a row
        row = (data[ends[:-1]] == 0x20) & VISIBLE[data[ends[1:] - 1]]
        order, counts, flat = [], [], []
        joined = np.flatnonzero(row)
        if len(joined):
            data, ends = text_bytes_of(pieces.take(pa.array(joined)))
            edges = np.r_[np.arange(0, len(joined), JOINED), len(joined)]
            ids, each = self._read([data[ends[i] + self.bare : ends[j]].tobytes().decode("utf-8", "replace") for i, j in zip(edges[:-1], edges[1:], strict=True)])
            reached = np.r_[0, np.cumsum(self.sizes[ids])]
            whole = reached[np.r_[0, np.cumsum(each)]] == ends[edges]
            if whole.all():
                bounds = np.searchsorted(reached, ends)
                if np.array_equal(reached[bounds], ends):
                    order, counts, flat = [joined], [np.diff(bounds)], [ids]
            if not order:
                row[:] = False
        alone = np.flatnonzero(~row)
        if len(alone):
            ids, each = self._read([self.lead + p.decode("utf-8", "replace") for p in pieces.take(pa.array(alone)).to_pylist()])
            keep = np.ones(len(ids), bool)
            for i in range(self.drop):
                keep[np.r_[0, np.cumsum(each)][:-1] + i] = False
            order, counts, flat = [*order, alone], [*counts, each - self.drop], [*flat, ids[keep]]
        order, sizes = np.concatenate(order), np.concatenate(counts)
        lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)]), pa.array(np.concatenate(flat)))
        lists = lists.take(pa.array(np.argsort(order)))
        spelt, edges = text_bytes_of(self.spelling.take(lists.flatten()))
        edges = edges[np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]]
        data, ends = text_bytes_of(pieces)
        if np.array_equal(edges, ends) and np.array_equal(spelt, data):
            return lists, np.ones(len(pieces), bool)
        good = [spelt[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(edges[:-1], edges[1:], ends[:-1], ends[1:], strict=True)]
        return lists, np.array(good, bool)

    def ids(self, distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """A list of ids for every distinct piece, and whether they spell it."""
        place = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            pieces = distinct.take(pa.array(fresh))
            lists, good = self._new(pieces)
            place[fresh] = len(self.known) + np.arange(len(fresh))
            self.known, self.lists = pa.concat_arrays([self.known, pieces]), pa.concat_arrays([self.lists, lists])
            self.good = np.r_[self.good, good]
        taken, right = self.lists.take(pa.array(place)), self.good[place]
        if len(self.known) > CACHE_PIECES:
            self.known, self.lists, self.good = distinct, taken, right
        return taken, right


def text_bytes_of(spelt: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values, one after the other, and the offsets of each."""
    return text_bytes(spelt.cast(pa.large_binary()).view(pa.large_string()))


@lru_cache(maxsize=4)
def byte_level(path: str, specials: bool) -> Encoder:
    """Of a byte-level vocabulary of the tokenizers library; ``specials`` says whether special tokens in texts count."""
    from .bpe import _pieces, _tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if specials:
        tokenizer = _tokenizer(path)
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
    encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return Encoder(encode, _pieces(path), "", 0, 0)


@lru_cache(maxsize=2)
def sentence_pieces(path: str) -> Encoder:
    """Of a BPE model of the sentencepiece library that adds a space before a text.

    Spaces are part of the piece that follows them, so no piece may hold one
    after another character, or a line feed, or punctuation after a letter.
    """
    import re

    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search("[^▁]▁|\n|[0-9A-Za-z][!-/:-@[-`{-~]", n) for i, n in enumerate(names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))):
        raise ValueError("a piece of this model goes over places where texts are cut")
    spelt = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    encode = lambda texts: model.encode(texts, num_threads=1)
    # the model adds a space; before a line feed it stands alone
    return Encoder(encode, pa.array(spelt, pa.binary()), "\n", 2, 1)


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """The rows of all batches in tables of about ``most`` bytes of ``column``; a longer text makes one alone."""
    held, size = [], 0
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(lengths[at - 1]) if at else 0
            to = max(at + 1 if not held else at, int(np.searchsorted(lengths, done + most - size, side="right")))
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(lengths[to - 1]) - done
            if to < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            at = to
    if held:
        yield pa.Table.from_batches(held)


def encoded(texts: pa.ChunkedArray, encoders: list[Encoder], specials: list[str], prefix: str = "") -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each encoder the ids of all texts in a row, the bounds of each text in them, and whether they spell it.

    A text that is not null or empty gets ``prefix`` before it.
    """
    column = texts.fill_null("").cast(pa.large_string()).combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if prefix:
        column = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(pa.scalar(prefix, pa.large_string()), column, pa.scalar("", pa.large_string())))
    whole = None
    for special in specials:
        held = pc.match_substring(column, special).to_numpy(zero_copy_only=False)
        whole = held if whole is None else whole | held
    data, ends = text_bytes(column)
    first = starts(data, ends, whole)
    bounds = np.r_[first, len(data)].astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    codes = coded.indices.to_numpy()
    owner = np.searchsorted(first, ends)  # pieces before each text
    found = []
    for encoder in encoders:
        lists, good = encoder.ids(coded.dictionary)
        sizes = np.diff(lists.offsets.to_numpy())
        counts = np.r_[0, np.cumsum(sizes[codes])]
        ids = lists.take(pa.array(codes)).flatten().to_numpy()
        wrong = np.r_[0, np.cumsum(~good[codes])]
        found.append((ids, counts[owner], np.diff(wrong[owner]) == 0))
    return found
