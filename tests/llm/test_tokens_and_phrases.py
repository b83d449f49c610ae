"""Operators 11 to 13 against the libraries and brute force: nulls, empty and long texts, repeated rows, clashing columns, empty tables, other types of doc_id."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import _words, alignment, binary_output, collocations
from strandgraph.llm.bpe import _pieces, default_path

A_PATH, B_PATH = alignment.default_paths()
BITS = ["a", "the ", "don't", "'s", "\n", "\n\n", " ", "  ", "\t", "\r\n", "é", "　", "\xa0", " ", "\x00", "\x1c", "<|endoftext|>", "<|endoftext", ".", "...", "0123", "日本", "ﬁ", "🙂", "▁", "<s>", "<0x0A>", "_", "\x7f"]
CLASH = ("rid", "at", "side", "ids", "chunk", "bucket", "n", "payload", "record", "phrase", "word", "gid", "before", "shard")


def odd_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


ROWS = [*((k, t) for k, t in enumerate(odd_texts(120, 1))), (7, None), (None, "abc def"), (7, ""), (8, "aé" * 4000), (9, "one two three " * 3000), (5, "same"), (5, "same"), (-1, "x" * 5000)]


def frame(spark, rows=ROWS, kind="long"):
    made = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("lang", F.lit("en"))
    return made.withColumns({c: F.lit(3) for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="module")
def a_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A_PATH)


@pytest.fixture(scope="module")
def plain_library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(A_PATH)
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def b_library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=B_PATH)


def test_pieces_encode_as_whole_texts(a_library, plain_library, b_library):
    texts = [*odd_texts(4000, 2), None, "", " ", "\n"]
    column = pa.chunked_array([pa.array(texts)])
    kinds = ((_words.byte_level(A_PATH, True), a_library, "", ["<|endoftext|>"]), (_words.byte_level(A_PATH, False), plain_library, " ", []))
    for encoder, library, prefix, specials in kinds:
        (ids, bounds, good), = _words.encoded(column, [encoder], specials, prefix)
        for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == library.encode(prefix + t if t else "", add_special_tokens=False).ids
        assert good.all()
    (ids, bounds, good), = _words.encoded(column, [_words.sentence_pieces(B_PATH)], [], " ")
    for t, a, b, g in zip(texts, bounds[:-1], bounds[1:], good, strict=True):
        assert bool(g) == ("▁" not in (t or "")) and (not g or ids[a:b].tolist() == (b_library.encode(t) if t else []))


def test_portions_keep_all_rows():
    batches = [pa.RecordBatch.from_pydict({"text": ["x" * n for n in sizes]}) for sizes in ([3, 90, 0, 2], [50, 1], [0], [200, 4])]
    got = [t["text"].to_pylist() for t in _words.portions(iter(batches), "text", 60)]
    assert [x for part in got for x in part] == [x for b in batches for x in b.column("text").to_pylist()] and all(sum(map(len, p)) <= 60 or len(p) == 1 for p in got)


def written(library, rows):
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return want, start


def test_binary_output(spark, a_library, tmp_path):
    docs, folder = frame(spark), f"file://{tmp_path}/out"
    got = sorted(binary_output.write(spark, docs, folder, shards=5).collect(), key=lambda r: r.start)
    want, total = written(a_library, ROWS)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want) and [r.doc_id for r in got] == [w[0] for w in want]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()] and got[-1].start + got[-1].n_tokens == total
    assert len({r.shard for r in got}) > 1 and [r.shard for r in got] == sorted(r.shard for r in got)
    ids = {r.doc_id: r.ids for r in binary_output.read(spark, folder, with_ids=True).collect()}
    assert ids[9] == a_library.encode(ROWS[124][1] if ROWS[124][0] == 9 else "one two three " * 3000, add_special_tokens=False).ids + [0]
    one = binary_output.document(spark, folder, F.col("doc_id") == 9)
    assert {i for i, _ in one} == {9} and any(x.tolist() == ids[9] for _, x in one)
    # each file by hand: header, frames with their checksums, index
    import struct

    import zstandard

    dictionary = b"".join((tmp_path / "out/dictionary" / f).read_bytes() for f in os.listdir(tmp_path / "out/dictionary") if f.endswith(".txt"))[:-1]
    shared = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    count = 0
    for name in os.listdir(tmp_path / "out/shards"):
        data = (tmp_path / "out/shards" / name).read_bytes()
        if name.endswith(".txt") and data:
            magic, _, width, _, digest = struct.unpack_from(binary_output.HEADER, data)
            assert magic == binary_output.MAGIC and digest == hashlib.sha256(dictionary).digest() and width == 2
            at = struct.unpack_from(binary_output.TRAILER, data, len(data) - 17)[0]
            index = pa.ipc.open_stream(data[at:-17]).read_all().to_pylist()
            assert all(len(shared.decompress(data[r["offset"] : r["offset"] + r["length"]])) == 2 * r["n_tokens"] for r in index)
            count += len(index)
    assert count == len(ROWS)


def test_binary_output_of_other_tables(spark, a_library, tmp_path):
    empty = binary_output.write(spark, frame(spark, [], "long").unpersist(), f"file://{tmp_path}/a")
    assert empty.count() == 0
    many = [("k", "again and again")] * 300 + [("j", "x"), (None, None)]
    got = binary_output.write(spark, frame(spark, many, "string"), f"file://{tmp_path}/b", shards=4).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, "j"] + ["k"] * 300 and len({r.shard for r in got}) > 1
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def swept(rows, a_library, b_library):
    """Alignment by two pointers, a token after the other."""
    spelt = _pieces(A_PATH).to_pylist()
    piece = lambda i: bytes([int(b_library.id_to_piece(i)[3:5], 16)]) if b_library.is_byte(i) else b_library.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for i, t in rows:
        a, b = (a_library.encode(" " + t, add_special_tokens=False).ids, b_library.encode(t)) if t else ([], [])
        if b"".join(spelt[x] for x in a) != (" " + t).encode() if t else True:
            a = b = []
        if t and b"".join(map(piece, b)) != (" " + t).encode():
            a = b = []
        ends = np.cumsum([len(spelt[x]) for x in a]).tolist(), np.cumsum([len(piece(x)) for x in b]).tolist()
        links, groups, x, y, p, q = [], [], 0, 0, 0, 0
        while x < len(a) and y < len(b):
            links.append((a[x], b[y]))
            u, v = ends[0][x], ends[1][y]
            x, y = x + (u <= v), y + (v <= u)
            if u == v:
                groups.append((a[p:x], b[q:y]))
                p, q = x, y
        counts.update(links)
        found.append((i, a, b, groups, links))
    top = defaultdict(int)
    for (_, y), c in counts.items():
        top[y] = max(top[y], c)
    text = lambda groups: ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
    return Counter((i, len(a), len(b), len(g), len(n), sum(counts[x] == top[x[1]] for x in n), sum(counts[x] for x in n), hashlib.sha256(text(g).encode()).hexdigest() if a else "") for i, a, b, g, n in found)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, plain_library, b_library, small):
    limits = {"window": 64, "chunk_links": 500, "bucket_pairs": 40} if small else {}
    got = alignment.align(spark, frame(spark), **limits).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == swept(ROWS, plain_library, b_library)


def test_alignment_of_other_tables(spark, plain_library, b_library):
    assert alignment.align(spark, frame(spark, [], "long")).count() == 0
    rows = [("k", "some text"), (None, "some text"), ("k", None), ("j", "▁")]
    got = Counter(tuple(r[c] for c in COLUMNS) for r in alignment.align(spark, frame(spark, rows, "string")).collect())
    assert got == swept(rows, plain_library, b_library) and all(n == 1 for n in got.values())


def mined(rows, least, longest, top, covered):
    """Phrases by counting all of them."""
    counts = Counter()
    for t, lang in rows:
        lower = (t or "").translate({65 + i: 97 + i for i in range(26)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            counts.update((lang or "und", w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    total = Counter()
    for (lang, w), c in counts.items():
        total[lang] += c if len(w) == 1 else 0
    frequent = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in frequent.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    found = []
    for (lang, w), a in frequent.items():
        if 100 * inside[lang, w] >= covered * a:
            continue
        score, k = min((1000000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
        found.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], total[lang], score))
    ranked = []
    for lang in sorted({f[0] for f in found}):
        own = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))[:top]
        ranked += [(lang, n + 1, *f[1:]) for n, f in enumerate(own)]
    return ranked


def phrases(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["The", "of", "É", "\x01x", "a\xa0b", "cat", "DOG", "�", "🙂", "z_9"]
    texts = []
    for _ in range(n):
        words = [rnd.choice(vocabulary[: rnd.choice([3, 10])]) for _ in range(rnd.randint(0, 30))]
        texts.append("".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b"]) for w in words))
    return texts


PHRASES = [*((t, ("en", "de", None)[i % 3]) for i, t in enumerate(phrases(150, 3))), (None, "en"), ("", None), ("of the " * 2000, "en"), ("same same", "fr"), *[("New York City", "fr")] * 12]


@pytest.mark.parametrize(("longest", "top"), [(3, 2000), (3, 7), (5, 2000), (2, 2000)])
def test_collocations(spark, longest, top):
    rows = spark.createDataFrame(PHRASES, "text string, lang string").withColumns({c: F.lit(3) for c in CLASH}).repartition(4)
    got = collocations.collocations(spark, rows, 10, longest, top, 50).orderBy("lang", "rank").collect()
    assert [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got] == mined(PHRASES, 10, longest, top, 50)
    assert got and got[0].phrase


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark, spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark, spark.createDataFrame([(None, None), ("a b. c", "en")], "text string, lang string")).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(spark, spark.createDataFrame([], "text string, lang string"), longest=1)


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    row = spark.createDataFrame([(big, big, 2 * big)], "a long, l long, r long")
    assert row.select(collocations.score()).first()[0] == 1000000 * big * big // (big * 2 * big)


def test_growth_prunes_and_sums():
    columns = [np.array(x) for x in ([1, 1, 1, 2, 2], [5, 5, 6, 5, 5], [7, -1, 7, 8, 8])]
    got = {tuple(int(c[i]) for c in cols): int(n[i]) for cols, n in collocations.grow(columns, np.array([4, 3, 2, 5, 1]), 5) for i in range(len(n))}
    assert got == {(1,): 9, (2,): 6, (1, 5): 7, (2, 5): 6, (2, 5, 8): 6}


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    from strandgraph.llm import toxicity

    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity.op5_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert len(rows) == 990 and hit / sum(r.predicted for r in rows) > 0.9 and hit / sum(r.toxic for r in rows) > 0.8


def test_toxicity_of_other_ids_and_no_rows(spark):
    from strandgraph.llm import toxicity

    docs = spark.createDataFrame([("k", "one two."), (None, None), ("j", "")], "doc_id string, text string").withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([("k", 1), ("j", 0)], "doc_id string, toxic int")
    got = toxicity.toxicity(spark, docs, labels).collect()
    assert {r.doc_id for r in got} == {"k", None, "j"} and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(spark, docs.limit(0), labels).count() == 0
