"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is the sum of the scores
of its words, a word's score the average weight of its hashed subwords. The
noisy-or of the sentences is the document's probability. The weights are
learnt from document labels alone; the sentences' own probabilities then show
which of them offend. Only subwords that toxic documents hold clearly more
often than others have a weight, and a sentence without one says nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._grams import grams, held_out, sample, text_bytes
from ._io import table
from ._scratch import Scratch
from .bpe import arrow_rows

BUCKETS = 1 << 18
SIZES = (4, 5, 6, 7)
#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE_ROWS = 3000
THRESHOLD = 0.3
#: Standard deviations by which toxic documents must hold a bucket more often than all, how many times as often
#: documents with it must be toxic as all are, and documents that must hold it.
MARK, LIFT, SUPPORT = 5.0, 3.0, 5
#: Ends of sentences.
STOPS = r".!?\n"


def tokens(text: Column) -> Column:
    """Words in lower case, and the ends of sentences between them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"\p{{L}}++|[{STOPS}]++"), F.lit(0))


def _words(dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct tokens: whether they end a sentence; buckets of their subwords, and to which token each belongs."""
    data, offsets = text_bytes(dictionary)
    n = len(dictionary)
    stop = np.isin(data[offsets[:-1]], np.frombuffer(b".!?\n", np.uint8)) if n else np.zeros(0, bool)
    framed = np.full(len(data) + n + 1, 32, np.uint8)
    lengths = np.diff(offsets)
    framed[np.arange(len(data)) + 1 + np.repeat(np.arange(n), lengths)] = data
    bounds = offsets + np.arange(n + 1)
    owners, buckets = [], []
    for starts, found in grams(framed, SIZES, BUCKETS):
        owners.append(np.searchsorted(bounds, starts, side="right") - 1)
        buckets.append(found)
    return stop, np.concatenate(buckets), np.minimum(np.concatenate(owners), max(0, n - 1))


@dataclass
class Bags:
    """Tokens of documents in one row, with the sentence and document of each."""

    stop: np.ndarray
    buckets: np.ndarray
    owner: np.ndarray
    per_word: np.ndarray
    codes: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    ordinal: np.ndarray


def bags(lists: pa.ListArray) -> Bags:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    stop, buckets, owner = _words(coded.dictionary)
    codes = coded.indices.to_numpy().astype(np.int64)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    document = np.repeat(np.arange(len(lists)), np.diff(offsets))
    ends = stop[codes] if len(codes) else np.zeros(0, bool)
    opens = np.zeros(len(codes), np.int64)
    if len(codes):
        opens[1:] = ends[:-1] | (document[1:] != document[:-1])
    word = ~ends
    place = np.cumsum(opens)[word]
    _, sentence = np.unique(place, return_inverse=True)
    document, codes = document[word], codes[word]
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(sentence) else np.zeros(0, np.int64)
    of = document[first]
    ordinal = np.arange(len(of)) - np.searchsorted(of, of, side="left") if len(of) else np.zeros(0, np.int64)
    return Bags(stop, buckets, owner, np.maximum(np.bincount(owner, minlength=len(stop)), 1), codes, sentence, of, ordinal)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logits(self, b: Bags) -> np.ndarray:
        """The logit of every sentence; minus infinity for one without a bucket that has a weight."""
        weights = self.weights[b.buckets]
        word = np.bincount(b.owner, weights=weights, minlength=len(b.stop)) / b.per_word
        says = np.zeros(len(b.stop), bool)
        says[b.owner[weights != 0]] = True
        heard = np.bincount(b.sentence, weights=says[b.codes], minlength=len(b.document)) > 0
        return np.where(heard, self.bias + np.bincount(b.sentence, weights=word[b.codes], minlength=len(b.document)), -np.inf)

    def scores(self, lists: pa.ListArray) -> tuple[np.ndarray, Bags, np.ndarray]:
        """The noisy-or of each document, its sentences, and their probabilities."""
        b = bags(lists)
        z = self.logits(b)
        risk = np.bincount(b.document, weights=np.logaddexp(0, z), minlength=len(lists))
        return -np.expm1(-risk), b, 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _features(b: Bags, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the tokens ``rows``, and to which of them each belongs."""
    order = np.argsort(b.owner, kind="stable")
    first = np.searchsorted(b.owner[order], np.arange(len(b.stop) + 1))
    counts = np.diff(first)[rows]
    of = np.repeat(np.arange(len(rows)), counts)
    at = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(counts)][:-1], counts) + first[rows][of]
    return b.buckets[order][at], of


def presence(lists: pa.ListArray, toxic: np.ndarray, weights: np.ndarray, chunk: int = 200) -> np.ndarray:
    """Of each bucket: the weight of toxic documents that hold it, of all such documents, the sum of their squared weights, and their number."""
    found = np.zeros((4, BUCKETS))
    for at in range(0, len(lists), chunk):
        b = bags(lists.slice(at, chunk))
        pairs = np.unique(b.codes * chunk + b.document[b.sentence])
        buckets, of = _features(b, pairs // chunk)
        pairs = np.unique(buckets.astype(np.int64) * chunk + (pairs % chunk)[of])
        bucket, document = pairs // chunk, at + pairs % chunk
        for i, value in enumerate((weights * toxic, weights, weights**2, np.ones(len(weights)))):
            found[i] += np.bincount(bucket, weights=value[document], minlength=BUCKETS)
    return found


def marking(counts: np.ndarray, toxic: float, total: float, rows: int, least: float = MARK, lift: float = LIFT, support: int = SUPPORT) -> np.ndarray:
    """The buckets that toxic documents hold more often than chance explains, by ``least`` standard deviations, and ``lift`` times as often as all.

    The others would only learn single documents by heart. ``support``
    documents have to hold a bucket, less in small samples. Weights of
    documents count in the deviation by their squares, so it depends on the
    sample and not on the table behind it.
    """
    p = toxic / total if total else 0.0
    if not 0 < p < 1:
        return np.zeros(0, np.int64)
    strength = (counts[0] - counts[1] * p) / np.sqrt(np.maximum(counts[2], 1e-9) * p * (1 - p))
    return np.flatnonzero((counts[3] >= max(2, min(support, rows // 200))) & (strength >= least) & (counts[0] >= lift * p * counts[1]))


def hits(lists: pa.ListArray, used: np.ndarray) -> pa.RecordBatch:
    """Of each document the number of its sentences, and what the marking buckets (by their place in ``used``) weigh in each sentence."""
    b = bags(lists)
    place = np.full(BUCKETS, -1, np.int64)
    place[used] = np.arange(len(used))
    has = np.zeros(len(b.stop), bool)
    has[b.owner[place[b.buckets] >= 0]] = True
    word = np.flatnonzero(has[b.codes]) if len(b.codes) else np.zeros(0, np.int64)
    buckets, of = _features(b, b.codes[word])
    keep = place[buckets] >= 0
    key, value = b.sentence[word[of[keep]]] * max(1, len(used)) + place[buckets[keep]], 1 / b.per_word[b.codes[word[of[keep]]]]
    key, group = np.unique(key, return_inverse=True)
    value = np.bincount(group, weights=value, minlength=len(key))
    sentence, feature = key // max(1, len(used)), key % max(1, len(used))
    bounds = pa.array(np.searchsorted(b.document[sentence], np.arange(len(lists) + 1)).astype(np.int32))
    columns = [b.ordinal[sentence].astype(np.int32), feature.astype(np.int32), value]
    many = np.bincount(b.document, minlength=len(lists)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(many), *(pa.ListArray.from_arrays(bounds, pa.array(c)) for c in columns)], names=["sentences", "sentence", "feature", "value"])


def solve(found: pa.Table, used: np.ndarray, toxic: np.ndarray, weights: np.ndarray, *, steps: int = 150, rate: float = 0.4, decay: float = 5e-6) -> Model:
    """Weights of the marking buckets that make the noisy-or of each document likely, by Adam with decay; ``found`` is what ``hits`` gives."""
    n, model = len(found), Model(np.zeros(BUCKETS), -4.0)
    if not n or toxic.all() or not toxic.any():
        return model
    flat = lambda c: pa.concat_arrays(found[c].chunks).flatten().to_numpy() if found[c].num_chunks else np.zeros(0)
    counts = np.concatenate([c.value_lengths().to_numpy() for c in found["feature"].chunks])
    document, feature, value = np.repeat(np.arange(n), counts), flat("feature").astype(np.int64), flat("value")
    _, row = np.unique(document.astype(np.int64) << 32 | flat("sentence").astype(np.int64), return_inverse=True)
    own = np.zeros(row.max() + 1 if len(row) else 0, np.int64)
    own[row] = document
    share = weights / weights.sum()
    w, bias = np.zeros(len(used)), model.bias
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, weights=w[feature] * value, minlength=len(own))
        risk = np.bincount(own, weights=np.logaddexp(0, z), minlength=n)
        pull = np.where(toxic, -1 / np.expm1(np.clip(risk, 1e-6, 500)), 1.0) * share
        slope = pull[own] / (1 + np.exp(-np.clip(z, -50, 50)))
        g = np.bincount(feature, weights=slope[row] * value, minlength=len(used)) + decay * w
        gb = float(slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        step = rate * (1 - (t - 1) / steps)
        w -= step * (m / fix) / (np.sqrt(v / fix2) + 5e-6)
        bias -= step * (mb / fix) / (np.sqrt(vb / fix2) + 1e-9)
    model.weights[used], model.bias = np.where(w == 0, 1e-12, w), bias
    return model


def fit(lists: pa.ListArray, toxic: np.ndarray, weights: np.ndarray) -> Model:
    """A model of documents that are at hand: ``presence``, ``marking``, ``hits`` and ``solve`` one after the other."""
    used = marking(presence(lists, toxic, weights), float((weights * toxic).sum()), float(weights.sum()), len(lists))
    return solve(pa.Table.from_batches([hits(lists, used)]), used, toxic, weights)


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, seed: int = 11) -> Model:
    """A model of up to ``limit`` toxic and ``limit`` other rows that have a label.

    Each class counts by its number of labelled rows, so that scores are
    probabilities over all of them. A doc_id with several labels is toxic if
    one of them is. The tasks count in which documents each bucket stands, and
    then what the marking ones weigh in each sentence; texts do not reach the
    driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity-sample")
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts, totals = [], []
    for mark in (1, 0):
        own = marks.filter(F.col("toxic") == mark)
        totals.append(own.count())
        parts.append(sample(own, limit, seed))
    chosen = docs.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").select("toxic", tokens(F.col("text")).alias("tokens"))
    with arrow_rows(spark, 200):
        chosen = scratch.keep(chosen, "rows")
        drawn = dict(chosen.groupBy("toxic").count().collect())
        worth = {1: totals[0] / max(1, drawn.get(1, 0)), 0: totals[1] / max(1, drawn.get(0, 0))}
        weigh = lambda toxic: np.where(toxic, worth[1], worth[0])

        names = ("toxic", "weight", "squares", "documents")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                toxic = batch.column("toxic").to_numpy() == 1
                found = presence(batch.column("tokens"), toxic, weigh(toxic))
                held = np.flatnonzero(found[3])
                yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), *(pa.array(f[held]) for f in found)], names=["bucket", *names])

        sums = chosen.mapInArrow(count, "bucket int, " + ", ".join(f"{c} double" for c in names)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        counts = np.zeros((4, BUCKETS))
        for i, c in enumerate(names):
            counts[i][sums["bucket"].to_numpy()] = sums[c].to_numpy()
        used = marking(counts, float(worth[1] * drawn.get(1, 0)), float(sum(worth[k] * drawn.get(k, 0) for k in worth)), sum(drawn.values()))

        def weigh_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = hits(batch.column("tokens"), used)
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *found.columns], names=["toxic", *found.schema.names])

        kind = chosen.schema["toxic"].dataType.simpleString()
        rows = chosen.mapInArrow(weigh_sentences, f"toxic {kind}, sentences long, sentence array<int>, feature array<int>, value array<double>").toArrow()
    # sums of doubles depend on their order, so rows are put in one that does not depend on tasks
    order = np.lexsort((pa.compute.list_value_length(rows["feature"]).to_numpy(), rows["sentences"].to_numpy(), rows["toxic"].to_numpy())) if len(rows) else np.zeros(0, np.int64)
    rows = rows.take(pa.array(order))
    toxic = rows["toxic"].to_numpy() == 1
    return solve(rows, used, toxic, weigh(toxic))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and offending (array of sentence ordinals and probabilities) of every row.

    Sentences are counted from 0, those without a word left out; the ones
    whose own probability reaches ``threshold`` offend.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, offending array<struct<sentence: int, probability: double>>"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, b, p = model.scores(batch.column("tokens"))
            hit = np.flatnonzero(p >= threshold)
            bounds = np.searchsorted(b.document[hit], np.arange(len(batch) + 1)).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(b.ordinal[hit].astype(np.int32)), pa.array(p[hit])], names=["sentence", "probability"])
            lists = pa.ListArray.from_arrays(pa.array(bounds), found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), lists], names=["doc_id", "score", "offending"])

    return docs.select("doc_id", tokens(F.col("text")).alias("tokens")).mapInArrow(judge, schema)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, offending.

    The model learns from rows that are not held out. Null and empty texts
    have no sentence and score 0. Repeated rows are judged alike; without
    labels of both classes every score is that of an untrained model. Other
    columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    model = train(docs, labels.filter(~held_out("doc_id", 4, 2)), limit)
    found = scored(docs, model, threshold)
    result = found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "offending")
    with arrow_rows(spark, 1000):
        return Scratch(spark, "toxicity").keep(result, "scores")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``toxicity`` of ``documents``, learnt from ``labels``: every row with a score; texts without a sentence score 0."""
    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
