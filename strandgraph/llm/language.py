"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed subwords; a linear layer
and a softmax give the languages. Both are trained by stochastic gradient
descent in numpy on a bounded sample. Since the layer is linear, a trained
model is one table of logits by bucket, which scores a text in one pass.
A text is rejected for a low score, or for subwords that are rarer in the
sample than those of its texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._grams import grams, held_out, sample, text_bytes
from ._io import table
from ._scratch import Scratch
from .bpe import arrow_rows

UNKNOWN = "und"
BUCKETS = 1 << 15
SIZES = (2, 3, 4)
DIMENSION = 16
#: Labelled rows that the model is fitted on, at most; a fifth of them calibrate it.
SAMPLE_ROWS = 3000
#: Bytes that are turned into subwords at once.
PIECE_BYTES = 1 << 18
#: Share of the rightly judged calibration texts that lie below each level of rejection.
TAIL = 0.005


def letters(text: Column) -> Column:
    """The words of a text in lower case, between single spaces; two spaces if it has no letters."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def _counts(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each text and how often it has them."""
    found = []
    for i in range(len(texts)):
        data, _ = text_bytes(texts.slice(i, 1))
        found.append(np.unique(np.concatenate([b for _, b in grams(data, SIZES, BUCKETS)]), return_counts=True))
    return found


@dataclass
class Model:
    """Logits of every bucket, and the calibration of the scores they give."""

    labels: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    #: Logarithm of the share of every bucket in the sample, and the least mean of a text.
    familiar: np.ndarray
    least_familiar: float

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The best label of each text (-1: no letters) and its calibrated probability."""
        return self.judged(texts)[:2]

    def judged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``scores``, and whether each text is rejected."""
        data, offsets = text_bytes(texts)
        labels, total, n = len(self.labels), np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        familiar = np.zeros(len(texts))
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1)
            for a in range(offsets[first], offsets[last], PIECE_BYTES * 4):
                b = min(offsets[last], a + PIECE_BYTES * 4)
                for size, (starts, buckets) in zip(SIZES, grams(data[a : min(offsets[last], b + max(SIZES) - 1)], SIZES, BUCKETS), strict=True):
                    at = starts + a
                    owner = np.searchsorted(offsets, at, side="right") - 1
                    inside = (at < b) & (at + size <= offsets[owner + 1])
                    owner, buckets = owner[inside], buckets[inside]
                    for k in range(labels):
                        total[:, k] += np.bincount(owner, weights=self.logits[buckets, k], minlength=len(texts))
                    familiar += np.bincount(owner, weights=self.familiar[buckets], minlength=len(texts))
                    n += np.bincount(owner, minlength=len(texts))
            first = last
        z = (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        empty = np.diff(offsets) <= 2
        score = p[np.arange(len(p)), best]
        rejected = empty | (score < self.least) | (familiar / np.maximum(n, 1) < self.least_familiar)
        return np.where(empty, -1, best), np.where(empty, 0.0, score), rejected


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], *, epochs: int = 12, rate: float = 4.0, batch: int = 64, precision: float = 0.995, seed: int = 7) -> Model:
    """A model of bags (buckets, counts) with their labels.

    Every fifth bag is set aside: its texts choose the temperature, by
    likelihood, and ``least``: the smallest score at which the accepted ones
    are right in a share of ``precision``, or the score that all but TAIL of
    the right ones reach, if that is higher. If no score reaches the
    precision, all texts are rejected. The same tail of the right ones gives
    the least familiarity, which a language without labels or letter junk
    lacks however sure the softmax is.
    """
    names = sorted(set(labels))
    if not names:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, np.inf, np.zeros(BUCKETS), 0.0)
    y = np.array([names.index(x) for x in labels])
    aside = np.arange(len(y)) % 5 == 4
    learn = np.flatnonzero(~aside) if len(y) >= 25 else np.arange(len(y))
    rng = np.random.default_rng(seed)
    table_ = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    weight, bias = rng.normal(0, 0.1, (DIMENSION, len(names))), np.zeros(len(names))
    share = [c / c.sum() if len(c) else c.astype(float) for _, c in bags]

    def averaged(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(rows)), [len(bags[i][0]) for i in rows])
        buckets = np.concatenate([bags[i][0] for i in rows]).astype(np.int64)
        parts = np.concatenate([share[i] for i in rows])
        vectors = table_[buckets] * parts[:, None]
        mean = np.stack([np.bincount(owner, weights=vectors[:, d], minlength=len(rows)) for d in range(DIMENSION)], axis=1)
        return owner, buckets, parts, mean

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(learn)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            owner, buckets, parts, mean = averaged(rows)
            slope = _softmax(mean @ weight + bias)
            slope[np.arange(len(rows)), y[rows]] -= 1
            back = slope @ weight.T
            weight -= step / len(rows) * mean.T @ slope
            bias -= 0.05 * step / len(rows) * slope.sum(axis=0)
            touched, place = np.unique(buckets, return_inverse=True)
            for d in range(DIMENSION):
                table_[touched, d] -= step * np.bincount(place, weights=back[owner, d] * parts, minlength=len(touched))
    judged = np.flatnonzero(aside) if len(y) >= 25 else learn
    # a few texts at a time: vectors of all their subwords are far more than the texts
    z = np.concatenate([averaged(judged[at : at + batch])[3] for at in range(0, len(judged), batch)]) @ weight + bias
    heat = min(np.geomspace(0.05, 10, 60), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(judged)), y[judged]] + 1e-12).sum())
    p = _softmax(z / heat)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[judged]
    order = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision)
    least, least_familiar = np.inf, 0.0
    seen = np.zeros(BUCKETS)
    for i in learn:
        np.add.at(seen, bags[i][0], bags[i][1])
    familiar = np.log((seen + 0.5) / (seen.sum() + 0.5 * BUCKETS))
    if len(good):
        # rounding of sums taken in another order must reject no text of the calibration itself
        least = max(float(best[order][good[-1]]), float(np.quantile(best[right], TAIL, method="lower"))) - 1e-9
        means = np.array([familiar[bags[i][0]] @ share[i] for i in judged[right]])
        least_familiar = float(np.quantile(means, TAIL, method="lower")) - 1e-9
    return Model(names, table_ @ weight, bias, float(heat), least, familiar, least_familiar)


def train(docs: DataFrame, limit: int = SAMPLE_ROWS, seed: int = 7) -> Model:
    """A model of the ``text`` and non-null ``lang`` of up to ``limit`` rows of ``docs``."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    chosen = sample(labelled, limit, seed).select("lang", letters(F.col("text")).alias("text"))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _counts(batch.column("text"))
            lists = [pa.array([x[i].astype(np.int32) for x in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *lists], names=["lang", "buckets", "counts"])

    rows = chosen.mapInArrow(bag, "lang string, buckets array<int>, counts array<int>").toArrow()
    bags = [(b.values.to_numpy(), c.values.to_numpy()) for b, c in zip(rows["buckets"], rows["counts"], strict=True)]
    return fit(bags, rows["lang"].to_pylist(), seed=seed)


def predict(text: Column, model: Model) -> Column:
    """A struct of lang_pred, score and rejected for every whole text.

    A null text and one without letters give ``und`` with score 0. ``score``
    is the calibrated probability of lang_pred; ``rejected`` says that it is
    below the model's least score, that the text is less familiar than texts
    of the sample are, or that it is ``und``.
    """

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def judge(texts: pa.Array) -> pa.Array:
        best, score, rejected = model.judged(texts)
        names = np.array([*model.labels, UNKNOWN], dtype=object)
        return pa.StructArray.from_arrays(
            [pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=["lang_pred", "score", "rejected"]
        )

    return judge(letters(text))


def identify(spark: SparkSession, docs: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    The model learns from rows that are not held out. Repeated rows are judged
    alike; without a labelled row every text is ``und``; an empty input gives
    an empty result. Other columns are ignored.
    """
    out = held_out("doc_id", 5, 0)
    model = train(docs.filter(~out), limit)
    found = docs.select("doc_id", out.alias("held_out"), predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")
    with arrow_rows(spark, 1000):
        return Scratch(spark, "language").keep(found, "predictions")


def accepted(docs: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns."""
    model = train(docs.filter(~held_out("doc_id", 5, 0)), limit)
    rows = docs.select(F.struct("*").alias("row"), predict(F.col("text"), model)["rejected"].alias("rejected"))
    return rows.filter(~F.col("rejected")).select("row.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``identify`` of ``documents``: every row; texts without a letter are ``und``."""
    return identify(spark, table(spark, sf_dir, "documents"))
