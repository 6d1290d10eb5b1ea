"""Quality classifier: ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(cut_k - s(text)) with ordered cuts and one shared score s, the
mean over the text's words of hashed weights: of the word itself, its ending, its shape
(kinds of its first and last three bytes, and its length) and whether it repeats the word
before. Expected grade and tail probability P(grade >= TAIL) come from the same cuts.
Trained in numpy (Adam over all rows of a sample bounded by PER_CLASS for each grade);
all documents are scored over their whole texts.

Where only binary labels are at hand the query grades 0 (poor quality), 1 (good quality
but toxic) and 2 (good quality, not toxic), and keeps what has P(grade >= 1) >= 1/2.

Defined results: null and empty texts score s = 0; no labelled rows give every grade the
same probability; a grade without rows in the sample keeps its place in the order;
repeated rows, and rows without doc_id, are each scored; of several labels of one doc_id the
greatest grade counts; a probability of exactly 1/2 is kept; texts of any length are scored whole;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import arrowtext as T
from .samples import held_out, labelled_sample

PER_CLASS = 2500
BUCKETS = 1 << 16
STEPS, RATE, DECAY = 150, 0.1, 1e-5
TAIL = 1

#: Kinds of bytes: lower case, upper case, digit, full stop or comma, other ASCII, other scripts, no byte.
_KIND = np.full(257, 5, np.uint64)
_KIND[:128] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[44, 46]], _KIND[256] = 0, 1, 2, 3, 6


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of buckets for each word, and each document's first word (with the total at the end)."""
    words = T.split_words(column)
    hashes = words.hashes(lower=True)
    tail = T.Words(words.data, words.offsets, np.maximum(words.starts, words.ends - 3), words.ends, words.first).hashes()
    last = [np.where(words.ends - k >= words.starts, words.data[np.maximum(words.ends - k, 0)], 256) for k in (1, 2, 3)] if len(hashes) else []
    shape = np.minimum((words.ends - words.starts).astype(np.uint64), np.uint64(15))
    for part in ([words.data[words.starts].astype(np.int64)] if len(hashes) else []) + last:
        shape = shape * np.uint64(7) + _KIND[part]
    again = np.zeros(len(hashes), np.uint64)
    again[1:] = hashes[1:] == hashes[:-1]
    again[words.first[:-1][words.counts > 0]] = 2
    keys = [hashes, T.mix(tail + np.uint64(1)), T.mix(shape + np.uint64(1 << 32)), T.mix(again + np.uint64(1 << 33))]
    return np.stack([(k >> np.uint64(48)).astype(np.int64) for k in keys]), words.first


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray  # one less than grades, ascending

    def scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        each = self.weights[buckets].sum(axis=0)
        total = np.concatenate([[0], np.cumsum(each)])
        return (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)

    def below(self, s: np.ndarray) -> np.ndarray:
        """P(grade <= k) for every k but the last: a row for each score."""
        return 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - s[:, None], -40, 40)))


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, bucket, share of the document's words: one entry for each document and bucket, put together a slice at a time."""
    parts, at = [], 0
    for batch in T.slices([pa.record_batch([column], ["text"])]):
        buckets, first = features(batch.column("text"))
        n = np.diff(first)
        doc = np.tile(np.repeat(np.arange(len(n)), n), len(buckets))
        key, count = np.unique(doc * BUCKETS + buckets.ravel(), return_counts=True)
        parts.append(((key // BUCKETS + at).astype(np.int32), (key % BUCKETS).astype(np.int32), (count / np.maximum(n, 1)[key // BUCKETS]).astype(np.float32)))
        at += len(n)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def train(column: pa.Array, grade: np.ndarray, weight: np.ndarray, grades: int) -> Model:
    weights = np.zeros(BUCKETS)
    share = np.array([(weight * (grade <= k)).sum() for k in range(grades - 1)]) / max(weight.sum(), 1e-9)
    if not len(grade):
        share = np.arange(1, grades) / grades
    share = np.clip(share, 0.01, 0.99)
    start = np.log(share / (1 - share))
    gap = np.log(np.maximum(np.diff(start), 1e-2))  # cuts: the first, then steps that stay positive
    theta = np.concatenate([start[:1], gap])
    cuts = lambda t: np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])
    model = Model(weights, cuts(theta))
    if len(set(grade.tolist())) < 2:
        return model
    doc, col, value = _entries(column)
    n = len(grade)
    w = weight / weight.sum()
    m1, m2, t1, t2 = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, STEPS + 1):
        s = np.bincount(doc, value * weights[col], n)
        edge = np.concatenate([[-np.inf], cuts(theta), [np.inf]])
        upper, lower = 1 / (1 + np.exp(-(edge[grade + 1] - s))), 1 / (1 + np.exp(-(edge[grade] - s)))
        # log(upper - lower): its slopes by the score and by the two cuts around the grade.
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gs = w * (du - dl)
        gw = np.bincount(col, value * gs[doc], BUCKETS) + DECAY * weights
        gc = np.bincount(grade, -w * du, grades)[: grades - 1]
        gc += np.bincount(np.maximum(grade - 1, 0), np.where(grade > 0, w * dl, 0), grades)[: grades - 1]
        gt = np.concatenate([[gc.sum()], [np.exp(theta[k]) * gc[k:].sum() for k in range(1, grades - 1)]])
        for a, g, one, two in ((weights, gw, m1, m2), (theta, gt, t1, t2)):
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            a -= RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-10)
    return Model(weights, cuts(theta))


def fit(documents: DataFrame, labels: DataFrame, grade: Column, grades: int, per_class: int = PER_CLASS) -> Model:
    """labels: doc_id and what the column grade needs (0 to grades - 1)."""
    texts, y, weight = labelled_sample(documents, labels, grade, per_class, grades)
    return train(texts.field("text") if len(texts) else pa.array([], pa.string()), y, weight, grades)


def score(documents: DataFrame, model: Model, tail: int = TAIL) -> DataFrame:
    """doc_id, score, expected_grade, tail_probability (P(grade >= tail))."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in T.slices(batches):
            s = m.scores(*features(batch.column("text")))
            below = m.below(s)
            columns = [batch.column("doc_id"), pa.array(s), pa.array((1 - below).sum(axis=1)), pa.array(1 - below[:, tail - 1])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "expected_grade", "tail_probability"])

    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_arrow(texts, run, "doc_id long, score double, expected_grade double, tail_probability double")


def grade_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, expected_grade, tail_probability, kept."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    out = score(documents, fit(documents, labels.filter("quality is not null and toxic is not null"), grade, 3))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("kept"))
