"""Toxicity by a convolutional text classifier, trained in numpy.

Words are runs of ASCII letters, digits and bytes of other scripts, lower-cased
(A-Z). A word's embedding is three vectors side by side, each from a table of BUCKETS
rows: by the hash of the word and by those of its first PREFIXES bytes, so that
compounds with one stem are alike, and two words rarely share all three. Filters of WIDTHS words slide over the
whole text (zeros follow its end), each one's maximum over the text goes through a
rectifier, and a logistic layer gives the score. Training is mini-batch Adagrad on the
log-loss over the whole texts of all labelled rows outside the held-out fold and the calibration
rows, which are one in CALIBRATION of them by a hash of doc_id. The rows are dealt to shards by another
hash; in each pass every shard learns from all its rows, from the same model, and the shards' changes
are averaged (a parameter's among those that changed it). Then the score is recalibrated on all
calibration rows, and a threshold for each language is chosen on all of that language. Language picks a
threshold; it is no input of the score.

Defined results: null and empty texts are scored as a text without words; documents
with a null or unknown lang, or one with too few labels, use the threshold over all languages;
no labelled rows give the score 0; repeated rows, and rows without doc_id, are each scored; of
several labels of one doc_id the greatest counts, and each row of that doc_id has it; if all rows of a label
would calibrate, all rows train and nothing is calibrated; logits are multiples of 1 / GRID; equal scores are never parted by a threshold;
texts of any length are scored whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..shipping import map_arrow
from . import arrowtext as T
from .samples import held_out, labelled_rows

BUCKETS, PREFIXES, PART = 1 << 16, (4, 5), 4
TABLES = 1 + len(PREFIXES)
DIMENSIONS = TABLES * PART
WIDTHS, FILTERS = (1, 2, 3), 12
EPOCHS, BATCH = 8, 32
PAD = max(WIDTHS) - 1
CALIBRATION = 4  # one in so many labelled rows calibrates, the others train
SHARD_ROWS, SHARDS = 8192, 64  # a shard's training rows, about; where that would make more than SHARDS shards, they are larger
CHUNK_ROWS, CHUNK_BYTES = 2048, 8 << 20  # rows that a shard puts in a new order at a time
BLOCK = 1 << 16  # words that the filters run over at a time
PIECE = 1 << 16  # parameters in a row of a shard's changes
GRID = 1 << 16  # steps of a logit to 1
BITS = 1 << 25  # of the map of labelled ids
LEAST = 20  # rows of each label that a language needs among the calibration rows for a threshold of its own

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@lru_cache(1)
def one_thread() -> None:
    """Keep this process's OpenBLAS to one thread: tasks share a machine, and the products here are small."""
    with open("/proc/self/maps") as f:
        libraries = {line.split()[-1] for line in f if "openblas" in line}
    for path in libraries:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every word's row in each table, and each document's first word (with the total at the end)."""
    if sys.platform == "linux":
        one_thread()
    words = T.split_words(column, ~_WORD)
    hashes = [words.hashes(lower=True)]
    for k in PREFIXES:
        stems = T.Words(words.data, words.offsets, words.starts, np.minimum(words.ends, words.starts + k), words.first)
        hashes.append(stems.hashes(lower=True))
    return np.stack([(h >> np.uint64(48)).astype(np.int64) for h in hashes]), words.first


@dataclass
class Model:
    tables: list[np.ndarray]
    filters: list[np.ndarray]  # for each width: width * DIMENSIONS rows, FILTERS columns
    offsets: list[np.ndarray]
    output: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def pooled(self, buckets: np.ndarray, first: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The filters' maxima (rectified) for each document; with places, the word each one's window starts at; and each document's end."""
        counts = np.diff(first)
        docs = len(counts)
        out = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32)
        at = np.zeros((docs, len(WIDTHS) * FILTERS), np.int64)
        i = 0
        while i < docs:
            j = max(i + 1, int(np.searchsorted(first, first[i] + BLOCK, "right")) - 1)
            if counts[i] <= BLOCK:
                top, where = self.maxima(buckets[:, first[i] : first[j]], counts[i:j], counts[i:j], places)
                out[i:j], at[i:j] = top, where + first[i]
            else:  # a document in pieces, each with the words that its last windows reach
                for s in range(int(first[i]), int(first[j]), BLOCK):
                    end = min(s + BLOCK, int(first[j]))
                    seen = min(end + PAD, int(first[j]))
                    top, where = self.maxima(buckets[:, s:seen], np.array([seen - s]), np.array([end - s]), places)
                    more = np.flatnonzero(top[0] > out[i]) if s > first[i] else slice(None)
                    out[i, more], at[i, more] = top[0, more], where[0, more] + s
            i = j
        out[counts > 0] += np.concatenate(self.offsets)
        return np.maximum(out, 0), at, first[1:]

    def maxima(self, buckets: np.ndarray, counts: np.ndarray, own: np.ndarray, places: bool) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over the windows that start in a document's first own words; with places, the word that window starts at."""
        docs = len(counts)
        # Each document's words and then PAD zero rows, so that no window spans two documents.
        first = np.cumsum(counts) - counts
        start = first + PAD * np.arange(docs)
        rows = T.ranges(start, counts)
        n = buckets.shape[1] + PAD * docs
        x = np.zeros((n, DIMENSIONS), np.float32)
        for k, b in enumerate(buckets):
            x[rows, k * PART : (k + 1) * PART] = self.tables[k][b]
        out = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32)
        at = np.zeros((docs, len(WIDTHS) * FILTERS), np.int64)
        full = np.flatnonzero(counts > 0)
        if len(full):
            edges = np.stack([start[full], start[full] + own[full]], axis=1).ravel()
            # One product for all filters' parts, which are then added up with their shifts.
            parts = [f[j : j + DIMENSIONS] for f in self.filters for j in range(0, len(f), DIMENSIONS)]
            each = np.concatenate(parts, axis=1).T @ x.T
            k = 0
            for i, w in enumerate(WIDTHS):
                conv = each[k : k + FILTERS]
                for j in range(1, w):
                    conv[:, : n - j] += each[k + j * FILTERS : k + (j + 1) * FILTERS, j:]
                k += w * FILTERS
                mine = slice(i * FILTERS, (i + 1) * FILTERS)
                out[full, mine] = np.maximum.reduceat(conv, edges, axis=1)[:, ::2].T
                if places:
                    at[full, mine] = np.stack([conv[:, s : s + c].argmax(axis=1) + f for s, c, f in zip(start[full], own[full], first[full], strict=True)])
        return out, at

    def logits(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(buckets, first)[0] @ self.output + self.bias

    def scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return sigmoid(on_grid(self.logits(buckets, first)) / GRID * self.slope + self.shift)


def on_grid(logits: np.ndarray) -> np.ndarray:
    """Logits in steps of 1 / GRID, so that any number of rows has a bounded number of different scores."""
    return np.rint(np.clip(logits.astype(np.float64), -40, 40) * GRID)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def new_model(seed: int = 1) -> Model:
    r = np.random.default_rng(seed)
    f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    width = len(WIDTHS) * FILTERS
    return Model([f(BUCKETS, PART, scale=0.05) for _ in range(TABLES)], [f(w * DIMENSIONS, FILTERS, scale=(DIMENSIONS * w) ** -0.5) for w in WIDTHS], [np.full(FILTERS, 0.05, np.float32) for _ in WIDTHS], f(width, scale=0.1), 0.0)


def flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


class Learner:
    """Mini-batch Adagrad on a model; sums are of the squared slopes, by parameter."""

    def __init__(self, model: Model, parameters: np.ndarray | None = None, sums: np.ndarray | None = None):
        self.model, self.bias = model, np.array([model.bias], np.float32)
        self.arrays = [*model.tables, *model.filters, *model.offsets, model.output, self.bias]
        self.sums = [np.full(a.shape, 1e-6, np.float32) for a in self.arrays]
        for arrays, values in ((self.arrays, parameters), (self.sums, sums)):
            if values is not None:
                for a, part in zip(arrays, np.split(values, np.cumsum([a.size for a in arrays])[:-1]), strict=True):
                    a[:] = part.reshape(a.shape)
        model.bias = float(self.bias[0])
        self.sum_of = {id(a): s for a, s in zip(self.arrays, self.sums, strict=True)}

    def descend(self, a: np.ndarray, g: np.ndarray, rate: float, at=slice(None)) -> None:
        s = self.sum_of[id(a)]
        s[at] += g * g
        a[at] -= rate * g / np.sqrt(s[at])

    def learn(self, buckets: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, order: np.ndarray) -> None:
        """One pass over the documents in that order."""
        model = self.model
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            n = first[own + 1] - first[own]
            mine = buckets[:, T.ranges(first[own], n)]
            pooled, at, end = model.pooled(mine, np.concatenate([[0], np.cumsum(n)]), places=True)
            g = ((sigmoid(pooled @ model.output + model.bias) - y[own]) * weight[own] / len(own)).astype(np.float32)
            back = (g[:, None] * model.output[None, :]) * (pooled > 0)
            self.descend(model.output, pooled.T @ g, 0.05)
            self.descend(self.bias, np.array([g.sum()]), 0.05)
            model.bias = float(self.bias[0])
            if not mine.shape[1]:
                continue
            words, slopes = [], []  # of the words in the windows that the maxima are of
            for i, w in enumerate(WIDTHS):
                part, place = back[:, i * FILTERS : (i + 1) * FILTERS], at[:, i * FILTERS : (i + 1) * FILTERS]
                gf = np.zeros_like(model.filters[i])
                for j in range(w):
                    lo, hi = j * DIMENSIONS, (j + 1) * DIMENSIONS
                    d, f = np.nonzero((part != 0) & (place + j < end[:, None]))  # beyond the end are zeros
                    word, share = place[d, f] + j, part[d, f, None]
                    seen = np.concatenate([model.tables[t][mine[t, word]] for t in range(TABLES)], axis=1)
                    np.add.at(gf[lo:hi].T, f, share * seen)
                    words.append(word)
                    slopes.append(share * model.filters[i][lo:hi].T[f])
                self.descend(model.filters[i], gf, 0.05)
                self.descend(model.offsets[i], part.sum(axis=0), 0.05)
            word, slope = np.concatenate(words), np.concatenate(slopes)
            for t in range(TABLES):
                b, inverse = np.unique(mine[t, word], return_inverse=True)
                gt = np.zeros((len(b), PART), np.float32)
                np.add.at(gt, inverse, slope[:, t * PART : (t + 1) * PART])
                self.descend(model.tables[t], gt, 0.1, b)


def constant(y: int) -> Model:
    """The model where all labels are y."""
    model = new_model()
    model.output[:] = 0
    model.bias = 40.0 if y else -40.0
    return model


def train(column: pa.Array, y: np.ndarray, weight: np.ndarray, seed: int = 1) -> Model:
    """A model of the texts' labels (0 or 1), learned by this process alone."""
    if not len(y) or len(set(y.tolist())) < 2:
        return constant(int(len(y) and y[0]))
    model, r = new_model(seed), np.random.default_rng(seed)
    # A slice at a time: the text's own arrays are larger than what is kept of them.
    parts = [word_buckets(b.column("text")) for b in T.slices([pa.record_batch([column], ["text"])], T.SLICE_BYTES // 2)]
    buckets = np.concatenate([b.astype(np.uint16) for b, _ in parts], axis=1)
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
    share = (y * weight).sum() / weight.sum()
    model.bias = float(np.log(share / (1 - share)))
    learner = Learner(model)
    for _ in range(EPOCHS):
        learner.learn(buckets, first, y, weight, r.permutation(len(y)))
    return model


def _best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the greatest F1, halfway between the scores around it."""
    order = np.argsort(-score, kind="stable")
    s, hit, w = score[order], (y * weight)[order], weight[order]
    f1 = 2 * np.cumsum(hit) / (np.cumsum(w) + hit.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores can't be parted
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] / 2)


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, weight: np.ndarray, lang: list[str | None]) -> None:
    """Slope, shift and thresholds from the logits of rows that took no part in training; weight: the rows with that logit, label and language."""
    if len(set(y.tolist())) < 2:
        return
    # Platt scaling by Newton's method with a weak pull to slope 1.
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * z + b)
        g = np.array([(weight * (p - y) * z).sum() + (a - 1), (weight * (p - y)).sum()])
        d = weight * p * (1 - p) + 1e-9
        step = np.linalg.solve(np.array([[(d * z * z).sum() + 1, (d * z).sum()], [(d * z).sum(), d.sum()]]), g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    model.slope, model.shift = max(float(a), 0.05), float(b)
    score = sigmoid(model.slope * z + model.shift)
    model.threshold = _best_threshold(score, y, weight)
    names = np.array([x or "" for x in lang])
    for name in np.unique(names):
        own = names == name
        if name and min(weight[own & (y == 1)].sum(), weight[own & (y == 0)].sum()) >= LEAST:
            model.thresholds[str(name)] = _best_threshold(score[own], y[own], weight[own])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that follow their label's row (where y is not null), as their words' rows in the tables: 16 bits each, a word after the other."""
    of = y = None
    for batch in T.slices(batches, T.SLICE_BYTES // 2):
        at, labels = [], []
        for k, (doc_id, label) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), strict=True)):
            if label is not None:
                of, y = doc_id, label
            elif doc_id == of:
                at.append(k)
                labels.append(y)
        if at:
            found = batch.take(pa.array(at))
            buckets, first = word_buckets(found.column("text"))
            buckets = np.ascontiguousarray(buckets.T.astype(np.uint16))
            words = pa.array([buckets[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(found.column(c) for c in ("shard", "calibrates", "lang")), pa.array(labels, pa.int32()), words], ["shard", "calibrates", "lang", "y", "words"])


def _unpacked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """word_buckets of rows that _hashed made."""
    buckets = np.frombuffer(b"".join(words), np.uint16).reshape(-1, TABLES)
    return np.ascontiguousarray(buckets.T), np.concatenate([[0], np.cumsum([len(w) // (2 * TABLES) for w in words])])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Runs of a shard's rows, in their order: shard, labels, words."""
    now, y, words, size = None, [], [], 0
    for batch in batches:
        for shard, label, own in zip(batch.column("shard").to_pylist(), batch.column("y").to_pylist(), batch.column("words"), strict=True):
            if words and (shard != now or len(words) == CHUNK_ROWS or size >= CHUNK_BYTES):
                yield now, y, words
                y, words, size = [], [], 0
            now = shard
            y.append(label)
            words.append(own.as_py())
            size += len(words[-1])
    if words:
        yield now, y, words


def one_pass(rows: DataFrame, parameters: np.ndarray, sums: np.ndarray, epoch: int) -> tuple[np.ndarray, np.ndarray]:
    """The parameters and sums after each shard has learned from all its rows, and the changes are averaged; rows: a shard's together, in their order."""
    shared = rows.sparkSession.sparkContext.broadcast((parameters, sums))  # 6 MB, whatever the corpus

    schema = pa.schema([("piece", pa.int32()), ("change", pa.binary()), ("squares", pa.binary()), ("shard", pa.int32()), ("n", pa.int64())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sys.platform == "linux":
            one_thread()
        was = shared.value
        for shard, chunks in groupby(_chunks(batches), lambda c: c[0]):
            learner, n = Learner(new_model(), *was), 0
            r = np.random.default_rng([epoch, shard])
            for _, y, words in chunks:
                learner.learn(*_unpacked(words), np.array(y), np.ones(len(y)), r.permutation(len(y)))
                n += len(y)
            change, squares = flat(learner.arrays) - was[0], flat(learner.sums) - was[1]
            for k in range(0, len(change), PIECE):
                own = slice(k, k + PIECE)
                if change[own].any() or squares[own].any():
                    yield pa.RecordBatch.from_pylist([{"piece": k, "change": change[own].tobytes(), "squares": squares[own].tobytes(), "shard": shard, "n": n}], schema)

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, found in groupby((r for b in batches for r in b.to_pylist()), lambda r: r["piece"]):
            total = weight = np.float64(0)
            for row in found:
                both = np.stack([np.frombuffer(row[c], np.float32) for c in ("change", "squares")])
                total, weight = total + both * np.float64(row["n"]), weight + row["n"] * both.any(axis=0)
            mean = (total / np.maximum(weight, 1)).astype(np.float32)
            yield pa.RecordBatch.from_pylist([{"piece": piece, "change": mean[0].tobytes(), "squares": mean[1].tobytes()}], pa.schema(list(schema)[:3]))

    changes = map_arrow(rows, learn, "piece int, change binary, squares binary, shard int, n long")
    found = map_arrow(changes.repartition("piece").sortWithinPartitions("piece", "shard"), average, "piece int, change binary, squares binary").toArrow().to_pylist()
    shared.destroy()
    parameters, sums = parameters.copy(), sums.copy()
    for row in found:
        own = slice(row["piece"], row["piece"] + PIECE)
        parameters[own] += np.frombuffer(row["change"], np.float32)
        sums[own] += np.frombuffer(row["squares"], np.float32)
    return parameters, sums


def likely(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts whose doc_id may be in rows: all that are, and of the others those that share a bit of a map of BITS bits (4 MB, whatever the corpus)."""
    place = F.pmod(F.xxhash64(F.lit("place"), F.col("doc_id")), F.lit(BITS)) + 1
    maps = rows.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = texts.withColumn("part", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "part")
    return found.filter(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0).select(texts.columns)


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled rows outside the held-out fold."""
    rows = labelled_rows(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), F.col("toxic")).filter(F.col("y").isin(0, 1))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    texts = texts.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    calibrates = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id")), F.lit(CALIBRATION)) == 0
    count = {(r["calibrates"], r["y"]): r["count"] for r in rows.join(texts, "doc_id").groupBy(calibrates.alias("calibrates"), "y").count().collect()}
    seen = {y for _, y in count}
    if len(seen) < 2:
        return constant(max(seen, default=0))
    if not all(count.get((False, y)) for y in seen):
        calibrates = F.lit(False)
        count = {(False, y): count.get((False, y), 0) + count.get((True, y), 0) for y in seen}
    n = count[False, 0] + count[False, 1]
    shards = min(SHARDS, -(-n // SHARD_ROWS))
    shard = F.pmod(F.xxhash64(F.lit("shard"), F.col("doc_id")), F.lit(shards)).cast("int")
    order = F.xxhash64(F.lit("order"), F.col("doc_id"))
    # Texts shuffle once: a label's row comes before the texts it is of.
    rows_of = rows.select("doc_id", "y", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"))
    both = rows_of.unionByName(likely(texts, rows).withColumn("y", F.lit(None).cast("int")))
    dealt = both.select("*", shard.alias("shard"), calibrates.alias("calibrates")).repartitionById(shards, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", order, "doc_id", F.col("y").desc_nulls_last(), "text")
    hashed = map_arrow(dealt, _hashed, "shard int, calibrates boolean, lang string, y int, words binary").persist(StorageLevel.DISK_ONLY)
    try:
        have = {(r["calibrates"], r["y"]): r["count"] for r in hashed.groupBy("calibrates", "y").count().collect()}
        if have != count:
            raise RuntimeError(f"labelled rows by calibration and label: {count}, but {have} were dealt")
        model = new_model()
        model.bias = float(np.log(count[False, 1] / count[False, 0]))
        learner = Learner(model)
        parameters, sums = flat(learner.arrays), flat(learner.sums)
        for epoch in range(EPOCHS):
            parameters, sums = one_pass(hashed.filter(~F.col("calibrates")).select("shard", "y", "words"), parameters, sums, epoch)
        Learner(model, parameters, sums)
        calibrate(model, *logits_of(hashed.filter("calibrates"), model))
    finally:
        hashed.unpersist()
    return model


def logits_of(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """The rows' different logits, labels and languages, and the rows with each; lang is null where there are fewer than LEAST rows of a label."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sys.platform == "linux":
            one_thread()
        for batch in T.slices(batches, T.SLICE_BYTES // 2, ("words",)):
            z = on_grid(shared.value.logits(*_unpacked(batch.column("words").to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("y"), pa.array(z.astype(np.int32), pa.int32())], ["lang", "y", "z"])

    enough = rows.groupBy("lang").agg(F.sum("y").alias("hits"), F.count("*").alias("n")).filter(f"hits >= {LEAST} and n - hits >= {LEAST}").select("lang", F.col("lang").alias("own"))
    table = map_arrow(rows.select("lang", "y", "words"), run, "lang string, y int, z int").join(enough, "lang", "left").groupBy("own", "y", "z").count().toArrow().sort_by([("z", "ascending"), ("y", "ascending"), ("own", "ascending")])
    shared.destroy()
    return table["z"].to_numpy() / GRID, table["y"].to_numpy(), table["count"].to_numpy().astype(float), table["own"].to_pylist()


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, threshold, flagged (score >= threshold, the language's)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 3 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in T.slices(batches, T.SLICE_BYTES // 2):
            p = m.scores(*word_buckets(batch.column("text")))
            least = np.array([m.thresholds.get(x, m.threshold) for x in batch.column("lang").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(least), pa.array(p >= least)], ["doc_id", "score", "threshold", "flagged"])

    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    return map_arrow(texts, run, "doc_id long, score double, threshold double, flagged boolean")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, flagged."""
    out = score(documents, fit(documents, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "flagged")
