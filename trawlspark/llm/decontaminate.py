"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

Documents and items are lower-cased (A-Z) and cut into words. For an item of L
words the windows of a document are its runs of L words (a shorter document is one
window). The shingles of a window are its runs of five words (of all its words,
if fewer), weighted by their bytes and counted with repeats. A window matches an
item if 100 * sum(min weight) >= 75 * sum(max weight), the weighted Jaccard
similarity over their shingles.

Candidates come from fingerprints alone: every window of every document gets the 64-bit
SimHash of its weighted shingles. An item is fingerprinted over its first W words, W its
size class (four to a doubling, so W > 4/5 L), and so are the windows, so that items of
like size share them. A fingerprint has BLOCKS blocks of 16 bits; two within RADIUS bits
differ in at most RADIUS // BLOCKS bits of one block at least (the pigeonhole principle), so
the index has an entry for each value of each block with the items that are so near
there, 15 % of all, and its entries are held against RADIUS on all 64 bits, which leaves
one unrelated pair in 3,000. What is left is verified exactly. At a similarity of 0.75
fingerprints differ in 11 bits on average, with a standard deviation of 3: RADIUS is 2.5
deviations more, and of pairs at 0.75 about 1 in 150 is missed, at 0.8 and more hardly any.

The benchmark is a stated query set: it is read in blocks of at most ITEMS_AT_ONCE items and
ITEM_BYTES of text (a longer item is a block of its own), and each block meets all documents.
A task holds one block and its index (130 MB at most), and SUMMED words of windows at a time.

Defined results: null and empty texts match nothing, neither as items nor as
documents; repeated items all match; texts and items of any length are worked on as a whole;
doc_id and item_id are keys (rows of one doc_id share its items), and null ones are told
apart by their texts (see common.key_of); extra columns are ignored; an empty benchmark
keeps all documents; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import arrowtext as T
from .common import key_of, materialize, with_texts

WORDS = 5
THRESHOLD = (75, 100)
BITS, BLOCKS, RADIUS = 64, 4, 18
#: Items and bytes of their texts in one block of the benchmark, at most.
ITEMS_AT_ONCE, ITEM_BYTES = 4096, 4 << 20
#: Words whose windows are fingerprinted at a time, and shingles that are verified at a time.
SUMMED, VERIFIED = 1 << 11, 1 << 20
#: Fingerprints that are looked up at a time: as many as a processor's cache holds.
LOOKED_UP = 1 << 16

_ALL = np.arange(1 << 16)
_NEAR = _ALL[np.bitwise_count(_ALL) <= RADIUS // BLOCKS].astype(np.uint16)  # what near block values differ by


def size_class(words: int) -> int:
    """The largest size at most words that has a three-bit mantissa."""
    shift = max(0, words.bit_length() - 3)
    return words >> shift << shift


_BYTE_SIGNS = {kind: np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(kind) * kind(2) - kind(1) for kind in (np.int16, np.int64, np.float64)}
#: Rows whose sums are run up together.
_RUN = 16


def _signs(hashes: np.ndarray, kind=np.float64) -> np.ndarray:
    """A row of 64 numbers 1 or -1 for each shingle hash."""
    return _BYTE_SIGNS[kind][np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)].reshape(-1, BITS)


def _sums(hashes: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Row k: the signed weights of the first k shingles, added up. In 16 bits, modulo 2**16, if the weights of any most shingles stay below 2**15."""
    kind = np.int16 if most * int(weights.max(initial=0)) < 1 << 15 else np.int64
    n = len(hashes)
    x = np.zeros((-(-(n + 1) // _RUN) * _RUN, BITS), kind)
    np.multiply(_signs(hashes, kind), weights[:, None].astype(kind), out=x[1 : n + 1])
    runs = x.reshape(-1, _RUN, BITS)
    for j in range(1, _RUN):
        runs[:, j] += runs[:, j - 1]
    runs[1:] += np.cumsum(runs[:-1, -1], axis=0, dtype=kind)[:, None, :]
    return x[: n + 1]


def _packed(positive: np.ndarray) -> np.ndarray:
    """Rows of 64 booleans as 64-bit numbers."""
    return np.packbits(positive.ravel()).view(np.uint64)


def simhash(hashes: np.ndarray, weights: np.ndarray) -> np.uint64:
    """The fingerprint of one sequence of shingles."""
    total = np.zeros(BITS)  # sums of integers: exact
    for k in range(0, len(hashes), SUMMED):
        total += weights[k : k + SUMMED].astype(np.float64) @ _signs(hashes[k : k + SUMMED])
    return _packed(total > 0)[0]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class _Text:
    """Words of a slice with the hash and weight of every run of k words."""

    def __init__(self, column: pa.Array):
        self.words = T.split_words(column)
        self.windows = T.Windows(self.words.hashes(lower=True))
        self.bytes = np.concatenate([[0], np.cumsum(self.words.ends - self.words.starts)])
        self.runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.runs:
            starts = np.arange(max(0, len(self.words.starts) - k + 1))
            self.runs[k] = self.windows(starts, k), self.bytes[starts + k] - self.bytes[starts]
        return self.runs[k]

    def prints(self, start: int, size: int) -> np.uint64:
        k = min(WORDS, size)
        return simhash(*(x[start : start + size - k + 1] for x in self.shingles(k)))


class Index:
    """The items of one block of the benchmark; built once in each task."""

    def __init__(self, ids: list[int], texts: list[str]):
        text = _Text(pa.array(texts, pa.string()))
        first, counts = text.words.first, text.words.counts
        own = np.flatnonzero(counts > 0)
        of_class = np.array([size_class(int(n)) for n in counts[own]], np.int64)
        own = own[np.argsort(of_class, kind="stable")]
        self.ids, self.sizes = np.array(ids, np.int64)[own], counts[own]
        self.classes: dict[int, np.ndarray] = {}  # window size -> items
        for i, n in enumerate(self.sizes.tolist()):
            self.classes.setdefault(size_class(n), []).append(i)
        self.classes = {w: np.array(x) for w, x in self.classes.items()}
        self.items, self.prints = [], np.zeros(len(own), np.uint64)
        # A byte for each value of a block and eight items.
        self.table = np.zeros((BLOCKS, -(-len(own) // 8), 1 << 16), np.uint8)
        for i, (at, n) in enumerate(zip(first[own].tolist(), self.sizes.tolist(), strict=True)):
            k = min(WORDS, n)
            hashes, weights = (x[at : at + n - k + 1] for x in text.shingles(k))
            mine, where, have = np.unique(hashes, return_index=True, return_counts=True)
            self.items.append((mine, weights[where], have, int(weights.sum())))
            self.prints[i] = text.prints(at, size_class(n))
            for b, value in enumerate(self.prints[i : i + 1].view(np.uint16)):
                self.table[b, i // 8, value ^ _NEAR] |= np.uint8(1 << i % 8)

    def near(self, prints: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
        """The items of a size class with the places of the fingerprints within RADIUS."""
        items, found = self.classes[size], {}
        for k in range(0, len(prints), LOOKED_UP):
            some = prints[k : k + LOOKED_UP]
            parts = np.ascontiguousarray(some.view(np.uint16).reshape(-1, BLOCKS).T).astype(np.intp)
            for g in range(items[0] // 8, items[-1] // 8 + 1):
                hits = reduce(np.bitwise_or, (self.table[b, g].take(parts[b]) for b in range(BLOCKS)))
                for i in items[items // 8 == g].tolist():
                    at = np.flatnonzero((hits & np.uint8(1 << i % 8)) != 0)  # booleans are found faster
                    at = at[distances(some[at], self.prints[i]) <= RADIUS]
                    if len(at):
                        found.setdefault(i, []).append(at + k)
        for i, parts in found.items():
            yield i, np.concatenate(parts)

    def candidates(self, text: _Text) -> Iterator[tuple[int, np.ndarray]]:
        """An item and the first words of windows whose fingerprints are near its own."""
        first, counts = text.words.first, text.words.counts
        total = len(text.words.starts)
        if not len(self.ids) or not total:
            return
        end = np.repeat(first[1:], counts)  # of each word's document
        for k in sorted({min(WORDS, w) for w in self.classes}):
            sizes = [w for w in self.classes if min(WORDS, w) == k]
            hashes, weights = text.shingles(k)
            most, step = max(sizes) - k + 1, max(SUMMED, max(sizes))
            prints = {size: [] for size in sizes}
            for a in range(0, len(hashes), step):
                sums = _sums(hashes[a : a + step + most], weights[a : a + step + most], most)
                for size in sizes:
                    shingles = size - k + 1
                    n = min(step, len(sums) - shingles)
                    if n > 0:
                        prints[size].append(_packed(sums[shingles : shingles + n] - sums[:n] > 0))
            for size, parts in prints.items():
                if parts:
                    every = np.concatenate(parts)
                    starts = np.flatnonzero(np.arange(size, size + len(every)) <= end[: len(every)])
                    for i, at in self.near(every[starts], size):
                        yield i, starts[at]
        # Documents shorter than the size class, whole: those of fewer than five words have one shingle, which no longer item has.
        short = np.flatnonzero((counts >= WORDS) & (counts < max(self.classes)))
        whole = np.array([text.prints(int(first[d]), int(counts[d])) for d in short], np.uint64)
        for size in self.classes:
            own = counts[short] < size
            for i, at in self.near(whole[own], size):
                yield i, first[short[own][at]]

    def matches(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """document (place in the slice), item, start word, shared and total weight of every matching window."""
        text = _Text(column)
        first = text.words.first
        found: list[tuple[np.ndarray, ...]] = []
        for i, starts in self.candidates(text):
            doc = np.searchsorted(first, starts, "right") - 1
            size = np.minimum(self.sizes[i], first[doc + 1] - first[doc])
            fits = starts + size <= first[doc + 1]
            for n in np.unique(size[fits]).tolist():
                own = starts[fits & (size == n)]
                step = max(1, VERIFIED // n)
                found += [self._verify(text, own[k : k + step], i, n) for k in range(0, len(own), step)]
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        item, start, shared, total = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = np.searchsorted(first, start, "right") - 1
        return doc, item, start - first[doc], shared, total

    def _verify(self, text: _Text, starts: np.ndarray, i: int, size: int) -> tuple[np.ndarray, ...]:
        """The windows of size words that match item i."""
        mine, unit, have, whole = self.items[i]
        k = min(WORDS, size)
        hashes, weights = text.shingles(k)
        at = starts[:, None] + np.arange(size - k + 1)[None, :]
        own = hashes[at]
        place = np.searchsorted(mine, own)
        place[place == len(mine)] = 0
        row, column = np.nonzero(mine[place] == own)
        seen = np.bincount(row * len(mine) + place[row, column], minlength=len(starts) * len(mine)).reshape(len(starts), len(mine))
        shared = (np.minimum(seen, have[None, :]) * unit[None, :]).sum(axis=1)
        total = weights[at].sum(axis=1) + whole - shared
        good = THRESHOLD[1] * shared >= THRESHOLD[0] * total
        return np.full(good.sum(), self.ids[i]), starts[good], shared[good], total[good]


def _matcher(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in T.slices(batches):
            doc, item, start, shared_, total = index.matches(batch.column("text"))
            # The best window of each document and item, the first of equals.
            order = np.lexsort((start, -shared_ / np.maximum(total, 1), item, doc))
            doc, item, start, shared_, total = (x[order] for x in (doc, item, start, shared_, total))
            best = np.ones(len(doc), bool)
            best[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            doc, item, start, shared_, total = (x[best] for x in (ids[doc], item, start, shared_, total))
            yield pa.RecordBatch.from_arrays([T.long_column(doc), T.long_column(item), T.long_column(start), pa.array(shared_ / np.maximum(total, 1), pa.float64())], ["doc_id", "item_id", "start", "similarity"])

    return run


def _blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in blocks of at most ITEMS_AT_ONCE items and ITEM_BYTES, or of one item."""
    ids, texts, size = [], [], 0
    for id_, text in items.toLocalIterator():
        n = len(text.encode())
        if ids and (len(ids) >= ITEMS_AT_ONCE or size + n > ITEM_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(id_)
        texts.append(text)
        size += n
    if ids:
        yield ids, texts


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, similarity): the best window of each document that holds an item."""
    texts, context = with_texts(documents), documents.sparkSession.sparkContext
    items = benchmark.select(key_of(F.col("item_id"), F.col("text")).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    # A broadcast is one block: its bound is checked as it is filled.
    parts = [map_arrow(texts, _matcher(context.broadcast(block)), "doc_id long, item_id long, start long, similarity double") for block in _blocks(items)]
    if not parts:
        return texts.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, similarity double")
    return reduce(DataFrame.unionByName, parts)


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, items (sorted array of item_id), similarity (the greatest; 0 without a match), kept."""
    found = materialize(matches(documents, benchmark), "matches")
    by_doc = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity"))
    j = with_texts(documents).select("doc_id").join(by_doc, "doc_id", "left")
    return j.select("doc_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("items").isNull().alias("kept"))
