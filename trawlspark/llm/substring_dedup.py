"""Removal of passages that occur elsewhere, by difference-cover anchors.

A window is LENGTH consecutive words of one document. COVER is a difference cover
modulo PERIOD: every difference modulo PERIOD is one of two of its members. So for
any two places with the same window there is a shift below PERIOD that brings both
to positions in COVER, and the ANCHOR = LENGTH - PERIOD + 1 words from there lie
within both windows. Hence only the ANCHOR-word windows at cover positions (5 of
21) are hashed and grouped; where an anchor occurs twice, it is extended to all
the windows around it that could hold it, and those are grouped by the hash of
their LENGTH words. Both groupings count and never pair places up, so a passage
that a third of all documents hold is no larger work than the rows it is in; and
each task sends a repeated hash once for each CHUNK_BYTES of text, whatever its
number of places there. Places travel as arrays, one row for each part of a chunk's
sorted hashes, and are sorted and grouped as arrays where all of a part's rows meet; so do
those found, by document.

Anchors group by 64 bits, which only choose what is extended; windows group by 128 bits
(both lanes of their words' digests), which decide. Words are bytes, unchanged by case.
Defined results: null texts have
no words; documents shorter than LENGTH lose nothing; exact copies lose all words
of their windows, and so do repeated rows; rows that share a doc_id, or have none,
keep their own words; extra columns are ignored; an empty table gives no rows. A text
of any length is worked on as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import arrowtext as T
from .common import BROADCAST_IDS, materialize, select_ids, with_row_keys

LENGTH = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
ANCHOR = LENGTH - PERIOD + 1
#: Repeats within so much text are told apart by the task itself.
CHUNK_BYTES = 8 << 20

#: Repeated places that a task holds before it deals them out by document.
DEALT = 1 << 22

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
PLACES = "part int, hash binary, other binary, key binary, at binary"
FOUND, REPEATED = "part int, key binary, at binary", "key long, ats array<int>"


def _order(h: np.ndarray, o: np.ndarray | None) -> np.ndarray:
    """The order by hash, and by its other lane where hashes are equal and that differs."""
    order = np.argsort(h)
    if o is not None and ((h[order[1:]] == h[order[:-1]]) & (o[order[1:]] != o[order[:-1]])).any():
        order = np.lexsort((o, h))
    return order


def _new(h: np.ndarray, o: np.ndarray | None) -> np.ndarray:
    """Of sorted hashes: whether one differs from the one before it."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if o is not None:
        new[1:] |= o[1:] != o[:-1]
    return new


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The values' bytes, cut at the edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def part_numbers(spark: SparkSession) -> np.ndarray:
    """A number for each shuffle partition that Spark's hash deals to it: parts with these numbers never share one."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers, size = np.zeros(0, np.int32), 16 * n + 64
    while len(numbers) < n:  # once, but for one case in millions
        size *= 2
        rows = spark.range(size).select(F.col("id").cast("int").alias("id")).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("to")).toArrow().sort_by("id")
        numbers = rows.column("id").to_numpy()[np.unique(rows.column("to").to_numpy(), return_index=True)[1]]
    return numbers


def _part(h: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which part 64-bit hashes belong to: ascends with the hash."""
    return ((h >> T.U64(32)) * T.U64(len(parts)) >> T.U64(32)).astype(np.int64)


def _places(parts: np.ndarray, hashes: np.ndarray, others: np.ndarray | None, keys: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of PLACES: a row for each part of the chunk's hashes, with arrays. A hash's places within the chunk: one stands for the hash (both of
    its lanes), with ~at if it has more; the others, known to be repeated, come without hashes, in rows dealt over the parts."""
    if not len(hashes):
        return
    order = _order(hashes, others)
    h, o, key, at = hashes[order], None if others is None else others[order], keys[order].astype(np.int64), at[order].astype(np.int32)
    head = _new(h, o)
    more = np.zeros(len(h), bool)
    more[:-1] = ~head[1:]
    own = np.where(more, ~at, at)[head]
    part = _part(h[head], parts)
    edges = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
    none = pa.nulls(len(edges) - 1, pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(parts[part[edges[:-1]]]), _packed(h[head], edges), none if o is None else _packed(o[head], edges), _packed(key[head], edges), _packed(own, edges)], ["part", "hash", "other", "key", "at"])
    if not head.all():
        key, at = key[~head], at[~head]
        edges = np.append(np.arange(0, len(key), 1 << 14), len(key))
        some = parts[(int(h[0]) % len(parts) + np.arange(len(edges) - 1)) % len(parts)]
        none = pa.nulls(len(some), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some), none, none, _packed(key, edges), _packed(at, edges)], ["part", "hash", "other", "key", "at"])


def _chunked(rows: Iterator[tuple], parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    join = lambda held: (None if x[0] is None else np.concatenate(x) for x in zip(*held, strict=True))
    for n, *row in rows:
        held.append(row)
        size += n
        if size >= CHUNK_BYTES:
            yield from _places(parts, *join(held))
            held, size = [], 0
    if held:
        yield from _places(parts, *join(held))


def _anchors(batches: Iterator[pa.RecordBatch], parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in T.slices(batches):
            words = T.split_words(batch.column("text"))
            starts, n = T.window_starts(words, ANCHOR)
            at = T.ranges(np.zeros(len(n), np.int64), n)
            # A document shorter than LENGTH has no window, but it costs little to leave its anchors out as well.
            long = np.repeat(words.counts >= LENGTH, n)
            take = _IN_COVER[at % PERIOD] & long
            keys = np.repeat(batch.column("key").to_numpy(zero_copy_only=False), n)
            hashes = T.Windows(words.hashes())(starts[take], ANCHOR)
            yield len(words.data), hashes, None, keys[take], at[take]

    yield from _chunked(rows(), parts)


def _dealt(parts: np.ndarray, keys: list[np.ndarray], ats: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND: a row for each part of the documents, with arrays."""
    key, at = np.concatenate(keys), np.concatenate(ats)
    if not len(key):
        return
    h = T.mix(key.view(T.U64))
    order = np.argsort(h)
    part = _part(h[order], parts)
    edges = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
    yield pa.RecordBatch.from_arrays([pa.array(parts[part[edges[:-1]]]), _packed(key[order], edges), _packed(at[order], edges)], ["part", "key", "at"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of FOUND, of each document all: rows of REPEATED, one for each document."""
    keys, ats = [], []
    for batch in batches:
        keys += [np.frombuffer(x, np.int64) for x in batch.column("key").to_pylist()]
        ats += [np.frombuffer(x, np.int32) for x in batch.column("at").to_pylist()]
    if not keys:
        return
    key, at = np.concatenate(keys), np.concatenate(ats)
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    lists = T.ragged(pa.array(at), np.diff(np.append(first, len(key))))
    yield from pa.Table.from_arrays([pa.array(key[first]), lists], ["key", "ats"]).to_batches(20_000)


def _repeated(batches: Iterator[pa.RecordBatch], parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """From rows of PLACES sorted by part, of each part all: the places whose hash has another one, or that have a twin in their own chunk."""
    held: list[tuple] = []
    last, keys, ats, size = None, [], [], 0
    array = lambda column, kind: np.frombuffer(b"".join(column), kind)

    def flush() -> None:
        """The repeated places of the part that is held."""
        nonlocal size
        if not held:
            return
        hash_, other, key, at = zip(*held, strict=True)
        held.clear()
        h, o = array(hash_, T.U64), None if other[0] is None else array(other, T.U64)
        order = _order(h, o)
        new = _new(h[order], None if o is None else o[order])
        at = array(at, np.int32)[order]
        out = ~new | (at < 0)
        out[:-1] |= ~new[1:]
        keys.append(array(key, np.int64)[order][out])
        ats.append(np.where(at < 0, ~at, at)[out])
        size += len(keys[-1])

    for batch in batches:
        for part, hash_, other, key, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != last:
                flush()
                last = part
            if hash_ is None:
                keys.append(np.frombuffer(key, np.int64))
                ats.append(np.frombuffer(at, np.int32))
                size += len(keys[-1])
            else:
                held.append((hash_, other, key, at))
            if size >= DEALT:
                yield from _dealt(parts, keys, ats)
                keys, ats, size = [], [], 0
    flush()
    if keys:
        yield from _dealt(parts, keys, ats)


def repeated_places(places: DataFrame, parts: np.ndarray) -> DataFrame:
    """(key, ats) of the places whose hash occurs at another place too, a row for each document that has any."""
    found = map_arrow(places.repartition("part").sortWithinPartitions("part"), partial(_repeated, parts=parts), FOUND)
    return map_arrow(found.repartition("part"), _by_document, REPEATED)


def _windows(batches: Iterator[pa.RecordBatch], parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in T.slices(batches):
            words = T.split_words(batch.column("text"))
            lists = batch.column("ats")
            at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            n = words.counts - LENGTH + 1  # windows of each document
            # All windows that hold the anchor: their starts as steps up and down, counted along the slice.
            first = np.maximum(at - (PERIOD - 1), 0)
            last = np.minimum(at, n[doc] - 1)
            ok = last >= first
            steps = np.zeros(words.first[-1] + 1, np.int32)
            np.add.at(steps, words.first[doc[ok]] + first[ok], 1)
            np.add.at(steps, words.first[doc[ok]] + last[ok] + 1, -1)
            starts = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
            of = np.searchsorted(words.first, starts, "right") - 1
            keys = batch.column("key").to_numpy(zero_copy_only=False)[of]
            lanes = words.digests()
            yield len(words.data), *(T.Windows(lanes[k], k)(starts, LENGTH) for k in (0, 1)), keys, starts - words.first[of]

    yield from _chunked(rows(), parts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        words = T.split_words(batch.column("text"))
        total = int(words.first[-1])
        gone = np.zeros(total, bool)
        lists = batch.column("ats")
        if lists.null_count < len(lists):
            lists = lists.fill_null([])
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.unique(words.first[doc] + at)
            steps = np.zeros(total + 1, np.int32)
            np.add.at(steps, at, 1)
            np.add.at(steps, at + LENGTH, -1)
            gone = np.cumsum(steps[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
        # Kept words, each followed by one space, copied byte by byte in one go.
        starts, size = words.starts[~gone], (words.ends - words.starts)[~gone]
        source = T.ranges(starts, size + 1)
        out = np.append(words.data, np.uint8(32))[source]
        ends = np.cumsum(size + 1)
        out[ends - 1] = 32
        kept = words.first - removed
        edge = np.concatenate([[0], ends])[kept]
        text = out.tobytes()
        shas = [hashlib.sha256(text[edge[i] : max(edge[i], edge[i + 1] - 1)]).hexdigest() for i in range(batch.num_rows)]
        texts = [text[edge[i] : max(edge[i], edge[i + 1] - 1)].decode("utf-8", "replace") for i in range(batch.num_rows)]
        columns = [batch.column("doc_id"), pa.array(words.counts), pa.array(np.diff(removed)), pa.array(texts, pa.string()), pa.array(shas, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words left, joined by one space), kept_sha256."""
    texts = with_row_keys(documents).select("key", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    parts = part_numbers(documents.sparkSession)
    anchors = map_arrow(texts.select("key", "text"), partial(_anchors, parts=parts), PLACES)
    anchors = materialize(repeated_places(anchors, parts), "anchors")
    windows = map_arrow(_joined(texts.select("key", "text"), anchors), partial(_windows, parts=parts), PLACES)
    windows = materialize(repeated_places(windows, parts), "windows")
    n = windows.count()
    schema = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    if n > BROADCAST_IDS:
        return map_arrow(texts.join(windows, "key", "left"), _cut, schema)
    ids = windows.select("key")
    clean = select_ids(texts, ids, "key", "left_anti", n).withColumn("ats", F.lit(None).cast("array<int>"))
    return map_arrow(_joined(texts, windows).unionByName(clean), _cut, schema)


def _joined(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """The documents that have a list, with it. Few keys first thin out the texts, so that the others don't shuffle."""
    n = lists.count()
    thin = select_ids(texts, lists.select("key"), "key", count=n) if n <= BROADCAST_IDS else texts
    return thin.join(lists, "key")
