"""Near-duplicate documents by min-max hashing.

Texts are lower-cased (A-Z) and cut into words; a document's set is its distinct
five-word shingles. Under each of PERMUTATIONS hash permutations both the minimum
and the maximum are kept, so the signature has two values for each evaluation of
a hash. Two permutations' four values make a band; documents that share a band
are candidates, and every link is confirmed on the full sets: linked if
100 * |intersection| >= 75 * |union|. At a similarity of 0.75 a pair shares none
of the 32 bands with probability (1 - 0.75**4)**32 = 5e-6. That takes minimum and
maximum as independent. In small sets, where they are drawn without replacement, the
probability is up to (1 - 1/4)**32 = 1e-4 (3 of 4 shingles), so sets of at most SHORT
shingles have 32 more bands of permutations of their own: 1e-8 for two of them, and
at most 6e-6 for larger sets.

Documents with equal sets (told by 128 bits of BLAKE2b over the whole set, itself of
seeded 128-bit digests of words) are one class; only its smallest doc_id is banded. A bucket is never expanded into
all pairs: each member is compared with the bucket's leader, which joins whole
groups in one round, and then with other leaders where that would join different
components. What is left are buckets with members of different components. Those of
at most SMALL members are compared pair by pair. In larger ones, and in blocks of at
most BLOCK members a task, signatures tell which members may have a partner in another
component (at least PLAUSIBLE of 2 * PERMUTATIONS values agree: a pair at 0.75 falls
short by five standard deviations), and those are compared on their full sets, in
blocks again: a task gets two blocks and returns the links it needs to join them, not
their pairs. Blocks within one large component don't meet.

Defined results: a document without words has an empty set (n_shingles 0), is its
own component and is kept; doc_id is the key: repeated rows come back as often as they
are there, with one component, and null ones are told apart by their texts (see
common.key_of); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship
from . import arrowtext as T
from .common import BROADCAST_IDS, materialize, select_ids, with_texts
from .components import components

WORDS = 5
PERMUTATIONS = 64
THRESHOLD = (75, 100)
#: Rounds in which each bucket's members meet one leader.
LEADER_ROUNDS = 2
SMALL, BLOCK = 32, 256
#: Text in a block, on average at most (a longer document is a block of its own size).
BLOCK_BYTES = 8 << 20
PLAUSIBLE = 71

#: Sets of at most this many shingles have twice the bands.
SHORT = 64

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_MORE_A = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MORE_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = T.split_words(column)
    return T.shingles(words, T.Windows(words.hashes(lower=True)), WORDS)


def set_digests(hashes: np.ndarray, first: np.ndarray, places: tuple[np.ndarray, np.ndarray], lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's number of distinct shingles, and 128 bits that tell its set from any other: rows of two longs."""
    other = T.Windows(lanes[1], 1)(*places)
    size, out = np.zeros(len(first) - 1, np.int64), []
    for i in range(len(first) - 1):
        own = slice(first[i], first[i + 1])
        order = np.argsort(hashes[own], kind="stable")
        s = hashes[own][order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        size[i] = new.sum()
        out.append(blake2b(s[new].tobytes() + other[own][order][new].tobytes(), digest_size=16).digest())
    return size, np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)


def sets(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Each document's sorted distinct shingles."""
    out = []
    for i in range(len(first) - 1):
        s = np.sort(hashes[first[i] : first[i + 1]])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def min_max(hashes: np.ndarray, first: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """A row for each document with shingles: the minimum and maximum under each permutation, side by side (uint32)."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), 2 * PERMUTATIONS), np.uint32)
    if not len(starts):
        return out
    x = hashes >> np.uint64(32)
    for p in range(PERMUTATIONS):
        v = ((x * a[p] + b[p]) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * p] = np.minimum.reduceat(v, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(v, starts)
    return out


def bands(signature: np.ndarray, before: int = 0) -> np.ndarray:
    """A 64-bit key for each band of four values; keys of different bands differ, also from those of the bands before."""
    wide = signature.view(np.uint64).reshape(len(signature), -1, 2) if len(signature) else np.zeros((0, PERMUTATIONS // 2, 2), np.uint64)
    salt = T.mix(np.arange(before + 1, before + wide.shape[1] + 1, dtype=np.uint64))
    return T.mix(T.mix(wide[:, :, 0] + salt) ^ (wide[:, :, 1] * np.uint64(0x9E3779B97F4A7C15)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        words = T.split_words(batch.column("text"))
        lanes = words.digests(lower=True)
        *places, first = T.shingle_places(words, WORDS)
        hashes = T.Windows(lanes[0])(*places)
        full = np.diff(first) > 0
        size, marks = set_digests(hashes, first, tuple(places), lanes)
        signature = min_max(hashes, first)
        keys = bands(signature)
        short = (size <= SHORT)[full]
        starts, counts = first[:-1][full][short], np.diff(first)[full][short]
        own = np.concatenate([keys, np.zeros_like(keys)], axis=1)
        own[short, keys.shape[1] :] = bands(min_max(hashes[T.ranges(starts, counts)], np.concatenate([[0], np.cumsum(counts)]), _MORE_A, _MORE_B), keys.shape[1])
        used = np.ones(own.shape, bool)
        used[~short, keys.shape[1] :] = False
        number = np.zeros(batch.num_rows, np.int64)
        number[full] = used.sum(axis=1)
        lists = T.ragged(T.long_column(own[used]), number)
        low = np.zeros((batch.num_rows, 2 * PERMUTATIONS), np.uint8)
        low[full] = (signature & 0xFF).astype(np.uint8)
        sketches = pa.array([x.tobytes() for x in low], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), T.long_column(marks[:, 0].copy()), T.long_column(marks[:, 1].copy()), lists, sketches], ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"])


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (which tell equal sets), bands (array of long), sketch (the last byte of each signature value)."""
    return map_arrow(with_texts(documents), _signatures, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, whole = THRESHOLD
    for batch in T.slices(batches, columns=("text", "other")):
        left = sets(*shingle_hashes(batch.column("text")))
        right = sets(*shingle_hashes(batch.column("other")))
        keep = []
        for a, b in zip(left, right, strict=True):
            if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
                keep.append(False)
                continue
            both = np.sort(np.concatenate([a, b]))
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(whole * shared >= part * (len(a) + len(b) - shared))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    j = pairs.join(texts.select(F.col("doc_id").alias("a"), "text"), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b")
    return map_arrow(j.select("a", "b", "text", "other"), _confirm, "a long, b long")


def _joined(edges: DataFrame, found: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links with more of them, and the components of all."""
    more = materialize(more, "links")
    if more.isEmpty():
        return edges, found
    edges = materialize(edges.unionByName(more), "links")
    return edges, components(edges)


def _labelled(ids: DataFrame, found: DataFrame) -> DataFrame:
    """ids with c, their component so far."""
    return ids.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _open_buckets(met: DataFrame, found: DataFrame, r: int) -> DataFrame:
    """band, id, c of the buckets with more than one component, with n (members), li and lc: the leader of round r and its component."""
    now = _labelled(met.select("band", "id"), found)
    order = F.col("id") if r == 0 else F.xxhash64(F.lit(r), F.col("id"))  # another member each time
    leader = F.min(F.struct(order.alias("o"), F.col("id").alias("i"), F.col("c").alias("c"))).alias("l")
    mixed = now.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"), leader).filter("low < high")
    return materialize(now.join(mixed.select("band", "n", F.col("l.i").alias("li"), F.col("l.c").alias("lc")), "band"), "open")


def _small_pairs(open_: DataFrame) -> DataFrame:
    """The pairs between components in buckets of at most SMALL members."""
    few = open_.filter(F.col("n") <= SMALL)
    other = few.select("band", F.col("id").alias("id2"), F.col("c").alias("c2"))
    return few.join(other, "band").filter("c < c2").select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """From a symmetric matrix: for each connected part, its first member with each other one."""
    left, out = linked.any(axis=1), []
    while left.any():
        root = int(left.argmax())
        seen = np.zeros(len(linked), bool)
        new = np.zeros(len(linked), bool)
        new[root] = True
        while new.any():
            seen |= new
            new = linked[new].any(axis=0) & ~seen
        left &= ~seen
        out += [(root, int(k)) for k in np.flatnonzero(seen) if k != root]
    return out


def _plausible_block(table: pa.Table) -> pa.Table:
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
    ids, c = table.column("id").to_numpy(), table.column("c").to_numpy()
    agree = np.stack([(sketch == row).sum(axis=1) for row in sketch])
    tree = _forest((agree >= PLAUSIBLE) & (c[:, None] != c[None, :]))
    return pa.table({"a": pa.array([ids[i] for i, _ in tree], pa.int64()), "b": pa.array([ids[j] for _, j in tree], pa.int64())})


def _plausible(open_: DataFrame, sig: DataFrame) -> DataFrame:
    """(id, g): members of large buckets that may have a partner in another component, with the group that holds all of these partners."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = open_.select("band", "id", "c", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("q"))
    rows = rows.select("band", "id", "c", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    rows = rows.join(sig.select(F.col("doc_id").alias("id"), "sketch"), "id")
    ship(open_.sparkSession)
    edges = rows.groupBy("band", "p", "q").applyInArrow(_plausible_block, "a long, b long")
    return components(edges).select("id", F.col("component").alias("g"))


def _linked_block(table: pa.Table) -> pa.Table:
    part, whole = THRESHOLD
    own = sets(*shingle_hashes(table.column("text")))
    ids, c = table.column("id").to_numpy(), table.column("c").to_numpy()
    n, size = len(own), np.array([len(s) for s in own])
    _, column = np.unique(np.concatenate(own), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(column, kind="stable")
    holders, start = row[order], np.concatenate([[0], np.cumsum(np.bincount(column))])
    edge = np.concatenate([[0], np.cumsum(size)])
    linked = np.zeros((n, n), bool)
    for i in range(n):
        mine = column[edge[i] : edge[i + 1]]
        shared = np.bincount(holders[T.ranges(start[mine], start[mine + 1] - start[mine])], minlength=n)
        linked[i] = whole * shared >= part * (size[i] + size - shared)
    linked &= c[:, None] != c[None, :]
    a, b = np.nonzero(np.triu(linked))
    # Links that join no further components are left out.
    parent = {int(x): int(x) for x in c}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(int(c[i])), top(int(c[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(ids[i]), int(ids[j])))
    return pa.table({"a": pa.array([min(x) for x in out], pa.int64()), "b": pa.array([max(x) for x in out], pa.int64())})


def _small_side(df: DataFrame) -> DataFrame:
    """df for a join with many rows of one key: broadcast if it is small, so that they stay where they are."""
    df = materialize(df, "side")
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _block_links(plausible: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the components of each group, found block by block."""
    rows = _labelled(plausible, found)
    rows = rows.join(texts.select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size")), "id")
    # A component of more than one block has blocks of its own; the others share blocks.
    large = rows.groupBy(F.col("g").alias("g_"), F.col("c").alias("c_")).count().filter(F.col("count") > BLOCK).select("g_", "c_")
    rows = rows.join(_small_side(large), (F.col("g") == F.col("g_")) & (F.col("c") == F.col("c_")), "left").select("id", "g", "c", "size", F.col("c_").alias("u"))
    rows = materialize(rows, "blocked")
    units = materialize(rows.groupBy("g", "u").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("k")), "units")
    rows = rows.join(_small_side(units.withColumnsRenamed({"g": "g_", "u": "u_"})), (F.col("g") == F.col("g_")) & F.col("u").eqNullSafe(F.col("u_"))).select("id", "g", "c", F.struct("u", F.pmod(F.xxhash64("id"), "k").cast("int").alias("x")).alias("block"))
    blocks = units.select("g", "u", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("x")).select("g", F.struct("u", "x").alias("block"))
    # Pairs of blocks, not of documents; two blocks of one large component don't meet, nor does such a block meet itself.
    meet = blocks.withColumnRenamed("block", "p").join(blocks.withColumnRenamed("block", "q"), "g").filter("p <= q and not (p.u is not null and p.u <=> q.u)")
    sides = meet.select("g", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    each = rows.join(sides.withColumnsRenamed({"g": "g_", "block": "block_"}), (F.col("g") == F.col("g_")) & F.col("block").eqNullSafe(F.col("block_"))).select("g", "p", "q", "id", "c")
    each = each.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    return each.groupBy("g", "p", "q").applyInArrow(_linked_block, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    sig = materialize(signatures(documents), "signatures")
    # A class of equal sets is one vertex: its smallest doc_id.
    classes = sig.filter("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = classes.select(F.col("rep").alias("doc_id"))
    rows = sig.join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    leaders = rows.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    met = materialize(rows.join(leaders, "band").select("band", "id", "first"), "buckets")

    ids = materialize(met.select(F.col("id").alias("doc_id")).distinct(), "ids")
    texts = materialize(select_ids(with_texts(documents), ids, "doc_id"), "texts")

    # First round: each document meets one leader, the smallest.
    pairs = met.filter("id > first").groupBy(F.col("id").alias("b")).agg(F.min("first").alias("a"))
    edges = materialize(confirm(pairs.select("a", "b"), texts), "links")
    found = components(edges)
    for r in range(LEADER_ROUNDS):
        open_ = _open_buckets(met, found, r)
        pairs = open_.filter("c != lc").select(F.least("id", "li").alias("a"), F.greatest("id", "li").alias("b")).distinct()
        edges, found = _joined(edges, found, confirm(pairs, texts))
    open_ = _open_buckets(met, found, LEADER_ROUNDS)
    edges, found = _joined(edges, found, confirm(_small_pairs(open_), texts))
    open_ = _open_buckets(met, found, LEADER_ROUNDS).filter(F.col("n") > SMALL)
    if not open_.isEmpty():
        plausible = materialize(_plausible(open_, sig), "plausible")
        if not plausible.isEmpty():
            edges, found = _joined(edges, found, _block_links(plausible, found, texts))

    named = sig.join(classes, ["n_shingles", "f1", "f2"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("id"))
    out = named.join(found, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.select("*", (F.col("doc_id") == F.col("component_id")).alias("kept"))
