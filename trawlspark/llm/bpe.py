"""Byte-level BPE by a table of distinct words.

1. Texts are split once into the tokenizer's words (its pre-tokenizer's pattern) by array
   operations on code points, and shuffled once in chunks of about CHUNK_BYTES of text: each
   chunk's distinct words with their numbers, and its documents as sequences of numbers.
   Both of the following steps read that one shuffle.
2. The chunks' words meet by a hash of the word, a packed row for each chunk and part of
   the table of distinct words. In each part every distinct word is encoded once.
3. The ids are joined back by position: by chunk and number to the places in its
   documents. The most frequent word is one entry for each chunk and not one for each
   occurrence, and no task holds more than a chunk, or the distinct words of one part.
4. Decoding joins every chunk's distinct ids with the table of pieces, which is as large
   as the vocabulary, and puts the pieces in the places of the ids.

The split follows this pattern (a fixed value of the tokenizer), alternatives in order:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
and added tokens such as <|endoftext|> are cut out of a text before it.

Defined results: null and empty texts have no ids; invalid UTF-8 counts as U+FFFD;
doc_id is carried along, so null and repeated ones come back as they are, each row with
its own text's ids; extra columns are ignored; an empty table gives no rows. Any length
of text works; a text is worked on as a whole.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow, release_memory, ship
from . import arrowtext as T
from .common import BROADCAST_IDS

#: Text of a chunk, at most (a longer document is a chunk of its own).
CHUNK_BYTES = 16 << 20
#: Ids of which a task decodes the documents together, about.
DECODED_IDS = 1 << 20
#: Text that is split at a time: every character takes some 60 bytes of arrays.
SPLIT_BYTES = 1 << 20
OTHER, LETTER, NUMBER, BLANK, ADDED = range(5)
#: Code points that \\s matches (fixed values: the White_Space property).
BLANK_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Letters and numbers of Unicode 16 (fixed values: the tokenizer knows them, Python's older database doesn't).
NEW_LETTERS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, from the Unicode database's general categories."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, ranges in ((BLANK, BLANK_RANGES), (LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for a, b in ranges:
            table[a : b + 1] = kind
    return table


class Split:
    """The words of a text column: text (all texts in one string), words (its distinct ones), at (each word's place among them), first (each document's first word)."""

    def __init__(self, column: pa.Array, added: tuple[str, ...] = ()):
        data, offsets = T.buffers(column)
        raw = data.tobytes()
        try:
            self.text = raw.decode("utf-8")
            at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        except UnicodeDecodeError:
            parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            self.text, at = "".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        c = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(c)
        kind = classes()[c]
        cut = np.zeros(n + 1, bool)  # where nothing joins what comes before
        cut[at] = True
        for token in added:
            i = self.text.find(token)
            while i >= 0:
                j = i + len(token)
                if not cut[i + 1 : j].any():  # within one document, and not within another added token
                    cut[i] = cut[j] = True
                    kind[i:j] = ADDED
                i = self.text.find(token, max(j, i + 1))
        begin = np.ones(n, bool)
        begin[1:] = kind[1:] != kind[:-1]
        begin |= cut[:-1]
        run = begin.copy()
        blank, space = kind == BLANK, c == 0x20
        # One space before a run of other characters belongs to it.
        joined = np.zeros(n, bool)
        joined[1:] = run[1:] & ~blank[1:] & space[:-1] & ~cut[1:-1]
        begin &= ~joined
        # The last of several blanks before something else stands apart (it may be that space).
        last = np.zeros(n, bool)
        last[:-1] = blank[:-1] & ~blank[1:] & ~cut[1:-1]
        begin |= last
        self._contractions(c, kind, begin, cut)
        self.starts = np.flatnonzero(begin)
        self.ends = np.append(self.starts[1:], n)[: len(self.starts)]
        self.first = np.searchsorted(self.starts, at)

    def distinct(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, and the place of each word among them."""
        data = np.frombuffer(self.text.encode("utf-8"), np.uint8)
        edge = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[np.append(self.starts, len(self.text))]  # words cover the text
        wide = len(data) >= 1 << 31
        column = pa.Array.from_buffers(pa.large_string() if wide else pa.string(), len(self.starts), [None, pa.py_buffer(edge.astype(np.int64 if wide else np.int32)), pa.py_buffer(data)])
        found = column.dictionary_encode()
        return found.dictionary, found.indices.to_numpy(zero_copy_only=False)

    @staticmethod
    def _contractions(c: np.ndarray, kind: np.ndarray, begin: np.ndarray, cut: np.ndarray) -> None:
        """'s 't 're 've 'm 'll 'd, where the apostrophe starts a word."""
        n = len(c)
        at = np.flatnonzero((c == 0x27) & begin)
        at = at[at + 1 < n]
        at = at[(kind[at] == OTHER) & ~cut[at + 1]]
        one = np.isin(c[at + 1], [ord(x) for x in "stmd"])
        third = np.minimum(at + 2, n - 1)
        pairs = (c[at + 1].astype(np.int64) << 32) | np.where((at + 2 < n) & ~cut[third], c[third], 0)
        two = np.isin(pairs, [(ord(a) << 32) | ord(b) for a, b in ("re", "ve", "ll")])
        for start, size in ((at[one], 2), (at[two], 3)):
            begin[start + 1] = False
            after = start + size
            after = after[after < n]
            begin[after[kind[after] == LETTER]] = True


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a piece stands for: printable ones for themselves, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """What a tokenizer's file says besides its merges. The driver reads it; tasks get its text by a broadcast as large as the vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.json = f.read()
        spec = json.loads(self.json)
        of = byte_of_char()
        self.pieces = {i: bytes(of[c] for c in piece) for piece, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        self.added = tuple(x["content"] for x in spec["added_tokens"])
        self.width = np.dtype("<u2") if max(self.pieces) < 1 << 16 else np.dtype("<u4")


SPLIT = "chunk long, seq int, docs array<long>, sizes array<int>, numbers binary, part int, lengths binary, data binary"
#: Of a part of a chunk's words: their numbers as steps, and packed ids with the number of ids of each.
CODED = "chunk long, numbers binary, lengths binary, data binary"


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as bytes: seven bits a byte, the last one below 128; compressed."""
    size = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in (1, 2, 3, 4))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(5):
        own = size > k
        out[(end - size)[own] + k] = (numbers[own] >> (7 * k)) & 127 | np.where(size[own] > k + 1, 128, 0)
    return _squeeze(out.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    data = np.frombuffer(_expand(packed), np.uint8)
    last = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)[: len(last)]
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        own = begin + k <= last
        out[own] |= (data[begin[own] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _strings(data: bytes, lengths: np.ndarray) -> pa.Array:
    edge = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(edge), pa.py_buffer(data)])


class _Chunk:
    """Documents as sequences of their words' numbers."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.held: list[tuple[list, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.seen = blake2b(digest_size=8)

    def name(self, part: int, n: int) -> int:
        """Tells the chunk from all others, also from what a repeated task would make of the same partition in another order."""
        self.seen.update(f"{part} {n}".encode())
        return int.from_bytes(self.seen.digest(), "big") >> 1

    def add(self, docs: list, s: Split, size: int) -> None:
        self.seen.update(s.text.encode())
        words, at = s.distinct()
        words = words.to_pylist()
        own = np.fromiter((self.number.setdefault(w, len(self.number)) for w in words), np.int32, len(words))
        self.held.append((docs, np.diff(s.first), own[at]))
        self.size += size

    def rows(self, chunk: int, parts: int) -> Iterator[pa.RecordBatch]:
        """Rows of SPLIT: of documents (seq), then of words (part of the table by crc32). Numbers are by frequency, so that they pack well."""
        words = list(self.number)
        seen = np.zeros(len(words), np.int64)
        for _, _, own in self.held:
            seen += np.bincount(own, minlength=len(words))
        order = np.argsort(-seen, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        row = dict.fromkeys(x.split()[0] for x in SPLIT.split(", ")) | {"chunk": chunk}
        out = [row | {"seq": k, "docs": docs, "sizes": sizes.tolist(), "numbers": pack(rank[own])} for k, (docs, sizes, own) in enumerate(self.held)]
        data = [words[i].encode() for i in order.tolist()]
        part = np.fromiter((zlib.crc32(x) % parts for x in data), np.int64, len(data))
        by_part = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[by_part], np.arange(parts + 1))
        for k in range(parts):
            own = by_part[edge[k] : edge[k + 1]]  # ascending numbers
            if len(own):
                mine = [data[i] for i in own.tolist()]
                out.append(row | {"part": k, "numbers": pack(np.diff(own, prepend=0)), "lengths": pack(np.array([len(x) for x in mine])), "data": _squeeze(b"".join(mine))})
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary(), pa.binary())
        for r in out:
            yield pa.RecordBatch.from_arrays([pa.array([r[c]], kind) for c, kind in zip(row, kinds, strict=True)], list(row))


def split(documents: DataFrame, tokenizer: Tokenizer, chunk_bytes: int = CHUNK_BYTES, parts: int | None = None) -> DataFrame:
    """Rows of SPLIT. Of documents: docs (doc_id), sizes (words of each), numbers (of all their words, in order). Of a part of the chunk's distinct
    words: numbers (ascending, as steps), lengths and data (the words, one after another)."""
    added, parts = tokenizer.added, parts or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, _Chunk()
        for batch in T.slices(batches, SPLIT_BYTES):
            size = int(T.buffers(batch.column("text"))[1][-1])
            if held.held and held.size + size > chunk_bytes:
                yield from held.rows(held.name(part, n), parts)
                n, held = n + 1, _Chunk()
            held.add(batch.column("doc_id").to_pylist(), Split(batch.column("text"), added), size)
        if held.held:
            yield from held.rows(held.name(part, n), parts)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_arrow(texts, run, SPLIT)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.filter(batch.column("part").is_valid())
        if own.num_rows:
            yield own.select(["chunk", "numbers", "part", "lengths", "data"])


def encode_words(words: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """The chunks' words (rows of SPLIT with part) as rows of CODED: each part of the table is one task's, which encodes a distinct word once."""
    shared, width = words.sparkSession.sparkContext.broadcast(tokenizer.json), tokenizer.width

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        t = Library.from_str(shared.value)
        t.no_padding()
        t.no_truncation()
        table: dict[str, bytes] = {}
        part = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, table = row["part"], {}
                own = _strings(_expand(row["data"]), unpack(row["lengths"])).to_pylist()
                new = [w for w in own if w not in table]
                for k in range(0, len(new), 2000):
                    table.update(zip(new[k : k + 2000], (np.array(e.ids, width).tobytes() for e in t.encode_batch_fast(new[k : k + 2000], add_special_tokens=False)), strict=True))
                ids = [table[w] for w in own]
                counts = np.array([len(x) // width.itemsize for x in ids], np.int64)
                values = ([row["chunk"]], pa.int64()), ([row["numbers"]], pa.binary()), ([pack(counts)], pa.binary()), ([_squeeze(b"".join(ids))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in values], ["chunk", "numbers", "lengths", "data"])

    return map_arrow(words.repartition("part").sortWithinPartitions("part"), encode, CODED)


def _documents(coded: pa.Table, rows: pa.Table, width: np.dtype) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """From a chunk's rows of CODED and its documents' rows of SPLIT: doc_ids, ids of all these documents, and the number of ids of each."""
    every = [(np.cumsum(unpack(r["numbers"])), unpack(r["lengths"]), np.frombuffer(_expand(r["data"]), width)) for r in coded.to_pylist()]
    rows = rows.filter(rows.column("seq").is_valid())
    number, counts, flat = (np.concatenate(x) for x in zip(*every, strict=True)) if every else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, width))
    size, start = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    size[number], start[number] = counts, np.cumsum(counts) - counts
    for row in rows.sort_by("seq").to_pylist():
        at = unpack(row["numbers"])
        if len(at) and at.max() >= len(size):
            raise ValueError("a chunk came without its words: its input had another order when it was read again")
        n, first = size[at], np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
        ids = flat[T.ranges(start[at], n)]
        yield row["docs"], ids, np.diff(np.concatenate([[0], np.cumsum(n)])[first])


def _cut(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary value of each document's ids."""
    edge = np.concatenate([[0], np.cumsum(counts)]) * ids.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def _joined(documents: DataFrame, tokenizer: Tokenizer, finish: Callable, schema: str, chunk_bytes: int) -> DataFrame:
    """What finish makes of each part of a chunk (see _documents) when the words' ids have been joined back."""
    # One exchange for both uses: neither a filter nor a projection stands between it and the functions, so the plans of both are the same.
    rows = split(documents, tokenizer, chunk_bytes).repartition("chunk")
    coded = encode_words(map_arrow(rows, _words, "chunk long, numbers binary, part int, lengths binary, data binary"), tokenizer)
    width = tokenizer.width

    def run(coded: pa.Table, rows: pa.Table) -> pa.Table:
        try:
            return pa.Table.from_batches([b for part in _documents(coded, rows, width) for b in finish(*part)])
        finally:
            release_memory()

    ship(documents.sparkSession)
    return coded.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(run, schema)


def encode(documents: DataFrame, tokenizer_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned integers of 2 bytes, or 4 for a vocabulary beyond 65536)."""

    def finish(docs: list, ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), _cut(ids, counts)], ["doc_id", "ids"])

    return _joined(documents, Tokenizer(tokenizer_path), finish, "doc_id long, ids binary", chunk_bytes)


#: Rows that ask for pieces: part (told apart within a task's stream by its change), id; then its documents, with a null id.
ASKED = "part int, id int, doc_id long, ids binary"


def _asking(docs: list, ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ASKED for some documents: their distinct ids, then the documents."""
    wanted = np.unique(ids)
    part = int(counts.sum() % (1 << 31))
    nulls = lambda n, kind: pa.nulls(n, kind)
    names = ["part", "id", "doc_id", "ids"]
    # A row in front, without an id or ids, says that a new part starts.
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([-1], pa.int32()), nulls(1, pa.int64()), nulls(1, pa.binary())], names)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(wanted), part, np.int32)), pa.array(wanted.astype(np.int32)), nulls(len(wanted), pa.int64()), nulls(len(wanted), pa.binary())], names)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), part, np.int32)), nulls(len(docs), pa.int32()), pa.array(docs, pa.int64()), _cut(ids, counts)], names)


class Pieces:
    """The pieces that were joined for the current part."""

    def __init__(self) -> None:
        self.fill(np.zeros(0, np.int64), b"", np.zeros(1, np.int64))

    def fill(self, ids: np.ndarray, data: bytes, edge: np.ndarray) -> None:
        size = int(ids.max()) + 1 if len(ids) else 0
        self.data = np.frombuffer(data, np.uint8)
        self.sizes, self.starts = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.sizes[ids], self.starts[ids] = np.diff(edge), edge[:-1]

    def decode(self, ids: np.ndarray) -> str:
        size = self.sizes[ids]  # an id that was not joined is beyond the table or below
        if len(size) and size.min() < 0:
            raise ValueError("an id came without its piece")
        return self.data[T.ranges(self.starts[ids], size)].tobytes().decode("utf-8", "replace")


def _put_together(width: np.dtype) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held, last = Pieces(), [], None  # held: the current part's pieces that aren't filled in yet
        for batch in batches:
            id_ = batch.column("id")
            kind = np.where(id_.is_null().to_numpy(zero_copy_only=False), 2, np.where(id_.fill_null(0).to_numpy(zero_copy_only=False) < 0, 0, 1))
            cuts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]]) if len(kind) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    held, last = [], rows.column("part")[b - a - 1].as_py()
                elif kind[a] == 1:
                    held.append(rows.select(["id", "piece"]))
                else:
                    if rows.column("part")[0].as_py() != last:
                        raise ValueError("documents came without their pieces")
                    if held:
                        table = pa.Table.from_batches(held)
                        data, edge = T.buffers(table.column("piece").cast(pa.large_binary()))
                        pieces.fill(table.column("id").to_numpy().astype(np.int64), data.tobytes(), edge)
                        held = []
                    for some in T.slices([rows], DECODED_IDS * width.itemsize, ("ids",)):
                        ids = [np.frombuffer(x, width) for x in some.column("ids").to_pylist()]
                        columns = [some.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([pieces.decode(x) for x in ids], pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "text"])

    return run


def _with_pieces(asked: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """The join of ids with pieces, and the texts: doc_id, n_tokens, ids, text."""
    if len(tokenizer.pieces) > BROADCAST_IDS:
        raise ValueError("a vocabulary beyond a million pieces is not broadcast")
    table = pa.table({"id": pa.array(list(tokenizer.pieces), pa.int32()), "piece": pa.array(list(tokenizer.pieces.values()), pa.binary())})
    # The broadcast side is the vocabulary (checked); the other side streams through in its order, so a part's pieces come before its documents.
    j = asked.join(F.broadcast(asked.sparkSession.createDataFrame(table)), "id", "left").select("part", "id", "piece", "doc_id", "ids")
    return map_arrow(j, _put_together(tokenizer.width), "doc_id long, n_tokens long, ids binary, text string")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (4-byte unsigned integers, little-endian), text (decoded)."""
    tokenizer = Tokenizer(tokenizer_path)
    width = tokenizer.width

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, DECODED_IDS * width.itemsize, ("ids",)):
            data, edge = T.buffers(batch.column("ids"))
            yield from _asking(batch.column("doc_id").to_pylist(), np.frombuffer(data.tobytes(), width), np.diff(edge) // width.itemsize)

    return _with_pieces(map_arrow(encoded.select("doc_id", "ids"), ask, ASKED), tokenizer)


def round_trip(documents: DataFrame, tokenizer_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """decode(encode(documents)) with one Python stage less: doc_id, n_tokens, ids (4 bytes each), text (decoded)."""
    tokenizer = Tokenizer(tokenizer_path)
    return _with_pieces(_joined(documents, tokenizer, _asking, ASKED, chunk_bytes), tokenizer)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, each taken from the operator's ids and decoded text."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
