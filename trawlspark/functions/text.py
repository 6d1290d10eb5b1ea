"""White space, entities and the body hash, as plain functions."""

from __future__ import annotations

import re
from html.entities import html5

import numpy as np

#: Unicode White_Space, as the inside of a character class (fixed values).
SPACES = "\t-\r \x85\xa0  -     　"
_RUN = re.compile(f"[{SPACES}]+")
_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")

#: Fixed values of the 64-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Texts below which a loop over bytes is faster than one over positions.
FEW = 48


def split_spaces(text: str) -> list[str]:
    return [w for w in _RUN.split(text) if w]


def decode_entities(text: str) -> str:
    """Entities that end in a semicolon; anything else stays as written."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return html5.get(name + ";", m[0])
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


def collapse(text: str) -> str:
    """Entities decoded, runs of white space made one space, ends trimmed."""
    return " ".join(split_spaces(decode_entities(text)))


def fnv1a64(data: bytes) -> int:
    """The hash as Spark's long: the same 64 bits, signed."""
    h = FNV_BASIS
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def fnv1a64_many(texts: list[bytes]) -> np.ndarray:
    """The hashes of many texts at once, byte position by byte position; once few texts are left, one by one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    size, data = sizes[order], np.frombuffer(b"".join(texts), np.uint8)
    start = (np.cumsum(sizes) - sizes)[order]
    h = np.full(len(texts), FNV_BASIS, np.uint64)
    at, left = 0, len(texts)
    while True:
        left = int(np.searchsorted(-size[:left], -at, "left"))  # texts longer than at
        if left < FEW:
            break
        end = int(size[left - 1])  # up to there none of them ends
        for at in range(at, end):
            h[:left] = (h[:left] ^ data[start[:left] + at]) * np.uint64(FNV_PRIME)
        at = end
    for i in range(left):
        x = int(h[i])
        for b in texts[order[i]][at:]:
            x = ((x ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
        h[i] = x
    out = np.empty(len(texts), np.uint64)
    out[order] = h
    return out.view(np.int64)


def words_hash(words: list[str]) -> int | None:
    """The hash of the words joined by one space; None without words."""
    return fnv1a64(" ".join(words).encode()) if words else None
