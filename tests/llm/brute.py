"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def shingles(text: str | None) -> frozenset:
    w = words(text, True)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_duplicates(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    sets, top = [(i, shingles(t)) for i, t in docs], {i: i for i, _ in docs}

    def find(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = find(a), find(b)
                top[max(u, v)] = min(u, v)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def remove_repeats(docs: list[tuple[int, str | None]], length: int = 35) -> list[tuple[int, int, int, str]]:
    split = [(i, words(t)) for i, t in docs]
    seen = collections.Counter(tuple(w[k : k + length]) for _, w in split for k in range(len(w) - length + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def base_counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    seen, covered = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
    for k in range(len(w) - 4):
        if seen[tuple(w[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def boilerplate(rows: list[tuple[str | None, str | None]], least: int) -> set[str]:
    """rows: (source, text). The lines that at least so many sites and distinct texts hold."""
    sites, texts = collections.defaultdict(set), collections.defaultdict(set)
    for source, text in rows:
        for line in (text or "").split("\n"):
            sites[line.strip(" \t\n\x0b\f\r")].add(source or "")
            texts[line.strip(" \t\n\x0b\f\r")].add(text)
    return {x for x in sites if x and len(sites[x]) >= least and len(texts[x]) >= least}


def without_lines(text: str | None, gone: set[str]) -> str | None:
    return text if text is None else "\n".join(x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r") not in gone)


def _weighted(w: list[str]) -> dict[tuple, int]:
    k = min(5, len(w))
    c = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return {s: n * sum(len(x.encode()) for x in s) for s, n in c.items()}


def contaminated(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> set[tuple[int, int]]:
    found = set()
    wanted = [(item, len(q), _weighted(q)) for item, q in ((item, words(text, True)) for item, text in items) if q]
    for i, t in docs:
        w = words(t, True)
        runs = {k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for k in {min(5, n, len(w)) for _, n, _ in wanted} if k}
        for item, size, want in wanted:
            k = min(5, size, len(w))
            if not k or runs[k].isdisjoint(want):
                continue  # nothing in common: similarity 0 everywhere
            for start in range(max(1, len(w) - size + 1)):
                have = _weighted(w[start : start + size])
                both = sum(min(have.get(s, 0), n) for s, n in want.items())
                if 100 * both >= 75 * (sum(have.values()) + sum(want.values()) - both):
                    found.add((i, item))
    return found
