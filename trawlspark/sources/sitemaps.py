"""Sitemap files: what they list, and which files to read."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.text import decode_entities
from ..functions.urls import canonical_url

MAX_LOCATIONS, MAX_FILES = 50_000, 50
#: Where a sitemap is looked for if robots.txt names none (fixed values).
GUESSES = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml", "/sitemap/0")
_LOC = re.compile(r"<(?:(\w+):)?loc(?:\s[^>]*)?>\s*(?:<!\[CDATA\[(.*?)\]\]>|(.*?))\s*</(?:\w+:)?loc\s*>", re.S | re.I)
_MEDIA = frozenset(("image", "video", "news"))


@dataclass
class Sitemap:
    locations: list[str] = field(default_factory=list)
    is_index: bool = False
    truncated: bool = False


def parse(xml: str, limit: int = MAX_LOCATIONS) -> Sitemap:
    """The <loc> of pages or of further sitemaps, repeats kept; those of images, videos and news are not pages. truncated only if more follow."""
    out = Sitemap(is_index=bool(re.search(r"<(?:\w+:)?sitemapindex[\s>]", xml, re.I)))
    for m in _LOC.finditer(xml):
        if (m[1] or "").lower() in _MEDIA:
            continue
        if len(out.locations) >= limit:
            out.truncated = True
            break
        where = (m[2] if m[2] is not None else decode_entities(m[3])).strip()
        if where:
            out.locations.append(where)
    return out


def discover(origin: str, declared: list[str], fetch: Callable[[str], tuple[int, str] | None]) -> tuple[list[dict], list[tuple[str, str]]]:
    """Sitemap files read (rows of the sitemaps table) and (url, source) pairs, first file wins.

    Files that robots.txt declares are read, else guesses; what an index lists is read next. The file that was put in line last comes
    first. MAX_FILES files at most; those beyond are left out, and the last one read is marked as truncated. A guess that lists nothing leaves
    no row, and the first one that does ends the guessing. A file that doesn't answer has status 0.
    """
    line = [(u, "robots") for u in map(canonical_url, declared) if u] or [(origin.rstrip("/") + g, "guess") for g in GUESSES]
    files, listed, seen = [], {}, set()
    while line:
        url, by = line.pop()
        if url in seen:
            continue
        if len(files) >= MAX_FILES:
            files[-1]["truncated"] = True
            break
        seen.add(url)
        status, body = fetch(url) or (0, "")
        found = parse(body)
        if by == "guess":
            if not found.locations:
                continue
            line = [x for x in line if x[1] != "guess"]
        files.append({"url": url, "status": status, "urls": len(found.locations), "is_index": found.is_index, "found_by": by, "truncated": found.truncated})
        if found.is_index:
            line += [(u, url) for u in map(canonical_url, found.locations) if u]
        else:
            for u in found.locations:
                listed.setdefault(u, url)
    return files, list(listed.items())
