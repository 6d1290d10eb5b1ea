"""One tolerant pass over a page's markup into the fields of a page record.

The tokenizer never fails: an unclosed tag or a stray "<" is text. Elements are kept on
a stack; an end tag closes everything down to its start tag, or nothing if there is none.
Attribute values are as written; text of title, description, headings and links is
decoded and collapsed; words are counted in the undecoded text of an explicit body.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .text import collapse, split_spaces, words_hash
from .urls import resolve

#: Fixed values of HTML: elements without end tag, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("title textarea script style xmp iframe noembed noframes noscript".split())
_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|</?[A-Za-z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[!?/][^>]*>", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)
ROBOTS = ("noindex", "nofollow", "noarchive", "nosnippet")


@dataclass
class Markup:
    title: str | None = None
    title_count: int = 0
    meta_description: str | None = None
    h1: list[str] = field(default_factory=list)
    h2: list[str] = field(default_factory=list)
    canonical: str | None = None
    canonical_url: str | None = None
    robots: set[str] = field(default_factory=set)
    hreflang: list[dict] = field(default_factory=list)
    open_graph: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)
    words: list[str] = field(default_factory=list)

    @property
    def body_hash(self) -> int | None:
        return words_hash(self.words)


def robots_directives(content: str) -> set[str]:
    """The directives of a robots meta tag: "none" stands for noindex and nofollow, others are ignored."""
    named = {x.strip().lower() for x in content.split(",")}
    return {d for d in ROBOTS if d in named} | ({"noindex", "nofollow"} if "none" in named else set())


def _attributes(tag: str) -> dict[str, str]:
    """Names in lower case; the first of equal names counts; a value-less one is empty."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag, _NAME.match(tag).end(), len(tag) - 1):
        out.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
    return out


def extract(html: str, url: str) -> Markup:
    m, stack, at, in_link, title_open = Markup(), [], 0, False, False
    opened: dict[str, int] = {}

    def text(s: str) -> None:
        if not s:
            return
        if title_open and opened.get("title"):
            m.title += s
        for name, got in (("h1", m.h1), ("h2", m.h2)):
            if opened.get(name) and got:
                got[-1] += s
        if opened.get("a") and in_link and m.links:
            m.links[-1]["text"] += s
        if opened.get("body") and not opened.get("script") and not opened.get("style"):
            m.words += split_spaces(s)

    def close(name: str) -> None:
        nonlocal title_open
        if not opened.get(name):
            return
        while True:
            top = stack.pop()
            opened[top] -= 1
            if top == "title":
                title_open = False
            if top == name:
                return

    while at < len(html):
        found = _TAG.search(html, at)
        if not found:
            break
        text(html[at : found.start()])
        tag, at = found[0], found.end()
        named = _NAME.match(tag)
        if not named:
            continue  # comments and declarations
        name = named[1].lower()
        if tag[1] == "/":
            close(name)
            continue
        a = _attributes(tag)
        if name == "title":
            m.title_count += 1
            if m.title is None:
                m.title, title_open = "", True
        elif name == "meta":
            kind, content = a.get("name", "").lower(), a.get("content", "")
            if kind == "description" and m.meta_description is None:
                m.meta_description = content
            elif kind in ("robots", "googlebot"):
                m.robots |= robots_directives(content)
            if (prop := a.get("property", "").lower()).startswith("og:"):
                m.open_graph.append({"name": prop[3:], "value": content})
        elif name == "link":
            rel = split_spaces(a.get("rel", "").lower())
            if "canonical" in rel and m.canonical is None:
                m.canonical = a.get("href", "")
            if "alternate" in rel and "hreflang" in a:
                m.hreflang.append({"lang": a["hreflang"].lower(), "href": a.get("href", "")})
        elif name in ("h1", "h2"):
            getattr(m, name).append("")
        elif name == "a":
            in_link = "href" in a
            if in_link:
                m.links.append({"href": a["href"], "target": None, "text": "", "nofollow": "nofollow" in split_spaces(a.get("rel", "").lower())})
        elif name == "img":
            m.images.append({"src": a.get("src", ""), "alt": a.get("alt")})
        if name in VOID:
            continue
        stack.append(name)
        opened[name] = opened.get(name, 0) + 1
        if name in RAW_TEXT:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else len(html)
            text(html[at:stop])
            at = stop
    text(html[at:])

    m.title = None if m.title is None else collapse(m.title)
    m.meta_description = None if m.meta_description is None else collapse(m.meta_description)
    m.h1, m.h2 = [collapse(x) for x in m.h1], [collapse(x) for x in m.h2]
    m.canonical_url = None if m.canonical is None else resolve(url, m.canonical)
    for link in m.links:
        link["target"], link["text"] = resolve(url, link["href"]), collapse(link["text"])
        link["nofollow"] = link["nofollow"] or "nofollow" in m.robots
    return m
