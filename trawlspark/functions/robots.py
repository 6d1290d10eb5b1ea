"""robots.txt: groups, the longest matching rule, crawl delay and sitemaps."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache


@dataclass
class Rules:
    rules: list[tuple[str, bool]] = field(default_factory=list)  # pattern, allowed
    crawl_delay: float | None = None
    sitemaps: list[str] = field(default_factory=list)
    everything: bool | None = None  # allowed or denied as a whole, by the file's status

    def allows(self, path: str) -> bool:
        """The longest pattern that matches decides, an Allow before a Disallow of equal length; no match allows."""
        if self.everything is not None:
            return self.everything
        hits = [(len(p), ok) for p, ok in self.rules if _pattern(p).match(path)]
        return max(hits)[1] if hits else True


@lru_cache(4096)
def _pattern(rule: str) -> re.Pattern:
    end = rule.endswith("$")
    body = ".*".join(re.escape(x) for x in (rule[:-1] if end else rule).split("*"))
    return re.compile(body + (r"\Z" if end else ""), re.S)


def parse(text: str, agent: str) -> Rules:
    """The rules of the agent's own groups, or of the "*" groups if it has none."""
    out, groups, names, open_ = Rules(), {}, [], False
    for line in text.removeprefix("﻿").splitlines():
        key, colon, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "sitemap" and value:
            out.sitemaps.append(value)
        elif key == "user-agent":
            names = names if open_ else []
            names.append(value.lower())
            groups.setdefault(value.lower(), [])
            open_ = True
        elif key in ("allow", "disallow", "crawl-delay"):
            open_ = False
            for n in names:
                groups[n].append((key, value))
    own = next((g for n, g in groups.items() if n and n != "*" and n in agent.lower()), groups.get("*", []))
    for key, value in own:
        if key == "crawl-delay":
            if re.fullmatch(r"\d+(\.\d+)?", value):
                out.crawl_delay = float(value)
        elif value:
            out.rules.append((value, key == "allow"))
    return out


def from_response(status: int, body: str | None, agent: str) -> Rules:
    """2xx: the file's rules. 5xx: nothing is allowed. Anything else: everything is."""
    if 200 <= status < 300:
        return parse(body or "", agent)
    return Rules(everything=not 500 <= status < 600)
