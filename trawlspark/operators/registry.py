"""The rule registry: rules are declared once, checked for shape, and run together."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

SHAPE = re.compile(r"[a-z]+\.[a-z0-9-]+")
MOST_RULES = 30


class RegistryError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    description: str
    remedy: str


@dataclass(frozen=True)
class PageRule(Rule):
    """details: an array column with one text (or null) for each finding on a page, null for none."""

    details: Callable[[], Column] = None
    html_only: bool = True


@dataclass(frozen=True)
class SiteRule(Rule):
    """find: from the crawl tables to a DataFrame (url, detail), with page_id where the rule knows it."""

    find: Callable[[dict[str, DataFrame]], DataFrame] = None


@dataclass
class Registry:
    page_rules: list[PageRule] = field(default_factory=list)
    site_rules: list[SiteRule] = field(default_factory=list)

    @property
    def rules(self) -> list[Rule]:
        return [*self.page_rules, *self.site_rules]

    def add(self, rule: Rule) -> None:
        if not SHAPE.fullmatch(rule.id):
            raise RegistryError(f"not a rule id: {rule.id!r}")
        if any(r.id == rule.id for r in self.rules):
            raise RegistryError(f"registered twice: {rule.id}")
        if len(self.rules) >= MOST_RULES:
            raise RegistryError(f"more than {MOST_RULES} rules")
        (self.site_rules if isinstance(rule, SiteRule) else self.page_rules).append(rule)

    def get(self, rule_id: str) -> Rule:
        for rule in self.rules:
            if rule.id == rule_id:
                return rule
        raise RegistryError(f"unknown rule: {rule_id}")
