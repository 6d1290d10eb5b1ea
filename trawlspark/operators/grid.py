"""The grid query: a closed set of filters, sorts that go with them, and windows.

A filter is a value, never text that reaches a SQL parser. A sort is only made through
``SortSpec``, which refuses the pairs of filter and sort that the API does not offer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KINDS
from ..functions.urls import percent_encode_needle

MAX_WINDOW = 1000
OPERATORS = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__"}
SORT_COLUMNS = ("url", "status", "depth", "size", "word_count", "elapsed_ms", "title", "meta_description")
#: Sorts that go with any filter but a substring (fixed values of the API, as are the next two).
ALWAYS = frozenset(("url", "status", "depth", "size", "title"))
#: Filters that, as an equality, also go with these sorts.
EQUAL = {f: frozenset(("word_count", "elapsed_ms")) for f in ("status", "kind", "noindex", "depth", "has_issue")}
EQUAL["has_issue"] |= {"meta_description"}
GRID = ("id", "url", "status", "depth", "size", "kind", "noindex", "word_count", "elapsed_ms", "title", "meta_description", "canonical")


class UnsupportedPair(ValueError):
    pass


class UnknownRule(ValueError):
    pass


@dataclass(frozen=True)
class Filter:
    """kind: status, depth, word_count, kind, noindex, has_issue or url_contains; op only for the first three."""

    kind: str
    value: object = None
    op: str = "eq"

    def __post_init__(self):
        if self.kind not in ("status", "depth", "word_count", "kind", "noindex", "has_issue", "url_contains"):
            raise ValueError(f"unknown filter: {self.kind}")
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator: {self.op}")
        if self.kind == "kind" and self.value not in KINDS:
            raise ValueError(f"unknown kind: {self.value}")

    @property
    def shape(self) -> str:
        if self.kind == "url_contains":
            return "substring"
        if self.kind == "has_issue":
            return "equality" if self.value is None else "exists"
        return "range" if self.op != "eq" else "equality"

    def supports(self, sort: str) -> bool:
        """Whether the API offers this filter with this sort."""
        if self.shape == "substring":
            return sort == "url"
        if self.shape == "exists":
            return sort != "word_count"
        return sort == self.kind or sort in ALWAYS or (self.shape == "equality" and sort in EQUAL.get(self.kind, ()))

    def column(self) -> Column:
        if self.kind == "url_contains":
            # Wildcards in the needle keep their meaning; case doesn't matter; no character escapes.
            needle = percent_encode_needle(str(self.value)).replace("\\", "\\\\")
            return F.col("url").ilike(f"%{needle}%")
        if self.kind == "has_issue":
            return F.col("has_issue")
        return getattr(F.col(self.kind), OPERATORS[self.op])(F.lit(self.value))


@dataclass(frozen=True)
class SortSpec:
    column: str
    descending: bool = False
    filters: tuple[Filter, ...] = ()

    def __post_init__(self):
        if self.column not in SORT_COLUMNS:
            raise ValueError(f"unknown sort: {self.column}")
        for f in self.filters:
            if not f.supports(self.column):
                raise UnsupportedPair(f"{f.kind} with a sort by {self.column}")

    def order(self) -> list[Column]:
        """The column and then id, in the same direction; nulls first when ascending, last when descending."""
        return [F.col(c).desc_nulls_last() if self.descending else F.col(c).asc_nulls_first() for c in (self.column, "id")]


    def after(self, value: object, id_: int) -> Column:
        """The rows that come after the one with this value and id: where a further window starts, at no cost for what came before."""
        own, later = F.col(self.column), F.col("id") < id_ if self.descending else F.col("id") > id_
        if value is None:
            return own.isNull() & later if self.descending else own.isNotNull() | later
        beyond = (own < F.lit(value)) | own.isNull() if self.descending else own > F.lit(value)
        return F.coalesce(beyond, F.lit(False)) | F.coalesce((own == F.lit(value)) & later, F.lit(False))


def supported_sorts(filters: tuple[Filter, ...]) -> list[str]:
    return [s for s in SORT_COLUMNS if all(f.supports(s) for f in filters)]


def matching(pages: DataFrame, filters: tuple[Filter, ...], issues: DataFrame | None = None, rules: frozenset[str] | None = None) -> DataFrame:
    """The pages that all filters match."""
    plain = [f.column() for f in filters if f.shape != "exists"]
    out = pages.filter(reduce(and_, plain)) if plain else pages
    for f in filters:
        if f.shape == "exists":
            if rules is not None and f.value not in rules:
                raise UnknownRule(str(f.value))
            hits = issues.filter(F.col("rule_id") == f.value).select(F.col("page_id").alias("id"))
            out = out.join(hits, "id", "left_semi")
    return out


def window(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """limit rows (1000 at most) from offset on: a top-k, which never sorts all rows. It holds offset + limit rows, so far-off windows had better
    start after a known row (SortSpec.after)."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(0, min(limit, MAX_WINDOW)))


def grid_window(pages: DataFrame, sort: SortSpec, offset: int = 0, limit: int = 100, issues: DataFrame | None = None, detail: DataFrame | None = None, after: tuple[object, int] | None = None) -> DataFrame:
    """The grid's columns of a window; with detail, first headings and their numbers, joined after the window is cut. after: value of the sort column and
    id of the row before the window."""
    found = matching(pages, sort.filters, issues).select(*GRID)
    rows = window(found if after is None else found.filter(sort.after(*after)), sort.order(), offset, limit)
    if detail is None:
        return rows
    heads = detail.select(F.col("page_id").alias("id"), F.get("h1", F.lit(0)).alias("h1"), F.get("h2", F.lit(0)).alias("h2"), F.size("h1").alias("h1_count"), F.size("h2").alias("h2_count"))
    j = rows.join(heads, "id", "left")
    return j.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("h1_count", "h2_count")})


def query_rows(pages: DataFrame, sort: SortSpec, offset: int = 0, limit: int = 100, issues: DataFrame | None = None) -> tuple[DataFrame, int]:
    """A window and the number of all matching rows."""
    return grid_window(pages, sort, offset, limit, issues), matching(pages, sort.filters, issues).count()


def filters_from_view(status_class: str | None = None, kind: str | None = None, indexable: str | None = None, max_depth: int | None = None, needle: str = "") -> tuple[Filter, ...]:
    """The filter bar's state as filters: a status class ("2" to "5", or "bad" for 400 and above) is a pair of bounds."""
    out: list[Filter] = []
    if status_class == "bad":
        out.append(Filter("status", 400, "ge"))
    elif status_class:
        low = int(status_class) * 100
        out += [Filter("status", low, "ge"), Filter("status", low + 99, "le")]
    if kind:
        out.append(Filter("kind", kind))
    if indexable:
        out.append(Filter("noindex", indexable == "no"))
    if max_depth is not None:
        out.append(Filter("depth", max_depth, "le"))
    if needle.strip():
        out.append(Filter("url_contains", needle.strip()))
    return tuple(out)
