"""The named views: filters, columns and sort of each, and the columns derived from a page's address and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import crumbs, url_notes, url_params
from .grid import Filter, SortSpec, filters_from_view, matching

c = F.col
DERIVED = {
    "title_length": lambda: F.char_length("title"), "description_length": lambda: F.char_length("meta_description"), "title_over": lambda: F.char_length("title") > 60, "description_over": lambda: F.char_length("meta_description") > 155,
    "url_length": lambda: F.char_length("url"), "url_long": lambda: F.char_length("url") > 115, "url_params": lambda: url_params(c("url")), "url_notes": lambda: F.array_join(url_notes(c("url")), ", "),
}
_HTML = filters_from_view(kind="html")
#: view: (filters, columns); images and sitemap read their own tables.
VIEWS: dict[str, tuple[tuple[Filter, ...], tuple[str, ...]]] = {
    "all": ((), ("status", "url", "title", "word_count", "depth", "size")),
    "urls": ((), ("status", "url", "url_length", "url_params", "url_notes")),
    "titles": (_HTML, ("status", "url", "title", "title_length", "word_count")),
    "descriptions": (_HTML, ("status", "url", "meta_description", "description_length")),
    "headings": (_HTML, ("status", "url", "h1", "h1_count", "h2_count", "word_count")),
    "duplicates": (_HTML, ("status", "url", "title", "meta_description")),
    "canonicals": (_HTML, ("status", "url", "canonical", "noindex")),
    "broken": (filters_from_view(status_class="bad"), ("status", "url", "title", "depth")),
    "redirects": (filters_from_view(status_class="3"), ("status", "url", "title", "depth")),
    "noindex": (filters_from_view(indexable="no"), ("status", "url", "title", "canonical")),
    "slowest": ((), ("status", "url", "elapsed_ms", "size")),
    "images": ((), ("status", "url", "content_length", "content_type", "issues")),
    "sitemap": ((), ("url", "status", "source")),
}
#: Rules whose pages are shown side by side: sorted by what they share.
GROUP_BY = {"title.duplicate": "title", "description.duplicate": "meta_description"}


def selection_filters(rule_id: str) -> tuple[Filter, ...]:
    """The filter behind a line of the panel: "*" stands for any finding."""
    return (Filter("has_issue", None if rule_id == "*" else rule_id),)


def view_sort(view: str, rule_id: str | None = None) -> SortSpec:
    if view == "slowest":
        return SortSpec("elapsed_ms", True, VIEWS[view][0])
    if rule_id in GROUP_BY:
        return SortSpec(GROUP_BY[rule_id], False, selection_filters(rule_id))
    return SortSpec("url", False, VIEWS[view][0])


def view_rows(t: dict[str, DataFrame], view: str) -> DataFrame:
    """All rows of a view with its columns, in no order (see view_sort)."""
    from .lookups import resource_rows, sitemap_rows

    filters, columns = VIEWS[view]
    if view == "images":
        return resource_rows(t).select(*columns)
    if view == "sitemap":
        return sitemap_rows(t).select(*columns)
    rows = matching(t["pages"], filters, t.get("issues"))
    if view == "headings":
        heads = t["page_detail"].select(c("page_id").alias("id"), F.get("h1", F.lit(0)).alias("h1"), F.size("h1").alias("h1_count"), F.size("h2").alias("h2_count"))
        rows = rows.join(heads, "id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("h1_count", "h2_count")})
    return rows.select(*(DERIVED[x]().alias(x) if x in DERIVED else c(x) for x in columns))


def search_preview(pages: DataFrame) -> DataFrame:
    """How a search result would show each page: crumbs, title or else address, description unless snippets are refused."""
    snippet = F.when(~c("nosnippet"), F.coalesce(F.nullif("meta_description", F.lit("")), F.lit("No description.")))
    return pages.select("id", crumbs(c("url")).alias("crumbs"), F.coalesce(F.nullif("title", F.lit("")), c("url")).alias("headline"), snippet.alias("snippet"))
