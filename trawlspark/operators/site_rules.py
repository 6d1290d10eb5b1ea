"""Rules that compare pages: each is a join or an aggregate over the crawl tables, giving (url, detail), and page_id where the subject is a row of pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import SiteRule

c = F.col
Tables = dict[str, DataFrame]


def _shared(column: str, show: bool):
    """Pages that share a value with another page. Values are counted first, with partial sums, and the few repeated ones join back."""

    def find(t: Tables) -> DataFrame:
        pages = t["pages"].select("url", c("id").alias("page_id"), c(column).alias("v")).filter("v is not null")
        repeated = pages.groupBy("v").count().filter("count > 1").select("v")
        return pages.join(repeated, "v", "left_semi").select("url", "page_id", (c("v") if show else F.lit(None).cast("string")).alias("detail"))

    return find


def _redirect_loop(t: Tables) -> DataFrame:
    r = t["crawl_redirects"].filter(c("outcome").ilike("redirect loop%"))
    return r.select(c("source_url").alias("url"), F.when(c("chain").isNotNull(), F.concat(F.size("chain").cast("string"), F.lit(" hops"))).alias("detail"))


def _canonical_non_200(t: Tables) -> DataFrame:
    a, b = t["pages"].select("url", c("id").alias("page_id"), "canonical_url").filter("canonical_url is not null"), t["pages"].select(c("url").alias("target"), "status").filter("status != 200")
    return a.join(b, c("canonical_url") == c("target")).select("url", "page_id", F.concat(c("canonical_url"), F.lit(" returns "), c("status").cast("string")).alias("detail"))


def _canonical_chain(t: Tables) -> DataFrame:
    away = t["pages"].select("url", c("id").alias("page_id"), "canonical_url").filter("canonical_url != url")
    b = away.select(c("url").alias("middle"), c("canonical_url").alias("end"))
    return away.join(b, c("canonical_url") == c("middle")).select("url", "page_id", F.concat(F.lit("via "), c("middle"), F.lit(" to "), c("end")).alias("detail"))


def _linked_from(t: Tables, targets: DataFrame) -> DataFrame:
    """targets with linked, the distinct pages that link to them. Pairs are made distinct first, so a page linked from everywhere is
    counted in parts."""
    pairs = t["links"].select(c("target_url").alias("url"), "source_page_id").distinct().join(targets.select("url"), "url", "left_semi")
    return targets.join(pairs.groupBy("url").agg(F.count("*").alias("linked")), "url")


def _pages(n: Column) -> Column:
    return F.concat(F.lit("linked from "), n.cast("string"), F.lit(" page(s)"))


def _blocked(t: Tables) -> DataFrame:
    denied = t["crawl_failures"].filter(c("reason").ilike("robots.txt disallows%")).select("url")
    return _linked_from(t, denied).select("url", _pages(c("linked")).alias("detail"))


def _broken_image(t: Tables) -> DataFrame:
    return t["resources"].filter("status >= 400").select("url", F.concat(F.lit("returns "), c("status").cast("string")).alias("detail"))


def _oversized_image(t: Tables) -> DataFrame:
    return t["resources"].filter("status = 200 and content_length > 102400").select("url", F.concat(F.expr("content_length div 1024").cast("string"), F.lit(" KB")).alias("detail"))


def _broken_internal(t: Tables) -> DataFrame:
    broken = t["pages"].filter("status >= 400").select("url", c("id").alias("page_id"), "status")
    return _linked_from(t, broken).select("url", "page_id", F.concat(c("status").cast("string"), F.lit(", "), _pages(c("linked"))).alias("detail"))


def _orphan(t: Tables) -> DataFrame:
    linked = t["links"].select(c("target_url").alias("url")).filter("url is not null").distinct()  # the home page is one row, and not one from every page
    return t["pages"].filter("depth > 0").select("url", c("id").alias("page_id")).join(linked, "url", "left_anti").select("url", "page_id", F.lit(None).cast("string").alias("detail"))


SITE_RULES = (
    SiteRule("response.redirect-loop", "critical", "A redirect leads back to itself.", "Break the circle.", _redirect_loop),
    SiteRule("title.duplicate", "warning", "Several pages have the same title.", "Give each its own.", _shared("title", True)),
    SiteRule("description.duplicate", "warning", "Several pages have the same description.", "Give each its own.", _shared("meta_description", True)),
    SiteRule("content.duplicate-body", "warning", "Several pages have the same text.", "Merge them, or name one as canonical.", _shared("body_hash", False)),
    SiteRule("indexability.canonical-non-200", "critical", "The canonical page does not answer with 200.", "Name a page that does.", _canonical_non_200),
    SiteRule("indexability.canonical-chain", "warning", "The canonical page names yet another one.", "Name the last one.", _canonical_chain),
    SiteRule("indexability.blocked-but-linked", "warning", "The site links to what its robots.txt forbids.", "Allow it, or drop the links.", _blocked),
    SiteRule("media.broken-image", "warning", "An image is missing.", "Restore it, or drop it.", _broken_image),
    SiteRule("media.oversized-image", "notice", "An image is larger than 100 KB.", "Compress it.", _oversized_image),
    SiteRule("links.broken-internal", "warning", "The site links to a page that fails.", "Mend the page or the links.", _broken_internal),
    SiteRule("links.orphan-page", "notice", "No page links to this one.", "Link to it.", _orphan),
)


def site_findings(tables: Tables, rules: tuple[SiteRule, ...] = SITE_RULES) -> DataFrame:
    """(url, page_id, rule_id, severity, detail): page_id is null where the subject never became a page."""
    found = [(r, r.find(tables)) for r in rules]
    tagged = lambda r, df, *more: df.select("url", *more, F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), "detail")
    parts = [tagged(r, df, "page_id") for r, df in found if "page_id" in df.columns]
    others = [tagged(r, df) for r, df in found if "page_id" not in df.columns]
    if others:  # of their subjects, those that became pages are looked up
        ids = tables["pages"].select("url", c("id").alias("page_id"))
        parts.append(reduce(DataFrame.unionByName, others).join(ids, "url", "left"))
    columns = ("url", "page_id", "rule_id", "severity", "detail")
    return reduce(DataFrame.unionByName, (p.select(*columns) for p in parts))
