"""Links, details, the folder tree, resources and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
MAX_LINKS, MAX_CHILDREN = 100, 500
Tables = dict[str, DataFrame]


def outlinks_of(t: Tables, page_id: int, limit: int = MAX_LINKS) -> DataFrame:
    """A page's links in document order with the status of what they lead to."""
    own = t["links"].filter(c("source_page_id") == page_id).orderBy("id").limit(limit)
    status = t["pages"].select(c("url").alias("target_url"), "status", c("id").alias("target_id"))
    return own.join(status, "target_url", "left").select("id", F.coalesce("target_url", "href").alias("url"), "anchor_text", "nofollow", "status", "target_id")


def inlinks_of(t: Tables, page_id: int, limit: int = MAX_LINKS) -> DataFrame:
    url = t["pages"].filter(c("id") == page_id).select(c("url").alias("target_url"))
    own = t["links"].join(url, "target_url", "left_semi").orderBy("id").limit(limit)
    return own.join(t["pages"].select(c("id").alias("source_page_id"), "url", "status"), "source_page_id").select("id", "url", "anchor_text", "nofollow", "status")


def inlink_counts(t: Tables) -> DataFrame:
    """id, url, inlinks, outlinks of every page."""
    into = t["links"].groupBy(c("target_url").alias("url")).agg(F.count("*").alias("inlinks"))
    out = t["links"].groupBy(c("source_page_id").alias("id")).agg(F.count("*").alias("outlinks"))
    j = t["pages"].select("id", "url").join(into, "url", "left").join(out, "id", "left")
    return j.select("id", "url", F.coalesce("inlinks", F.lit(0)).alias("inlinks"), F.coalesce("outlinks", F.lit(0)).alias("outlinks"))


def link_targets(t: Tables) -> DataFrame:
    """Every link with the status of its target, null if it was not crawled."""
    status = t["pages"].select(c("url").alias("target_url"), "status")
    return t["links"].join(status, "target_url", "left").select("id", "source_page_id", "target_url", "status")


def page_issues(t: Tables, page_id: int) -> DataFrame:
    """A page's findings in the order of severity (as text) and rule."""
    return t["issues"].filter(c("page_id") == page_id).select("rule_id", "severity", "detail").orderBy("severity", "rule_id")


def page_detail(t: Tables, page_id: int) -> DataFrame | None:
    """One row: the page with its detail, findings, link counts and first links; no row if there is no such page."""
    page = t["pages"].filter(c("id") == page_id)
    url = page.select(c("url").alias("target_url"))
    j = page.join(t["page_detail"].withColumnRenamed("page_id", "id"), "id", "left")
    lists = {
        "issues": page_issues(t, page_id), "outlinks": outlinks_of(t, page_id), "inlinks": inlinks_of(t, page_id),
    }
    for name, rows in lists.items():  # each is bounded: one page's findings, and MAX_LINKS links
        j = j.crossJoin(rows.agg(F.collect_list(F.struct(*rows.columns)).alias(name)))
    n_in = t["links"].join(url, "target_url", "left_semi").agg(F.count("*").alias("inlink_count"))
    n_out = t["links"].filter(c("source_page_id") == page_id).agg(F.count("*").alias("outlink_count"))
    return j.crossJoin(n_in).crossJoin(n_out)


def crawl_root(pages: DataFrame) -> DataFrame:
    """One row: the origin of the shallowest, then shortest, then first URL, with its slash."""
    home = pages.orderBy("depth", F.length("url"), "url").limit(1)
    return home.select(F.regexp_extract("url", r"^([a-z]+://[^/]*/)", 1).alias("root"))


def structure(pages: DataFrame, prefix: Column | str) -> DataFrame:
    """The children of a URL prefix by their next path segment: segment, prefix, folder, pages, with_issues, page_id.

    A folder takes in the page of the same name, and counts everything beneath it.
    """
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    rest = F.substr("url", F.length(p) + 1)
    segment = F.when(rest.contains("/"), F.concat(F.substring_index(rest, "/", 1), F.lit("/"))).otherwise(rest)
    under = pages.filter(c("url").startswith(p)).select("id", "has_issue", segment.alias("s"))
    name = F.regexp_replace("s", "/+$", "")
    folder = c("s").endswith("/")
    nodes = under.groupBy(name.alias("name")).agg(F.max(folder).alias("folder"), F.count("*").alias("pages"), F.count_if("has_issue").alias("with_issues"), F.min(F.when(~folder, c("id"))).alias("page_id"))
    shown = F.concat(c("name"), F.when(c("folder"), "/").otherwise(""))
    return nodes.select("name", shown.alias("segment"), F.concat(p, shown).alias("prefix"), "folder", "pages", "with_issues", "page_id")


def structure_window(nodes: DataFrame, limit: int = MAX_CHILDREN) -> tuple[DataFrame, int]:
    """The first children by name, and how many are not listed."""
    return nodes.orderBy("name").limit(limit), max(0, nodes.count() - limit)


def resource_rows(t: Tables) -> DataFrame:
    """url, status, content_length, content_type, issues (their number)."""
    n = t["issues"].groupBy("url").agg(F.count("*").alias("issues"))
    return t["resources"].join(n, "url", "left").select("url", "status", "content_length", "content_type", F.coalesce("issues", F.lit(0)).alias("issues"))


def sitemap_rows(t: Tables) -> DataFrame:
    """url, source, status, page_id; status null where the crawl never reached the URL."""
    p = t["pages"].select("url", "status", c("id").alias("page_id"))
    return t["sitemap_urls"].join(p, "url", "left").select("url", "source", "status", "page_id")


def sitemap_not_crawled(t: Tables) -> DataFrame:
    return t["sitemap_urls"].join(t["pages"].select("url"), "url", "left_anti").select("url", "source")


def sitemap_not_listed(t: Tables) -> DataFrame:
    """Indexable HTML pages that answer with 2xx and are in no sitemap."""
    meant = t["pages"].filter((c("kind") == "html") & ~c("noindex") & c("status").between(200, 299))
    return meant.join(t["sitemap_urls"].select("url"), "url", "left_anti").select("id", "url")


def sitemap_summary(t: Tables) -> DataFrame:
    """One row: files, urls, not_crawled, not_listed. Past a truncated sitemap what it lists is unknown, so not_listed is null, not a number."""
    files = t["sitemaps"].agg(F.count("*").alias("files"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("_cut"))
    one = files.crossJoin(t["sitemap_urls"].agg(F.count("*").alias("urls"))).crossJoin(sitemap_not_crawled(t).agg(F.count("*").alias("not_crawled"))).crossJoin(sitemap_not_listed(t).agg(F.count("*").alias("_n")))
    return one.select("files", "urls", "not_crawled", F.when(~c("_cut"), c("_n")).alias("not_listed"))
