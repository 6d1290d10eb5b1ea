"""Queries over the html and url of pages: records become crawl tables, and the audit, grids, counts and passes run over those.

The oracles take the same facts from the markup by regular expressions; none of their SQL is shared with the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..crawl import Lifecycle, image_heads, run_crawl
from ..functions.columns import json_or_null, path_of, thousands
from ..functions.sql import register_functions
from ..operators import audit as A
from ..operators import extraction, frontier, grid, lookups, overviews
from ..operators import records as R
from ..operators.grid import Filter, SortSpec
from ..sources import http
from ..sources.store import cut
from .site_model import crawl_tables, on_model_sql

c = F.col
QUERIES, SQL = {}, {}


def _query(name: str, sql: str):
    def keep(function):
        QUERIES[name], SQL[name] = function, sql
        return function

    return keep


# ---- the pages as a crawl -------------------------------------------------------------------------


def real_records(spark: SparkSession, d: str) -> DataFrame:
    """A record for each page; status and depth, which the table lacks, follow from page_id."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    status = F.when(c("page_id") % 50 == 7, 500).when(c("page_id") % 20 == 3, 404).otherwise(200)
    return extraction.extract_records(p.select("url", "html", status.alias("status"), (c("page_id") % 3).alias("depth")))


def real_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Extracted once and written: the audit reads the tables several times."""
    return R.crawl_tables_of(cut(real_records(spark, d)))


def _decoded(sql: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        sql = f"replace({sql}, '{entity}', '{char}')"
    return f"trim(regexp_replace({sql}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


_BODY = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)$', 1), '(?s)</body>.*$', ''), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_WORDS = f"list_filter(regexp_split_to_array({_BODY}, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"
_ENCODED = "coalesce(list_aggregate(list_transform(string_split(regexp_replace({0}, '#.*$', ''), ''), lambda ch: CASE WHEN ord(ch) > 126 THEN url_encode(ch) ELSE ch END), 'string_agg', ''), '')"
_FACTS = f"""raw AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^([a-z]+://[^/?]*)$', '\\1/') AS url, CASE WHEN page_id % 50 = 7 THEN 500 WHEN page_id % 20 = 3 THEN 404 ELSE 200 END AS status, page_id % 3 AS depth, html FROM pages),
one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY url ORDER BY depth, status, strlen(html)) = 1),
f AS (SELECT url, status, depth, strlen(html) AS size, {_decoded("regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)")} AS title, len(regexp_extract_all(html, '<h1')) AS h1_count, {_decoded("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)")} AS h1,
 len({_WORDS}) AS word_count, array_to_string({_WORDS}, ' ') AS said, html FROM one),
hrefs AS (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM f),
l AS (SELECT url AS source, href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || {_ENCODED.format('href')} AS target FROM hrefs)"""

_SHARED = "SELECT url, '{0}' AS rule_id, 'warning' AS severity, {2} AS detail FROM f WHERE {1} IN (SELECT {1} FROM f WHERE {1} IS NOT NULL AND {1} <> '' GROUP BY {1} HAVING count(*) > 1)"
_RULES = (
    "SELECT url, 'response.4xx' AS rule_id, 'warning' AS severity, 'HTTP ' || status AS detail FROM f WHERE status BETWEEN 400 AND 499",
    "SELECT url, 'response.5xx', 'critical', 'HTTP ' || status FROM f WHERE status >= 500",
    "SELECT url, 'title.too-long', 'warning', length(title) || ' characters' FROM f WHERE length(title) > 60",
    "SELECT url, 'title.too-short', 'warning', length(title) || ' characters' FROM f WHERE length(title) < 30",
    "SELECT url, 'description.missing', 'warning', NULL FROM f",
    "SELECT url, 'content.missing-h1', 'warning', NULL FROM f WHERE h1_count = 0",
    "SELECT url, 'content.multiple-h1', 'notice', h1_count || ' <h1> elements' FROM f WHERE h1_count > 1",
    "SELECT url, 'content.empty-h1', 'warning', NULL FROM f WHERE h1_count > 0 AND h1 = ''",
    "SELECT url, 'content.thin', 'warning', word_count || ' words' FROM f WHERE word_count < 200",
    _SHARED.format("title.duplicate", "title", "title"),
    _SHARED.format("content.duplicate-body", "said", "NULL"),
    "SELECT url, 'links.broken-internal', 'warning', status || ', linked from ' || n || ' page(s)' FROM f JOIN (SELECT target, count(DISTINCT source) AS n FROM l GROUP BY target) k ON k.target = f.url WHERE status >= 400",
    "SELECT url, 'links.orphan-page', 'notice', NULL FROM f WHERE depth > 0 AND url NOT IN (SELECT target FROM l)",
)
_FOUND = "issues AS (" + "\nUNION ALL ".join(_RULES) + ")"


def _on_pages(sql: str, issues: bool = False) -> str:
    return f"WITH {_FACTS}{', ' + _FOUND if issues else ''}\n{sql}"


@_query("real_audit", _on_pages("SELECT url, rule_id, severity, CAST(detail AS VARCHAR) AS detail FROM issues", True))
def real_audit(spark: SparkSession, d: str) -> DataFrame:
    """All thirty rules over the pages as they are."""
    return A.audit(real_tables(spark, d)).select("url", "rule_id", "severity", "detail")


@_query("real_issue_by_rule", _on_pages("SELECT rule_id, severity, count(*) AS issues, count(DISTINCT url) AS urls FROM issues GROUP BY rule_id, severity", True))
def real_issue_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return overviews.issues_by_rule(A.audit(real_tables(spark, d))).select("rule_id", "severity", "issues", "urls")


@_query("real_grid_has_issue", _on_pages("SELECT url, status, word_count, title FROM f WHERE url IN (SELECT url FROM issues WHERE rule_id = 'title.too-long') ORDER BY title DESC, url DESC LIMIT 50", True))
def real_grid_has_issue(spark: SparkSession, d: str) -> DataFrame:
    t = real_tables(spark, d)
    found, _ = grid.query_rows(t["pages"], SortSpec("title", True, (Filter("has_issue", "title.too-long"),)), 0, 50, A.audit(t))
    return found.select("url", "status", "word_count", "title")


@_query("real_query_total", _on_pages("SELECT count(*) AS total FROM f WHERE status = 200 AND word_count < 300"))
def real_query_total(spark: SparkSession, d: str) -> DataFrame:
    _, total = grid.query_rows(real_tables(spark, d)["pages"], SortSpec("url", False, (Filter("status", 200), Filter("word_count", 300, "lt"))), 0, 10)
    return spark.range(1).select(F.lit(total).cast("long").alias("total"))


@_query("real_links", _on_pages("SELECT source AS url, href, target AS target_url FROM l"))
def real_links(spark: SparkSession, d: str) -> DataFrame:
    t = real_tables(spark, d)
    return t["links"].join(t["pages"].select(c("id").alias("source_page_id"), "url"), "source_page_id").select("url", "href", "target_url")


@_query("real_inlink_counts", _on_pages("SELECT url, (SELECT count(*) FROM l WHERE target = f.url) AS inlinks, (SELECT count(*) FROM l WHERE source = f.url) AS outlinks FROM f"))
def real_inlink_counts(spark: SparkSession, d: str) -> DataFrame:
    return lookups.inlink_counts(real_tables(spark, d)).select("url", "inlinks", "outlinks")


@_query("real_counts", _on_pages("SELECT count(*) AS crawled, count(*) FILTER (WHERE status = 200) AS status_2xx, count(*) FILTER (WHERE status = 404) AS status_4xx, count(*) FILTER (WHERE status = 500) AS status_5xx FROM f"))
def real_counts(spark: SparkSession, d: str) -> DataFrame:
    return overviews.crawl_counts(real_tables(spark, d)["pages"]).select("crawled", "status_2xx", "status_4xx", "status_5xx")


_FNV = "list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(1, 1 + strlen(said)), lambda i: CAST(CAST('0x' || substr(hex(encode(said)), 2 * i - 1, 2) AS INTEGER) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@_query("body_hash", _on_pages(f"SELECT url, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS body_hash FROM (SELECT url, {_FNV} AS h FROM f WHERE said <> '')"))
def body_hash(spark: SparkSession, d: str) -> DataFrame:
    return real_tables(spark, d)["pages"].filter("body_hash is not null").select("url", "body_hash")


# ---- heads: pages with all that a head can say, written from the rows of pages ---------------------


@_query("extract_head", """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE concat('About page ', page_id, ' & more') END AS meta_description,
 CASE WHEN page_id % 5 = 1 THEN concat('https://h.invalid/canon/', page_id) END AS canonical_url, page_id % 3 = 0 AS noindex, page_id % 3 IN (0, 1) AS nofollow, page_id % 7 = 2 AS noarchive,
 CASE WHEN page_id % 2 = 0 THEN concat('title=T ', page_id, '|type=article') ELSE concat('title=T ', page_id) END AS open_graph, concat('en=/en/', page_id, '|fr-ca=', CASE WHEN page_id % 2 = 0 THEN 'https://h.invalid/fr' ELSE '' END) AS hreflang,
 CASE WHEN page_id % 6 = 5 THEN '' ELSE concat('Part ', page_id, '|', 'Next part') END AS h2, concat('/i/', page_id, '.png=', CASE page_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '' ELSE 'Alt text' END) AS images FROM pages""")
def extract_head(spark: SparkSession, d: str) -> DataFrame:
    id_, text = c("page_id"), F.lit
    part = lambda when, *parts: F.when(when, F.concat(*(p if not isinstance(p, str) else text(p) for p in parts))).otherwise(text(""))
    html = F.concat(
        text("<!DOCTYPE html><html><head>"), part(id_ % 4 != 0, '<META NAME="Description" content="About  page ', id_, ' &amp; more">'), part(id_ % 5 == 1, '<link rel="x CANONICAL" href="../canon/', id_, '">'),
        text('<meta name="robots" content="'), F.when(id_ % 3 == 0, " NONE").when(id_ % 3 == 1, "nofollow, max-snippet:5").otherwise("index"), text('">'), part(id_ % 7 == 2, '<meta name=googlebot content=noarchive>'),
        text('<meta property="og:title" content="T '), id_, text('">'), part(id_ % 2 == 0, "<meta property='OG:type' content='article'>"),
        text('<link rel=alternate hreflang="EN" href="/en/'), id_, text('"><link rel="alternate" hreflang=fr-CA'), part(id_ % 2 == 0, ' href="https://h.invalid/fr"'), text("></head><body>"),
        part(id_ % 6 != 5, "<h2> Part <b>", id_, "</b></h2><h2>Next\n part</h2>"), text('<img src="/i/'), id_, text('.png"'), F.when(id_ % 3 == 0, "").when(id_ % 3 == 1, " alt").otherwise(' alt="Alt text"'), text("></body></html>"),
    )
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.concat(text("https://h.invalid/a/"), id_).alias("url"), html.alias("html"))
    pairs = lambda name, a, b: F.array_join(F.transform(name, lambda x: F.concat(x[a], text("="), F.coalesce(x[b], text("null")))), "|").alias(name)
    r = extraction.extract_records(p)
    return r.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page_id"), "meta_description", "canonical_url", "noindex", "nofollow", "noarchive", pairs("open_graph", "name", "value"), pairs("hreflang", "lang", "href"), F.array_join("h2", "|").alias("h2"), pairs("images", "src", "alt"))


# ---- functions, robots and sitemaps ---------------------------------------------------------------

_PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*(/[^#]*)', 1), '#.*$', '')"
ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /fr/\nAllow: /fr/1\nDisallow: /*?page=2\nDisallow: /en/*5$\n"


@_query("sql_functions", """SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^([a-z]+://[^/?]*)$', '\\1/') AS canonical, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), '/x%C3%A9') AS joined FROM pages""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark)
    return spark.sql("SELECT page_id, normalize_url(url) AS canonical, join_url(url, '/a/../xé') AS joined FROM {pages}", pages=spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url"))


@_query("detail_json", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('a', page_id, '|b') END AS h1, CASE WHEN page_id % 3 = 0 THEN 2 END AS n FROM pages")
def detail_json(spark: SparkSession, d: str) -> DataFrame:
    """Detail fields as JSON text, of which some are cut off, no JSON, or missing."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id")
    text = F.when(c("page_id") % 3 == 0, F.concat(F.lit('["a'), c("page_id"), F.lit('", "b"]'))).when(c("page_id") % 6 == 1, '["cut off').when(c("page_id") % 3 == 1, "no json")
    h1 = json_or_null(text, "array<string>")
    return p.select("page_id", F.array_join(h1, "|").alias("h1"), F.when(h1.isNotNull(), F.size(h1)).alias("n"))


@_query("thousands", "SELECT page_id, format('{:,}', page_id * 12345) AS shown FROM pages")
def thousands_shown(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", thousands(c("page_id") * 12345).alias("shown"))


@_query("robots_allows", f"SELECT page_id, CASE WHEN path LIKE '%?page=2%' AND NOT starts_with(path, '/fr/1') THEN false WHEN starts_with(path, '/fr/1') THEN NOT path LIKE '%?page=2%' WHEN starts_with(path, '/fr/') THEN false WHEN regexp_full_match(path, '/en/.*5') THEN false ELSE true END AS allowed FROM (SELECT page_id, {_PATH} AS path FROM pages)")
def robots_allows(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark)
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]*(/[^#]*)", 1), "#.*$", "").alias("path"))
    return p.select("page_id", F.call_function("robots_allows", F.lit(ROBOTS), c("path")).alias("allowed"))


@_query("sitemap_locations", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, url, count(*) AS n FROM pages GROUP BY 1, 2")
def sitemap_locations(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap for each host is written and parsed again."""
    register_functions(spark)
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), "url")
    entry = F.concat(F.lit('<url><loc lang="x"> '), F.replace(c("url"), F.lit("&"), F.lit("&amp;")), F.lit("\n</loc><image:loc>/i.png</image:loc></url>"))
    files = p.groupBy("host").agg(F.concat(F.lit('<?xml version="1.0"?><urlset>'), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    return files.select("host", F.explode(F.call_function("parse_sitemap", c("xml"))).alias("url")).groupBy("host", "url").agg(F.count("*").alias("n"))


# ---- passes over the network, with a transport made of formulas -------------------------------------


def _image_transport():
    """Image r of the model: by its number's last digit missing, large, of unknown size, or silent."""

    def transport(method: str, url: str) -> http.Response:
        if url.endswith("/robots.txt"):
            return http.Response(404)
        r = int(url.rpartition("/")[2].removesuffix(".png"))
        if r % 10 == 9:
            return http.Response(404 if method == "GET" else 410)
        sizes = {4: "307200", 5: None, 6: "102400"}
        length = sizes.get(r % 10, "20480")
        return http.Response(404 if r % 10 == 3 else 200, {"content-type": "image/png"} | ({"content-length": length} if length else {}))

    return transport


@_query("image_pass", on_model_sql("SELECT DISTINCT concat('https://e.com/img/', r, '.png') AS url, CASE r % 10 WHEN 3 THEN 404 WHEN 9 THEN 410 ELSE 200 END AS status, CAST(CASE r % 10 WHEN 4 THEN 307200 WHEN 5 THEN NULL WHEN 6 THEN 102400 WHEN 9 THEN NULL ELSE 20480 END AS BIGINT) AS content_length, CASE WHEN r % 10 <> 9 THEN 'image/png' END AS content_type FROM images"))
def image_pass(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct image of the pages is asked for once."""
    t = crawl_tables(spark, d)
    shown = t["page_detail"].join(t["pages"].select(c("id").alias("page_id"), "url"), "page_id").select("url", "images")
    return image_heads(R.image_urls(shown), _image_transport, http.RobotsCache(_image_transport()))


class SiteTransport:
    """A site of n pages: page k links to 2k + 1 and 2k + 2; some answer 404 or redirect to the next page, and one is forbidden."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self):
        return self.answer

    def answer(self, method: str, url: str) -> http.Response:
        path = "/" + url.split("://", 1)[1].partition("/")[2]
        if path == "/robots.txt":
            return http.Response(200, {}, b"User-agent: *\nDisallow: /p/13$")
        if path == "/sitemap.xml":
            return http.Response(200, {}, b"<urlset><url><loc>https://s.invalid/p/3</loc></url><url><loc>https://s.invalid/hidden</loc></url></urlset>")
        k = int(path.removeprefix("/p/")) if path.startswith("/p/") else -1
        if not 0 <= k < self.n or k % 23 == 7:
            return http.Response(404, {"content-type": "text/html"}, b"<title>Gone</title>")
        if k % 31 == 11:
            return http.Response(301, {"location": f"/r/{k}"})
        links = "".join(f'<a href="/p/{j}">{j}</a> ' for j in (2 * k + 1, 2 * k + 2) if j < self.n)
        return http.Response(200, {"content-type": "text/html; charset=utf-8"}, f"<html><title>Page {k}</title><body>{links}</body></html>".encode())


_WALK = """WITH RECURSIVE w(k, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT j, w.depth + 1 FROM w, (SELECT 1 AS s UNION ALL SELECT 2) x, LATERAL (SELECT 2 * w.k + s AS j) y
 WHERE j < (SELECT count(*) FROM pages) AND w.k <> 13 AND w.k % 23 <> 7 AND w.k % 31 <> 11)"""


@_query("crawl_site", f"{_WALK} SELECT CASE WHEN k % 31 = 11 AND k % 23 <> 7 AND k <> 13 THEN concat('https://s.invalid/r/', k) ELSE concat('https://s.invalid/p/', k) END AS url, depth, CASE WHEN k % 23 = 7 OR k % 31 = 11 THEN 404 ELSE 200 END AS status FROM w WHERE k <> 13")
def crawl_site(spark: SparkSession, d: str) -> DataFrame:
    """A whole crawl: frontier, robots, redirects, extraction, sitemaps and audit over a site with a page for each row of pages."""
    n = spark.read.parquet(f"{d}/pages.parquet").count()
    t = run_crawl(spark, "https://s.invalid/p/0", SiteTransport(n), Lifecycle(), check_images=False)
    return t["pages"].select("url", "depth", "status")


@_query("crawl_site_failures", f"{_WALK} SELECT concat('https://s.invalid/p/', k) AS url, concat('robots.txt disallows https://s.invalid/p/', k) AS reason FROM w WHERE k = 13")
def crawl_site_failures(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/pages.parquet").count()
    return run_crawl(spark, "https://s.invalid/p/0", SiteTransport(n), Lifecycle(), check_images=False)["crawl_failures"]


# ---- writers ----------------------------------------------------------------------------------------


@_query("replace_outlinks", on_model_sql("SELECT id, src AS source_page_id, target_url FROM l WHERE src % 5 <> 0 UNION ALL SELECT id + 1000000 AS id, src AS source_page_id, 'https://e.com/new' AS target_url FROM l WHERE src % 5 = 0 AND k = 3"))
def replace_outlinks(spark: SparkSession, d: str) -> DataFrame:
    old = crawl_tables(spark, d)["links"].select("id", "source_page_id", "target_url")
    new = old.filter("source_page_id % 5 = 0 and id % 10 = 3").select((c("id") + 1000000).alias("id"), "source_page_id", F.lit("https://e.com/new").alias("target_url"))
    return frontier.replace_outlinks(old, new)


@_query("sitemap_first_writer", on_model_sql("SELECT url, min_by(source, seq) AS source FROM (SELECT url, source, 1 AS seq FROM sitemap_urls UNION ALL SELECT url, 'https://e.com/late.xml', 2 FROM m) GROUP BY url"))
def sitemap_first_writer(spark: SparkSession, d: str) -> DataFrame:
    t = crawl_tables(spark, d)
    rows = t["sitemap_urls"].select("url", "source", F.lit(1).alias("seq")).unionByName(t["pages"].select("url", F.lit("https://e.com/late.xml").alias("source"), F.lit(2).alias("seq")))
    return frontier.first_writer_wins(rows, "url", "seq").select("url", "source")


@_query("landed_redirects", on_model_sql("SELECT r.source_url, r.final_url, m.id AS page_id, m.status AS page_status, r.hops FROM redirects r JOIN m ON m.url = r.final_url"))
def landed_redirects(spark: SparkSession, d: str) -> DataFrame:
    return R.landed_redirects(crawl_tables(spark, d))


@_query("follows", on_model_sql("SELECT id FROM l WHERE starts_with(target_url, 'https://e.com/') AND k <> 2"))
def follows(spark: SparkSession, d: str) -> DataFrame:
    """The links that a crawl goes along."""
    links = crawl_tables(spark, d)["links"]
    return links.filter(frontier.follows(c("target_url"), F.lit("https://e.com/"), c("nofollow"))).select("id")


@_query("url_paths", f"SELECT page_id, regexp_extract(url, '^[^:]*://[^/]*(/[^?#]*)?', 1) AS path FROM pages")
def url_paths(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", path_of(c("url")).alias("path"))
