"""The queries of the engine and their oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import base_host, host, is_internal, status_tone, url_notes, url_params
from ..operators import audit as A
from ..operators import export, extraction, frontier, grid, lookups, overviews, views
from ..operators.grid import Filter, SortSpec
from ..operators.page_rules import PAGE_RULES, page_findings, page_subjects
from ..operators.site_rules import SITE_RULES, site_findings
from ..sources.store import cut
from . import real
from .oracles import PAGE_LEVEL, all_findings, finding_sql, on_model
from .site_model import URL, crawl_tables

c = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None, issues: bool = False, model: bool = True) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = on_model(sql, issues) if model else sql


def _with_issues(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The crawl tables with findings, written once: several views read them."""
    t = crawl_tables(spark, sf_dir)
    t["issues"] = cut(A.audit(t))
    t["pages"] = A.with_issue_flag(t["pages"], t["issues"])
    return t


# ---- rules --------------------------------------------------------------------------------------


def _page_rule(rule) -> Query:
    return lambda spark, d: page_findings(page_subjects(crawl_tables(spark, d), (rule,)), (rule,))


def _site_rule(rule) -> Query:
    return lambda spark, d: site_findings(crawl_tables(spark, d), (rule,))


for _r in PAGE_RULES:
    _add("rule_" + _r.id.replace(".", "_").replace("-", "_"), _page_rule(_r), finding_sql(_r.id))
for _r in SITE_RULES:
    _add("rule_" + _r.id.replace(".", "_").replace("-", "_"), _site_rule(_r), finding_sql(_r.id))
_add("page_rule_findings", lambda spark, d: page_findings(page_subjects(crawl_tables(spark, d))), all_findings(PAGE_LEVEL))
_add("site_rule_findings", lambda spark, d: site_findings(crawl_tables(spark, d)), all_findings(tuple(r.id for r in SITE_RULES)))
_add("audit_all", lambda spark, d: A.audit(crawl_tables(spark, d)), all_findings())

# ---- filters and windows ------------------------------------------------------------------------


def _filter(*filters: Filter) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        need = any(f.kind == "has_issue" for f in filters)
        t = _with_issues(spark, d) if need else crawl_tables(spark, d)
        return grid.matching(t["pages"], filters, t.get("issues")).select("id", "url")

    return run


_HAS = "EXISTS (SELECT 1 FROM issues i WHERE i.page_id = m.id"
for _name, _filters, _where in (
    ("filter_status_eq", (Filter("status", 404),), "status = 404"),
    ("filter_status_ge", (Filter("status", 400, "ge"),), "status >= 400"),
    ("filter_status_ne", (Filter("status", 200, "ne"),), "status <> 200"),
    ("filter_status_lt", (Filter("status", 301, "lt"),), "status < 301"),
    ("filter_depth_le", (Filter("depth", 2, "le"),), "depth <= 2"),
    ("filter_depth_gt", (Filter("depth", 3, "gt"),), "depth > 3"),
    ("filter_word_count_lt", (Filter("word_count", 200, "lt"),), "word_count < 200"),
    ("filter_kind", (Filter("kind", "pdf"),), "kind = 'pdf'"),
    ("filter_noindex", (Filter("noindex", True),), "noindex"),
    ("filter_has_issue", (Filter("has_issue"),), f"{_HAS})"),
    ("filter_has_rule", (Filter("has_issue", "title.missing"),), f"{_HAS} AND i.rule_id = 'title.missing')"),
    ("filter_url_contains", (Filter("url_contains", "WORD-1"),), "lower(url) LIKE '%word-1%'"),
    ("filter_url_wildcard", (Filter("url_contains", "blog%5"),), "lower(url) LIKE '%blog%5%'"),
    ("filter_and", (Filter("status", 200), Filter("kind", "html"), Filter("depth", 2, "ge")), "status = 200 AND kind = 'html' AND depth >= 2"),
    ("filter_status_class", grid.filters_from_view(status_class="4"), "status BETWEEN 400 AND 499"),
    ("filter_view_bar", grid.filters_from_view("2", "html", "yes", 3, " post "), "status BETWEEN 200 AND 299 AND kind = 'html' AND NOT noindex AND depth <= 3 AND url LIKE '%post%'"),
):
    _add(_name, _filter(*_filters), f"SELECT id, url FROM m WHERE {_where}", issues="issue" in _where)

_GRID_SQL = f"id, url, status, depth, size, kind, noindex, word_count, elapsed_ms, title, meta_description, CASE WHEN canonical_id IS NULL THEN NULL ELSE {URL.format('canonical_id')} END AS canonical"


def _grid_window(column: str, descending: bool) -> Query:
    return lambda spark, d: grid.grid_window(crawl_tables(spark, d)["pages"], SortSpec(column, descending), 5, 40)


for _column in grid.SORT_COLUMNS:
    for _down in (False, True):
        _way = "DESC NULLS LAST" if _down else "ASC NULLS FIRST"
        _add(f"grid_window_{_column}_{'desc' if _down else 'asc'}", _grid_window(_column, _down), f"SELECT {_GRID_SQL} FROM m ORDER BY {_column} {_way}, id {_way} LIMIT 40 OFFSET 5")


def _grid_keyset(column: str, descending: bool) -> Query:
    """The window after row 20, found by that row's value and id."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        pages, sort = crawl_tables(spark, d)["pages"], SortSpec(column, descending)
        last = grid.grid_window(pages, sort, 19, 1).first()
        return grid.grid_window(pages, sort, 0, 40 if last else 0, after=(last[column], last["id"]) if last else None)

    return run


for _column, _down in (("title", False), ("title", True), ("depth", True), ("url", False)):
    _way = "DESC NULLS LAST" if _down else "ASC NULLS FIRST"
    _add(f"grid_keyset_{_column}_{'desc' if _down else 'asc'}", _grid_keyset(_column, _down), f"SELECT {_GRID_SQL} FROM m ORDER BY {_column} {_way}, id {_way} LIMIT 40 OFFSET 20")


def grid_filtered(spark: SparkSession, d: str) -> DataFrame:
    return grid.grid_window(crawl_tables(spark, d)["pages"], SortSpec("word_count", True, (Filter("kind", "html"),)), 0, 5000)


def grid_headings(spark: SparkSession, d: str) -> DataFrame:
    t = crawl_tables(spark, d)
    return grid.grid_window(t["pages"], SortSpec("url"), 0, 50, detail=t["page_detail"]).select("id", "h1", "h2", "h1_count", "h2_count")


_add("grid_filtered", grid_filtered, f"SELECT {_GRID_SQL} FROM m WHERE kind = 'html' ORDER BY word_count DESC, id DESC LIMIT 1000")
_H1 = "CASE WHEN h1_count = 0 THEN NULL WHEN h1_empty THEN '' ELSE concat('Heading 1 of ', id) END"
_add("grid_headings", grid_headings, f"SELECT id, {_H1} AS h1, CASE WHEN id % 2 = 0 THEN 'Second level' END AS h2, h1_count, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS h2_count FROM (SELECT * FROM m ORDER BY url LIMIT 50)")

# ---- overviews ----------------------------------------------------------------------------------

_BY_RULE = "SELECT rule_id, severity, count(*) AS issues, count(DISTINCT url) AS urls, count(DISTINCT page_id) AS page_urls FROM issues GROUP BY rule_id, severity"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"


def _on_issues(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(A.audit(crawl_tables(spark, d)))


def rule_index(spark: SparkSession, d: str) -> DataFrame:
    t = crawl_tables(spark, d)
    crawled = t["pages"].agg(F.count("*").alias("n"))  # one row
    j = overviews.rule_index(A.standard_registry(), A.audit(t), F.lit(1.0)).drop("share").crossJoin(crawled)
    return j.withColumn("share", F.when(c("urls") == c("page_urls"), F.round(c("urls") / c("n"), 6))).drop("n")


_add("issue_by_rule", _on_issues(overviews.issues_by_rule), _BY_RULE, True)
_add("issue_by_severity", _on_issues(overviews.issues_by_severity), "SELECT severity, count(*) AS issues FROM issues GROUP BY severity", True)
_add("issue_totals", _on_issues(overviews.issue_totals), "SELECT count(*) AS issues, count(DISTINCT page_id) AS pages_with_issues, count(DISTINCT page_id) + count(DISTINCT CASE WHEN page_id IS NULL THEN url END) AS urls_with_issues FROM issues", True)
_RULES = ", ".join(f"('{r.id}', '{r.severity}')" for r in (*PAGE_RULES, *SITE_RULES))
_add("rule_index", rule_index, f"SELECT r.rule_id, r.severity, coalesce(issues, 0) AS issues, coalesce(urls, 0) AS urls, coalesce(page_urls, 0) AS page_urls, CASE WHEN coalesce(urls, 0) = coalesce(page_urls, 0) THEN round(coalesce(urls, 0) / (SELECT count(*) FROM m), 6) END AS share FROM (VALUES {_RULES}) r(rule_id, severity) LEFT JOIN ({_BY_RULE}) b USING (rule_id)", True)
_add("report_findings", _on_issues(overviews.report_findings), f"SELECT rule_id, CASE severity WHEN 'critical' THEN 'Issue' WHEN 'warning' THEN 'Warning' ELSE 'Opportunity' END AS label, urls AS affected FROM ({_BY_RULE}) ORDER BY {_RANK}, urls DESC, rule_id", True)
_add("report_examples", _on_issues(overviews.report_examples), "SELECT rule_id, CAST(position AS INTEGER) AS position, url FROM (SELECT rule_id, url, row_number() OVER (PARTITION BY rule_id ORDER BY url) AS position FROM issues) WHERE position <= 5", True)

_CLASSES = ", ".join(f"count(*) FILTER (WHERE status BETWEEN {k}00 AND {k}99) AS status_{k}xx" for k in range(1, 6))
_COUNTS = f"count(*) AS crawled, {_CLASSES}, count(*) FILTER (WHERE NOT noindex) AS indexable, count(*) FILTER (WHERE noindex) AS noindex, count(*) FILTER (WHERE kind = 'html' AND status BETWEEN 200 AND 299 AND word_count < 50 AND size > 20000) AS js_shell"
_QUEUED = "FROM frontier f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.url = f.url)"
_DONE = "(url IN (SELECT url FROM m) OR url IN (SELECT url FROM failures) OR url IN (SELECT source_url FROM redirects))"
_add("crawl_by_kind", lambda s, d: overviews.pages_by_kind(crawl_tables(s, d)["pages"]), "SELECT kind, count(*) AS pages FROM m GROUP BY kind")
_add("crawl_counts", lambda s, d: overviews.crawl_counts(crawl_tables(s, d)["pages"]), f"SELECT {_COUNTS} FROM m")
_add("crawl_overview", lambda s, d: overviews.crawl_overview(crawl_tables(s, d)), f"SELECT {_COUNTS}, (SELECT count(*) {_QUEUED}) AS queued, (SELECT count(*) FROM failures) AS failed FROM m")
_add("queued", lambda s, d: overviews.queued(crawl_tables(s, d)["frontier"], crawl_tables(s, d)["pages"]), f"SELECT url, depth {_QUEUED}")
_add("queued_strict", lambda s, d: overviews.queued_strict(crawl_tables(s, d)), f"SELECT url, depth FROM frontier WHERE NOT {_DONE}")
_add("frontier_done", lambda s, d: overviews.frontier_state(crawl_tables(s, d)), f"SELECT url, depth, {_DONE} AS done FROM frontier")
_add("js_shell", lambda s, d: crawl_tables(s, d)["pages"].filter(overviews.is_js_shell(c("kind"), c("status"), c("word_count"), c("size"))).select("id", "url"), "SELECT id, url FROM m WHERE kind = 'html' AND status BETWEEN 200 AND 299 AND word_count < 50 AND size > 20000")

# ---- links, structure, resources, sitemaps --------------------------------------------------------

_add("outlinks", lambda s, d: lookups.outlinks_of(crawl_tables(s, d), 7).select("id", "url", "anchor_text", "nofollow", "status"), "SELECT l.id, l.target_url AS url, concat('link ', k) AS anchor_text, k = 2 AS nofollow, m.status FROM l LEFT JOIN m ON m.url = l.target_url WHERE l.src = 7 ORDER BY l.id LIMIT 100")
_add("inlinks", lambda s, d: lookups.inlinks_of(crawl_tables(s, d), 8), f"SELECT l.id, m.url, concat('link ', k) AS anchor_text, k = 2 AS nofollow, m.status FROM l JOIN m ON m.id = l.src WHERE l.target_url = {URL.format('8')} ORDER BY l.id LIMIT 100")
_add("inlink_counts", lambda s, d: lookups.inlink_counts(crawl_tables(s, d)), "SELECT id, url, (SELECT count(*) FROM l WHERE l.target_url = m.url) AS inlinks, (SELECT count(*) FROM l WHERE l.src = m.id) AS outlinks FROM m")
_add("link_targets_crawled", lambda s, d: lookups.link_targets(crawl_tables(s, d)), "SELECT l.id, l.src AS source_page_id, l.target_url, m.status FROM l LEFT JOIN m ON m.url = l.target_url")
_add("page_issues", lambda s, d: lookups.page_issues(_with_issues(s, d), 40), "SELECT rule_id, severity, detail FROM issues WHERE page_id = 40", True)
_add("page_detail", lambda s, d: lookups.page_detail(_with_issues(s, d), 8).select("id", "url", "status", F.size("issues").alias("n_issues"), "inlink_count", "outlink_count", F.get("outlinks", F.lit(0))["url"].alias("first_link"), F.size("images").alias("n_images")), f"SELECT id, url, status, CAST((SELECT count(*) FROM issues i WHERE i.page_id = m.id) AS INTEGER) AS n_issues, (SELECT count(*) FROM l WHERE l.target_url = m.url) AS inlink_count, (SELECT count(*) FROM l WHERE l.src = m.id) AS outlink_count, (SELECT target_url FROM l WHERE l.src = m.id ORDER BY l.id LIMIT 1) AS first_link, CAST((SELECT count(*) FROM images i WHERE i.id = m.id) AS INTEGER) AS n_images FROM m WHERE id = 8", True)


def _edges(t: dict[str, DataFrame]) -> DataFrame:
    ids = t["pages"].select("id", "url")
    return t["links"].select(c("source_page_id").alias("id"), "target_url").join(ids, "id").select(c("url").alias("source"), c("target_url").alias("target"))


def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    """Every page that can be reached, at any depth. The SQL ends at as many levels as there are pages, which is no bound on what is found."""
    t = crawl_tables(spark, d)
    return frontier.bfs_depths(_edges(t), t["pages"].filter("id = 1").select("url"))


SQL["bfs_depth"] = on_model("SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY url").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT url, CAST(min", ", edges AS (SELECT DISTINCT m.url AS source, l.target_url AS target FROM l JOIN m ON m.id = l.src), walk AS (SELECT 'https://e.com/' AS url, 0 AS depth UNION SELECT e.target, w.depth + 1 FROM walk w JOIN edges e ON e.source = w.url WHERE w.depth < (SELECT n FROM m LIMIT 1))\nSELECT url, CAST(min", 1)
QUERIES["bfs_depth"] = bfs_depth


def redirect_walk(spark: SparkSession, d: str) -> DataFrame:
    m = crawl_tables(spark, d)["pages"].select("id")
    spot = lambda i: F.concat(F.lit("u"), i.cast("string"))
    hops = m.filter("id % 4 <> 0").select(spot(c("id")).alias("url"), F.lit(301).alias("status"), F.when(c("id") % 12 == 7, spot(c("id") - 2)).otherwise(spot(c("id") + 1)).alias("location"))
    out = frontier.redirect_walk(m.select(spot(c("id")).alias("url")), hops)
    return out.select("url", F.size("chain").alias("length"), "outcome", "final_url")


_STEP = "CASE WHEN w.spot % 4 = 0 OR w.spot > (SELECT max(id) FROM m) THEN NULL WHEN w.spot % 12 = 7 THEN w.spot - 2 ELSE w.spot + 1 END"
SQL["redirect_walk"] = on_model("SELECT concat('u', start) AS url, CAST(len(chain) AS INTEGER) AS length, CASE WHEN looped THEN 'loop' ELSE 'landed' END AS outcome, CASE WHEN NOT looped THEN concat('u', spot) END AS final_url FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(chain) DESC) AS r FROM walk) WHERE r = 1").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT concat('u', start)", f", walk AS (SELECT id AS start, id AS spot, [id] AS chain, false AS looped FROM m UNION ALL SELECT start, {_STEP}, list_append(chain, {_STEP}), list_contains(chain, {_STEP}) FROM walk w WHERE NOT looped AND {_STEP} IS NOT NULL)\nSELECT concat('u', start)", 1)
QUERIES["redirect_walk"] = redirect_walk


def _structure(prefix: str | None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        pages = _with_issues(spark, d)["pages"]
        return lookups.structure(pages, prefix).drop("name")

    return run


def _structure_sql(prefix: str) -> str:
    rest = f"substr(url, {len(prefix) + 1})"
    seg = f"CASE WHEN contains({rest}, '/') THEN concat(split_part({rest}, '/', 1), '/') ELSE {rest} END"
    kids = f"SELECT {seg} AS s, id, EXISTS (SELECT 1 FROM issues i WHERE i.page_id = m.id) AS bad FROM m WHERE starts_with(url, '{prefix}')"
    name = "rtrim(s, '/')"
    shown = f"concat({name}, CASE WHEN max(ends_with(s, '/')) THEN '/' ELSE '' END)"
    return f"SELECT {shown} AS segment, concat('{prefix}', {shown}) AS prefix, max(ends_with(s, '/')) AS folder, count(*) AS pages, count(*) FILTER (WHERE bad) AS with_issues, min(CASE WHEN NOT ends_with(s, '/') THEN id END) AS page_id FROM ({kids}) GROUP BY {name}"


_add("structure_root", lambda s, d: lookups.crawl_root(crawl_tables(s, d)["pages"]), "SELECT regexp_extract(url, '^([a-z]+://[^/]*/)', 1) AS root FROM m ORDER BY depth, length(url), url LIMIT 1")
_add("structure_children", _structure("https://e.com/"), _structure_sql("https://e.com/"), True)
_add("structure_folder", _structure("https://e.com/blog/"), _structure_sql("https://e.com/blog/"), True)
_add("resource_rows", lambda s, d: lookups.resource_rows(_with_issues(s, d)), "SELECT url, status, content_length, content_type, (SELECT count(*) FROM issues i WHERE i.url = r.url) AS issues FROM resources r", True)
_NOT_LISTED = "FROM m WHERE kind = 'html' AND NOT noindex AND status BETWEEN 200 AND 299 AND url NOT IN (SELECT url FROM sitemap_urls)"
_NOT_CRAWLED = "FROM sitemap_urls WHERE url NOT IN (SELECT url FROM m)"
_add("sitemap_urls", lambda s, d: lookups.sitemap_rows(crawl_tables(s, d)), "SELECT s.url, s.source, m.status, m.id AS page_id FROM sitemap_urls s LEFT JOIN m ON m.url = s.url")
_add("sitemap_not_crawled", lambda s, d: lookups.sitemap_not_crawled(crawl_tables(s, d)), f"SELECT url, source {_NOT_CRAWLED}")
_add("sitemap_not_listed", lambda s, d: lookups.sitemap_not_listed(crawl_tables(s, d)), f"SELECT id, url {_NOT_LISTED}")
_SUMMARY = f"SELECT CAST(1 AS BIGINT) AS files, (SELECT count(*) FROM sitemap_urls) AS urls, (SELECT count(*) {_NOT_CRAWLED}) AS not_crawled, "
_add("sitemap_summary", lambda s, d: lookups.sitemap_summary(crawl_tables(s, d)), f"{_SUMMARY}(SELECT count(*) {_NOT_LISTED}) AS not_listed")
_add("sitemap_summary_truncated", lambda s, d: lookups.sitemap_summary(crawl_tables(s, d, True)), f"{_SUMMARY}CAST(NULL AS BIGINT) AS not_listed")

# ---- views and exports ----------------------------------------------------------------------------

_PATH = "regexp_extract(url, '^[^:]*://[^/]*(/[^?#]*)?', 1)"
_NOTES = f"array_to_string(list_filter([CASE WHEN regexp_matches(regexp_replace({_PATH}, '%[0-9A-Fa-f][0-9A-Fa-f]', '', 'g'), '[A-Z]') THEN 'capitals' END, CASE WHEN contains({_PATH}, '_') THEN 'underscores' END, CASE WHEN contains({_PATH}, '%') THEN 'encoded characters' END, CASE WHEN length({_PATH}) - length(replace({_PATH}, '/', '')) > 5 THEN 'deep path' END], lambda x: x IS NOT NULL), ', ')"
_PARAMS = "CASE WHEN contains(url, '?') THEN substr(url, instr(url, '?') + 1) END"
_VIEW_SQL = {
    "all": "SELECT status, url, title, word_count, depth, size FROM m",
    "urls": f"SELECT status, url, CAST(length(url) AS INTEGER) AS url_length, {_PARAMS} AS url_params, {_NOTES} AS url_notes FROM m",
    "titles": "SELECT status, url, title, CAST(length(title) AS INTEGER) AS title_length, word_count FROM m WHERE kind = 'html'",
    "descriptions": "SELECT status, url, meta_description, CAST(length(meta_description) AS INTEGER) AS description_length FROM m WHERE kind = 'html'",
    "headings": f"SELECT status, url, {_H1} AS h1, h1_count, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS h2_count, word_count FROM m WHERE kind = 'html'",
    "duplicates": "SELECT status, url, title, meta_description FROM m WHERE kind = 'html'",
    "canonicals": f"SELECT status, url, CASE WHEN canonical_id IS NOT NULL THEN {URL.format('canonical_id')} END AS canonical, noindex FROM m WHERE kind = 'html'",
    "broken": "SELECT status, url, title, depth FROM m WHERE status >= 400",
    "redirects": "SELECT status, url, title, depth FROM m WHERE status BETWEEN 300 AND 399",
    "noindex": f"SELECT status, url, title, CASE WHEN canonical_id IS NOT NULL THEN {URL.format('canonical_id')} END AS canonical FROM m WHERE noindex",
    "slowest": "SELECT status, url, elapsed_ms, size FROM m",
    "images": "SELECT status, url, content_length, content_type, (SELECT count(*) FROM issues i WHERE i.url = r.url) AS issues FROM resources r",
    "sitemap": "SELECT s.url, m.status, s.source FROM sitemap_urls s LEFT JOIN m ON m.url = s.url",
}


def _view(name: str) -> Query:
    return lambda spark, d: views.view_rows(_with_issues(spark, d) if name == "images" else crawl_tables(spark, d), name)


for _name, _sql in _VIEW_SQL.items():
    _add(f"view_{_name}", _view(_name), _sql, _name == "images")
_add("search_preview", lambda s, d: views.search_preview(crawl_tables(s, d)["pages"]), "SELECT id, concat(regexp_extract(url, '://([^/]*)', 1), CASE WHEN id = 1 THEN '' ELSE concat(' › ', replace(substr(url, 15), '/', ' › ')) END) AS crumbs, coalesce(nullif(title, ''), url) AS headline, CASE WHEN NOT nosnippet THEN coalesce(nullif(meta_description, ''), 'No description.') END AS snippet FROM m")
_TYPE = "CASE kind WHEN 'html' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' ELSE 'image/png' END"
_add("export_pages", lambda s, d: export.export_rows(crawl_tables(s, d), "pages", (Filter("status", 200),), SortSpec("title", True, (Filter("status", 200),))), f"SELECT url, status, depth, size, {_TYPE} AS content_type, kind, noindex, title, meta_description, CASE WHEN canonical_id IS NOT NULL THEN {URL.format('canonical_id')} END AS canonical, word_count, elapsed_ms FROM m WHERE status = 200")
_add("export_images", lambda s, d: export.export_rows(_with_issues(s, d), "images"), "SELECT url, status, content_length, content_type, (SELECT count(*) FROM issues i WHERE i.url = r.url) AS issues FROM resources r", True)
_add("export_sitemap", lambda s, d: export.export_rows(crawl_tables(s, d), "sitemap"), "SELECT s.url, m.status, s.source FROM sitemap_urls s LEFT JOIN m ON m.url = s.url")
_add("upsert_pages", lambda s, d: frontier.upsert(crawl_tables(s, d)["pages"].select("url", "id", "title", F.lit(1).alias("seq")), crawl_tables(s, d)["pages"].filter("id % 3 = 0").select("url", (c("id") + 100000).alias("id"), F.lit("new").alias("title"), F.lit(2).alias("seq")), "url", "seq", "id"), "SELECT url, id, CASE WHEN id % 3 = 0 THEN 'new' ELSE title END AS title, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS seq FROM m")
_add("merge_frontier", lambda s, d: frontier.merge_frontier(crawl_tables(s, d)["frontier"], crawl_tables(s, d)["pages"].select("url", (5 - c("depth")).alias("depth"))), "SELECT url, min(depth) AS depth FROM (SELECT url, depth FROM frontier UNION ALL SELECT url, 5 - depth FROM m) GROUP BY url")

# ---- real pages -----------------------------------------------------------------------------------


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The records, each under its page's own address made unique by page_id."""
    return extraction.extract_records(_raw(spark, d).select(F.concat(F.lit("https://pages.invalid/"), c("page_id")).alias("url"), "html"))


_ID = "CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT)"
def _page_id() -> Column:
    return F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page_id")


_TITLE = "regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)"


def _decoded(sql: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        sql = f"replace({sql}, '{entity}', '{char}')"
    return f"trim(regexp_replace({sql}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def _plain(name: str, query: Query, sql: str | None = None) -> None:
    _add(name, query, sql, model=False)


_plain("extract_title", lambda s, d: _records(s, d).select(_page_id(), "title", "title_count"), f"SELECT page_id, {_decoded(_TITLE)} AS title, CAST(len(regexp_extract_all(html, '<title')) AS INTEGER) AS title_count FROM pages")
_H = "regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)"
_plain("extract_h1", lambda s, d: _records(s, d).select(_page_id(), F.get("h1", F.lit(0)).alias("h1"), F.size("h1").alias("n_h1")), f"SELECT page_id, {_decoded(_H)} AS h1, CAST(len(regexp_extract_all(html, '<h1')) AS INTEGER) AS n_h1 FROM pages")
_LINKS = "SELECT page_id, html, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS text, unnest(range(len(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>')))) AS k FROM pages"
_plain("extract_links", lambda s, d: extraction.outlinks(_records(s, d)).select(_page_id(), "k", "href", "text", "nofollow"), f"SELECT page_id, CAST(k AS INTEGER) AS k, href, {_decoded('text')} AS text, false AS nofollow FROM ({_LINKS})")
_plain("extract_link_counts", lambda s, d: _records(s, d).select(_page_id(), F.size("links").alias("n_links"), F.size("images").alias("n_images")), "SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS n_links, CAST(len(regexp_extract_all(html, '<img')) AS INTEGER) AS n_images FROM pages")
_BODY = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)$', 1), '(?s)</body>.*$', ''), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_plain("extract_word_count", lambda s, d: _records(s, d).select(_page_id(), "word_count"), f"SELECT page_id, CAST(len(list_filter(regexp_split_to_array({_BODY}, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS INTEGER) AS word_count FROM pages")
_plain("extract_records", lambda s, d: _records(s, d).select(_page_id(), "size", "kind", "content_type_mismatch", "meta_description", "canonical_url", "noindex"), "SELECT page_id, CAST(strlen(html) AS BIGINT) AS size, 'html' AS kind, false AS content_type_mismatch, CAST(NULL AS VARCHAR) AS meta_description, CAST(NULL AS VARCHAR) AS canonical_url, false AS noindex FROM pages")


def body_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text has the same 64-bit hash."""
    docs = extraction.text_hashes(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text", "h")
    groups = docs.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")
    return groups.select("first_doc", "n")


_plain("duplicate_documents", body_hash_groups, "SELECT min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
_plain("url_notes", lambda s, d: _raw(s, d).select("page_id", F.array_join(url_notes(c("url")), ", ").alias("notes")), f"SELECT page_id, {_NOTES} AS notes FROM pages")
_plain("url_params", lambda s, d: _raw(s, d).select("page_id", url_params(c("url")).alias("params")), f"SELECT page_id, {_PARAMS} AS params FROM pages")
_plain("url_length", lambda s, d: _raw(s, d).select("page_id", F.char_length("url").alias("n")), "SELECT page_id, CAST(length(url) AS INTEGER) AS n FROM pages")
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"
_plain("url_host", lambda s, d: _raw(s, d).groupBy(base_host(host(c("url"))).alias("host")).agg(F.count("*").alias("pages")), f"SELECT regexp_replace({_HOST}, '^www[.]', '') AS host, count(*) AS pages FROM pages GROUP BY 1")


def _locality(subdomains: bool) -> Query:
    return lambda spark, d: _raw(spark, d).select("page_id", is_internal(c("url"), F.lit("https://ththre.example.com/"), subdomains).alias("internal"))


_BARE = f"regexp_replace({_HOST}, '^www[.]', '')"
_plain("scope_locality", _locality(False), f"SELECT page_id, {_BARE} = 'ththre.example.com' AS internal FROM pages")
_plain("scope_subdomains", _locality(True), f"SELECT page_id, {_BARE} = 'ththre.example.com' OR ends_with({_BARE}, '.ththre.example.com') AS internal FROM pages")
_plain("normalize_url", lambda s, d: extraction.canonical_urls(_raw(s, d).select("page_id", "url"), "url", "canonical").select("page_id", "canonical"), "SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^([a-z]+://[^/?]*)$', '\\1/') AS canonical FROM pages")
_plain("resolve_links", lambda s, d: extraction.resolved_urls(_raw(s, d).select("page_id", "url", F.lit("/a/./b/../c").alias("href")), "url", "href", "target").select("page_id", "target"), "SELECT page_id, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), '/a/c') AS target FROM pages")
_plain("status_tone", lambda s, d: crawl_tables(s, d)["pages"].groupBy(status_tone(c("status")).alias("tone")).agg(F.count("*").alias("pages")), on_model("SELECT CASE WHEN status < 300 THEN 'good' WHEN status < 400 THEN 'moved' WHEN status < 500 THEN 'bad' ELSE 'broken' END AS tone, count(*) AS pages FROM m GROUP BY 1"))

QUERIES |= real.QUERIES
SQL |= real.SQL
