import io
import json
import zipfile

import compare
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__
from trawlspark import api, schema
from trawlspark.operators import audit, export, extraction, frontier, grid, lookups
from trawlspark.operators.page_rules import PAGE_RULES, page_findings
from trawlspark.operators.registry import PageRule, Registry, RegistryError
from trawlspark.plans import queries as engine
from trawlspark.plans.site_model import crawl_tables
from trawlspark.sources import graph, store
from trawlspark.streaming import ingest

#: Each kind of query once; tests/oracles.py runs them all.
SAMPLE = (
    "audit_all", "filter_has_rule", "filter_url_contains", "filter_view_bar", "grid_window_title_asc", "grid_window_meta_description_desc", "grid_headings", "grid_keyset_title_desc", "issue_by_rule", "issue_totals", "rule_index", "report_examples", "crawl_overview",
    "frontier_done", "page_detail", "inlinks", "structure_children", "resource_rows", "sitemap_summary_truncated", "view_urls", "search_preview", "export_pages", "bfs_depth", "redirect_walk", "upsert_pages", "extract_title", "extract_links", "extract_word_count", "normalize_url", "url_notes",
    "extract_head", "detail_json", "thousands", "real_audit", "real_grid_has_issue", "real_query_total", "real_links", "real_inlink_counts", "body_hash", "sql_functions", "robots_allows", "sitemap_locations", "image_pass", "crawl_site", "crawl_site_failures", "replace_outlinks", "sitemap_first_writer", "landed_redirects", "follows",
)


@pytest.fixture(scope="module")
def db():
    return compare.connect(SF)


@pytest.fixture(scope="module")
def tables(spark):
    t = {k: v.cache() for k, v in crawl_tables(spark, SF).items()}
    t["issues"] = store.cut(audit.audit(t))
    t["pages"] = store.cut(audit.with_issue_flag(t["pages"], t["issues"]))
    return t


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, db, name):
    assert compare.differences(engine.QUERIES[name](spark, SF), db, engine.SQL[name]) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


GOOD = {
    "id": 1, "url": "https://a.com/", "status": 200, "kind": "html", "redirect_chain": [], "title": "x" * 40, "title_count": 1, "meta_description": "y" * 100, "h1": ["h"], "word_count": 500, "noindex": False, "canonical_url": None, "images": [], "links": [],
}
ROW = "id long, url string, status int, kind string, redirect_chain array<string>, title string, title_count int, meta_description string, h1 array<string>, word_count int, noindex boolean, canonical_url string, images array<struct<src: string, alt: string>>, links array<struct<href: string, target: string>>"
CASES = [
    ({}, {}), ({"title": "é" * 60}, {}), ({"title": "x" * 61}, {"title.too-long": "61 characters"}), ({"title": "x" * 29}, {"title.too-short": "29 characters"}), ({"title": ""}, {"title.too-short": "0 characters"}), ({"title": None}, {"title.missing": None}),
    ({"title_count": 2}, {"title.multiple": "2 <title> elements"}), ({"meta_description": "y" * 160}, {}), ({"meta_description": "y" * 161}, {"description.too-long": "161 characters"}), ({"meta_description": "y" * 69}, {"description.too-short": "69 characters"}), ({"meta_description": None}, {"description.missing": None}),
    ({"meta_description": "y" * 90 + "&hellip"}, {"description.truncated-entity": "&hellip"}), ({"meta_description": "y" * 90 + " &#x1F6"}, {"description.truncated-entity": "&#x1F6"}), ({"meta_description": "y" * 90 + " Q&A"}, {}), ({"meta_description": "y" * 90 + " a & b"}, {}), ({"meta_description": "y" * 90 + "&"}, {}),
    ({"word_count": 199}, {"content.thin": "199 words"}), ({"word_count": 200}, {}), ({"h1": []}, {"content.missing-h1": None}), ({"h1": ["a", ""]}, {"content.multiple-h1": "2 <h1> elements", "content.empty-h1": None}),
    ({"status": 404}, {"response.4xx": "HTTP 404"}), ({"status": 503, "kind": "pdf", "title": None}, {"response.5xx": "HTTP 503"}), ({"redirect_chain": ["a", "b"]}, {}), ({"redirect_chain": ["a", "b", "c"]}, {"response.redirect-chain": "3 redirects"}),
    ({"noindex": True}, {"indexability.noindex": None}), ({"canonical_url": "https://a.com/"}, {}), ({"canonical_url": "https://a.com/b"}, {"indexability.canonical-elsewhere": "https://a.com/b"}),
    ({"images": [{"src": "1", "alt": None}, {"src": "2", "alt": ""}, {"src": "3", "alt": None}]}, {"media.missing-alt": "2 of 3 images: 1"}), ({"links": [{"href": "//b", "target": "http://b.com/"}]}, {"response.mixed-content": "//b"}), ({"url": "http://a.com/", "links": [{"href": "//b", "target": "http://b.com/"}]}, {}),
]


def test_page_rules_at_their_bounds(spark):
    rows = spark.createDataFrame([GOOD | c | {"id": i} for i, (c, _) in enumerate(CASES)], ROW)
    got = {i: {} for i in range(len(CASES))}
    for r in page_findings(rows).collect():
        got[r["page_id"]][r["rule_id"]] = r["detail"]
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_page_rules_cost_one_scan(spark, tables):
    plan = page_findings(spark.createDataFrame([GOOD], ROW))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Python" not in plan
    shown = grid.grid_window(tables["pages"], grid.SortSpec("title"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in shown


def test_registry_refuses():
    r = Registry()
    r.add(PAGE_RULES[0])
    for bad in (PAGE_RULES[0], PageRule("Bad.Id", "notice", "", "")):
        with pytest.raises(RegistryError):
            r.add(bad)
    assert len(audit.standard_registry().rules) == 30


def test_filters_and_sorts():
    F_ = grid.Filter
    assert grid.supported_sorts((F_("url_contains", "x"),)) == ["url"]
    assert "word_count" not in grid.supported_sorts((F_("has_issue", "title.missing"),)) and "meta_description" in grid.supported_sorts((F_("has_issue"),))
    assert grid.supported_sorts((F_("word_count", 5, "lt"),)) == ["url", "status", "depth", "size", "word_count", "title"]
    with pytest.raises(grid.UnsupportedPair):
        grid.SortSpec("elapsed_ms", False, (F_("status", 400, "ge"),))


def test_windows_do_not_overlap(tables):
    sort = grid.SortSpec("depth", True)
    rows = lambda o, n: [r["id"] for r in grid.grid_window(tables["pages"], sort, o, n).collect()]
    assert rows(0, 10) + rows(10, 10) == rows(0, 20) and rows(10**6, 5) == []


def test_windows_after_a_row(tables):
    for column in ("title", "meta_description", "depth"):
        for down in (False, True):
            sort = grid.SortSpec(column, down)
            rows = [(r[column], r["id"]) for r in grid.grid_window(tables["pages"], sort, 0, 1000).collect()]
            for k in (0, 5, len(rows) - 3, len(rows) - 1):
                assert [(r[column], r["id"]) for r in grid.grid_window(tables["pages"], sort, 0, 1000, after=rows[k]).collect()] == rows[k + 1 :]


def test_injection_is_text(tables):
    for needle in ("'; drop table pages", "\\", "%' or 1=1 --"):
        assert grid.matching(tables["pages"], (grid.Filter("url_contains", needle),)).count() == 0


def test_structure_of_a_small_site(spark):
    urls = ["https://e.com/", "https://e.com/about", "https://e.com/blog/", "https://e.com/blog/a", "https://e.com/blog/b/c", "https://e.com/shop", "https://e.com/shop/x"]
    pages = spark.createDataFrame([(i, u, i == 3) for i, u in enumerate(urls)], "id long, url string, has_issue boolean")
    got = {(r["segment"], r["folder"], r["pages"], r["with_issues"], r["page_id"]) for r in lookups.structure(pages, "https://e.com/").collect()}
    assert got == {("", False, 1, 0, 0), ("about", False, 1, 0, 1), ("blog/", True, 3, 1, None), ("shop/", True, 2, 0, 5)}


def test_exports(tables, tmp_path):
    crawl = api.Crawl(None, tables=tables)
    rows = tables["pages"].sparkSession.createDataFrame([('Hello, "w"', None, True), ("", 1, False)], "t string, n int, b boolean")
    out = io.StringIO()
    assert export.write_csv(rows, out) == 2 and out.getvalue() == 't,n,b\n"Hello, ""w""",,1\n,1,0\n'
    out = io.StringIO()
    export.write_json(rows, out)
    assert json.loads(out.getvalue())[0] == {"b": True, "n": None, "t": 'Hello, "w"'}
    out = io.StringIO()
    export.write_json(rows.limit(0), out)
    assert out.getvalue() == "[]\n"
    for kind in ("csv", "xlsx", "docx", "pdf"):
        crawl.export(str(tmp_path / f"site.{kind}"))
    assert len(zipfile.ZipFile(tmp_path / "site.xlsx").namelist()) == 9 and (tmp_path / "site.pdf").read_bytes().startswith(b"%PDF")
    with pytest.raises(api.OutputExists):
        crawl.export(str(tmp_path / "site.csv"))
    with pytest.raises(export.UnknownFormat):
        export.format_of("x.doc")


def test_store_round_trip(spark, tables, tmp_path):
    store.save({k: tables[k] for k in ("pages", "issues")}, str(tmp_path / "c"))
    t = store.open_crawl(spark, str(tmp_path / "c"))
    assert t["pages"].count() == tables["pages"].count() and set(t) == set(schema.TABLES) and t["links"].count() == 0
    with pytest.raises(store.NotACrawl):
        store.open_crawl(spark, str(tmp_path / "none"))


def test_settings():
    for bad in ({"concurrency": 0}, {"max_urls": 0}, {"seed": "example"}):
        with pytest.raises(api.CrawlError):
            api.CrawlSettings(**({"seed": "https://a.com"} | bad))
    assert api.seed_suggestion("example.com/x") == "https://example.com/x"


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "y")], "url string, id int, seq int, v string")
    new = spark.createDataFrame([("a", 9, 2, "z"), ("a", 8, 3, None)], "url string, id int, seq int, v string")
    assert {tuple(r) for r in frontier.upsert(old, new, "url", "seq", "id").collect()} == {("a", 1, 3, None), ("b", 2, 1, "y")}
    assert {tuple(r) for r in frontier.first_writer_wins(old.unionByName(new), "url", "seq").collect()} == {("a", 1, 1, "x"), ("b", 2, 1, "y")}


def test_generated_site_is_reachable(spark):
    links = graph.site_links(spark, 60)
    seen = frontier.bfs_depths(links.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")), spark.createDataFrame([("0",)], "url string"))
    assert seen.count() == 60
    records = extraction.extract_records(graph.render(graph.site_pages(spark, 60), links))
    assert records.filter("title is not null and size(h1) = 1").count() == 60


def test_depths_have_no_bound(spark, tables):
    url = {r["id"]: r["url"] for r in tables["pages"].select("id", "url").collect()}
    out = {}
    for r in tables["links"].select("source_page_id", "target_url").collect():
        out.setdefault(url.get(r["source_page_id"]), []).append(r["target_url"])
    level = [url[1]]
    want = {url[1]: 0}
    while level:
        level = sorted({v for u in level for v in out.get(u, []) if v is not None} - set(want))
        want |= {v: max(want.values()) + 1 for v in level}
    assert max(want.values()) > 6
    assert {r["url"]: r["depth"] for r in engine.QUERIES["bfs_depth"](spark, SF).collect()} == want


def test_extraction_keeps_only_crawlable_pages(spark):
    rows = spark.createDataFrame([("https://A.com", "<title>a</title>", "text/html"), ("mailto:x", "<p>", "text/html"), ("https://a.com/p", "%PDF-1", "text/html"), ("https://a.com/n", None, None)], "url string, html string, content_type string")
    got = {r["url"]: (r["kind"], r["content_type_mismatch"], r["title"]) for r in extraction.extract_records(rows).collect()}
    assert got == {"https://a.com/": ("html", False, "a"), "https://a.com/p": ("html", True, None), "https://a.com/n": ("undeclared", False, None)}


def test_stream(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    q = ingest.start_ingest(ingest.page_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "mark"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/records")).count() == pages.count() and spark.read.parquet(str(tmp_path / "out/issues")).filter("rule_id = 'description.missing'").count() == pages.count()
