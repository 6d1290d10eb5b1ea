import pytest
from pyspark.sql import functions as F

from trawlspark import api, crawl
from trawlspark.functions import body
from trawlspark.functions.columns import is_internal
from trawlspark.functions.html import extract
from trawlspark.functions.text import fnv1a64, fnv1a64_many
from trawlspark.functions.urls import canonical_url
from trawlspark.operators import records
from trawlspark.sources import graph, http, sitemaps


def site():
    """A factory that is no name of this module, since executors can't import it."""

    def make_site():
        """A small site: page, redirects, a loop, a forbidden page, a missing page, images, a link out and one marked nofollow."""
        pages = {
            "/robots.txt": (200, {}, "User-agent: *\nDisallow: /private\nSitemap: https://t.invalid/map.xml"), "/map.xml": (200, {}, '<urlset><loc a="1">https://t.invalid/</loc><loc>https://t.invalid/unlinked</loc></urlset>'),
            "/": (200, {"content-type": "text/html"}, '<html><head><title>Home</title></head><body><a href="/a">a</a><a href="/old">o</a><a href="/loop">l</a><a href="/private/x">p</a><a href="/gone">g</a><a href="https://other.invalid/">x</a><a rel=nofollow href="/no">n</a><img src="/i/1.png"><img src="/i/dead.png"></body></html>'),
            "/a": (200, {"content-type": "text/html"}, '<html><body><a href="/b">b</a><img src="i/1.png"></body></html>'), "/b": (200, {"content-type": "text/html"}, "<html><body>end</body></html>"),
            "/old": (301, {"location": "/new"}, ""), "/new": (302, {"location": "/b2"}, ""), "/b2": (200, {"content-type": "text/html"}, "<html><body>moved here</body></html>"), "/loop": (301, {"location": "/loop"}, ""),
            "/i/1.png": (200, {"content-type": "image/png", "content-length": "204800"}, ""),
        }

        def transport(method, url):
            path = "/" + url.split("://", 1)[1].partition("/")[2]
            if path == "/i/dead.png":
                raise ConnectionError("refused")
            status, headers, text = pages.get(path, (404, {"content-type": "text/html"}, "<title>Not here</title>"))
            return http.Response(status, headers, text.encode())

        return transport

    return make_site


make_site = site()


@pytest.fixture(scope="module")
def tables(spark):
    life, told = crawl.Lifecycle(), []
    http_wait, http.FIRST_WAIT = http.FIRST_WAIT, 0.0
    t = crawl.run_crawl(spark, "https://t.invalid", make_site, life, on_progress=told.append)
    http.FIRST_WAIT = http_wait
    t["_life"], t["_told"] = life, told
    return t


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_crawl_finds_pages_redirects_and_failures(tables):
    u = "https://t.invalid"
    assert rows(tables["pages"], "url", "depth", "status") == {(f"{u}/", 0, 200), (f"{u}/a", 1, 200), (f"{u}/b", 2, 200), (f"{u}/b2", 1, 200), (f"{u}/gone", 1, 404)}
    assert rows(tables["crawl_redirects"], "source_url", "status", "final_url", "outcome") == {(f"{u}/old", 301, f"{u}/b2", "landed"), (f"{u}/loop", 301, None, f"redirect loop at {u}/loop")}
    assert rows(tables["crawl_failures"], "url", "reason") == {(f"{u}/private/x", f"robots.txt disallows {u}/private/x")}
    assert rows(records.landed_redirects(tables), "source_url", "page_status", "hops") == {(f"{u}/old", 200, 2)}
    assert {r["url"] for r in tables["frontier"].collect()} == {f"{u}{p}" for p in ("/", "/a", "/b", "/old", "/loop", "/private/x", "/gone")}
    life = tables["_life"]
    assert (life.status, life.admitted, life.written, life.by_class[2], life.by_class[4], life.failed) == ("completed", 7, 5, 4, 1, 2)
    assert rows(life.live(), "url") == rows(tables["pages"], "url") and crawl.Lifecycle().live() is None
    assert tables["_told"][-1].status == "completed" and tables["_told"][0].queued == 1 and tables["_told"][-1].urls_per_second > 0


def test_crawl_checks_images_sitemaps_and_rules(tables):
    u = "https://t.invalid"
    assert rows(tables["resources"], "url", "status", "content_length") == {(f"{u}/i/1.png", 200, 204800)}
    assert rows(tables["sitemaps"], "url", "status", "urls", "found_by") == {(f"{u}/map.xml", 200, 2, "robots")}
    assert rows(tables["sitemap_urls"], "url") == {(f"{u}/",), (f"{u}/unlinked",)}
    assert rows(tables["robots_files"], "origin", "status") == {(u, 200)}
    found = rows(tables["issues"], "rule_id", "url")
    assert {("media.oversized-image", f"{u}/i/1.png"), ("response.redirect-loop", f"{u}/loop"), ("indexability.blocked-but-linked", f"{u}/private/x"), ("links.broken-internal", f"{u}/gone"), ("links.orphan-page", f"{u}/b2")} <= found
    assert rows(tables["pages"].filter("has_issue"), "url") >= {(f"{u}/gone",)}


def test_limits_and_resume(spark, tables):
    life = crawl.Lifecycle(max_urls=2)
    t = crawl.run_crawl(spark, "https://t.invalid/", make_site, life, check_images=False)
    assert (life.status, life.admitted, t["pages"].count()) == ("count limit reached", 2, 2)
    pending, seen = crawl.resume_state(t)
    more = crawl.run_crawl(spark, "https://t.invalid/", make_site, crawl.Lifecycle(), check_images=False, pending=pending, seen=seen, before=t)
    same = ("url", "depth", "status")
    assert rows(more["pages"], *same) == rows(tables["pages"], *same) and more["pages"].select("id").distinct().count() == 5
    assert rows(more["crawl_redirects"], "source_url") == rows(tables["crawl_redirects"], "source_url") and rows(more["issues"], "rule_id", "url") >= {("links.broken-internal", "https://t.invalid/gone")}
    shallow = crawl.run_crawl(spark, "https://t.invalid/", make_site, crawl.Lifecycle(max_depth=0), check_images=False)
    assert rows(shallow["pages"], "url") == {("https://t.invalid/",)}


def test_lifecycle():
    now = [0.0]
    life = crawl.Lifecycle(max_seconds=10, clock=lambda: now[0])
    now[0] = 4
    assert life.pause() and not life.pause() and life.progress().status == "paused"
    now[0] = 100
    assert life.resume() and not life.resume() and life.elapsed == 4 and life.admit(3) == 3
    now[0] = 106
    assert life.admit(3) == 0 and life.status == "time limit reached" and not life.cancel() and not life.complete()
    other = crawl.Lifecycle()
    other.record(700, 2)
    other.record(204, 1)
    assert other.cancel() and other.admit(1) == 0 and (other.failed, other.by_class[2]) == (2, 1)


def test_engine_runs_one_crawl_at_a_time(spark, tmp_path):
    engine = api.Engine(spark)
    with pytest.raises(api.NoCrawlOpen):
        engine.current_crawl()
    life = engine.start_crawl(api.CrawlSettings("https://t.invalid/", max_depth=1), str(tmp_path / "c"), make_site)
    if not engine.may_start():
        with pytest.raises(api.AlreadyRunning):
            engine.start_crawl(api.CrawlSettings("https://t.invalid/"), str(tmp_path / "d"), make_site)
    engine.wait(120)
    assert life.status == "completed" and engine.current_crawl().sitemap_files().count() == 1 and not engine.pause_crawl()
    with pytest.raises(api.Missing):
        engine.current_crawl().page_detail(-5)
    assert len(engine.rules()) == 30 and engine.engine_info()["rules"] == 30 and engine.suggest_output("https://www.A.com/x", str(tmp_path)) == str(tmp_path / "a-com.crawl")


def test_robots_are_fetched_once_for_an_origin():
    asked = []

    def transport(method, url):
        asked.append(url)
        return {"https://a.com/robots.txt": http.Response(301, {"location": "/r"}), "https://a.com/r": http.Response(200, {}, b"User-agent: *\nDisallow: /x")}.get(url, http.Response(503 if "down" in url else 404))

    cache = http.RobotsCache(transport, sleep=lambda s: None)
    assert cache.refused("https://a.com/x/1") == "robots.txt disallows https://a.com/x/1" and cache.refused("https://a.com/y") is None and asked == ["https://a.com/robots.txt", "https://a.com/r"]
    assert cache.refused("https://down.com/y") == "robots.txt could not be read: HTTP 503" and [x["status"] for x in cache.rows] == [200, 503]


def test_pace_is_even():
    now, slept = [0.0], []
    pace = http.Pace(2.0, lambda: now[0], slept.append)
    pace.wait(), pace.wait(), pace.wait()
    assert slept == [2.0, 4.0]
    h = http.head(lambda m, u: http.Response(200, {"content-length": "77", "content-type": "image/png"}), "https://a.com/i")
    assert (h.content_length, h.content_type) == (77, "image/png") and http.head(lambda m, u: http.Response(200), "u").content_length is None


def test_sitemap_order():
    asked = []

    def fetched(url):
        asked.append(url.removeprefix("https://a.com"))
        return (404, "<loc>https://a.com/listed</loc>") if url.endswith("/wp-sitemap.xml") else None

    files, urls = sitemaps.discover("https://a.com", [], fetched)
    assert asked == ["/sitemap/0", "/sitemap/sitemap.xml", "/sitemap-index.xml", "/wp-sitemap.xml"] and urls == [("https://a.com/listed", "https://a.com/wp-sitemap.xml")] and files[0]["status"] == 404
    asked.clear()
    sitemaps.discover("https://a.com", ["https://a.com/1", "https://a.com/2", "no address"], fetched)
    assert asked == ["/2", "/1"]
    index = "<sitemapindex>" + "".join(f"<loc>https://a.com/{k}.xml</loc>" for k in range(80)) + "</sitemapindex>"
    files, _ = sitemaps.discover("https://a.com", ["https://a.com/i"], lambda u: (200, index if u.endswith("/i") else "<urlset/>"))
    assert len(files) == 50 and [f["truncated"] for f in files] == [False] * 49 + [True]


def test_corrected_definitions(spark):
    assert [api.output_name(x) for x in ("https://www.Shop.Example.com/a b/", "example.com", "https://")] == ["shop-example-com.crawl", "example-com.crawl", "crawl.crawl"]
    assert body.sniff(b" " * 510 + b"<html>") is None and body.sniff(b" " * 500 + b"<html>") == "html" and body.sniff(b"\n\t<!DOCTYPE html>") == "html"
    pairs = [("http://a.de:443/", "https://a.de/", False), ("http://a.de/", "https://a.de/", True), ("https://a.de:8443/", "https://a.de/", False), ("https://www.a.de:8443/", "https://a.de:8443/", True), ("http://a.de:443/", "http://a.de:443/", True)]
    got = spark.createDataFrame([p[:2] for p in pairs], "u string, s string").select(is_internal(F.col("u"), F.col("s"))).collect()
    assert [r[0] for r in got] == [p[2] for p in pairs]
    assert [canonical_url(x) for x in ("http://0x10.2/", "http://3232235777/", "http://09.1/", "http://1.2.3.400/", "https://straße.de/", "https://a.1x/")] == ["http://16.0.0.2/", "http://192.168.1.1/", None, None, "https://xn--strae-oqa.de/", "https://a.1x/"]
    texts = [b"x" * k for k in range(130)] + [b"", bytes(range(256)) * 9]
    assert fnv1a64_many(texts).tolist() == [fnv1a64(t) for t in texts]


def test_one_record_for_each_url(spark):
    from trawlspark.operators.extraction import extract_records

    p = spark.createDataFrame([("https://a.com/#x", "<title>deep</title>", 3), ("https://a.com", "<title>near</title>", 1)], "url string, html string, depth int")
    t = records.crawl_tables_of(extract_records(p))
    assert [(r["url"], r["title"], r["depth"]) for r in t["pages"].collect()] == [("https://a.com/", "near", 1)] and t["issues"].count() == 0


def wide(delay=""):
    def factory():
        """A home page that links to 90 others, of which one is forbidden; /p/5 shows two images."""

        def transport(method, url):
            path = "/" + url.split("://", 1)[1].partition("/")[2]
            if path == "/robots.txt":
                return http.Response(200, {}, f"User-agent: *\n{delay}\nDisallow: /p/7$".encode())
            body = "".join(f'<a href="/p/{k}">{k}</a>' for k in range(90)) if path == "/" else '<img src="/i/1.png"><img src="/i/2.png">' if path == "/p/5" else f"page {path}"
            return http.Response(200, {"content-type": "text/html"}, f"<html><body>{body}</body></html>".encode())

        return transport

    return factory


def test_a_large_host_is_asked_and_parsed_by_several_tasks(spark, monkeypatch):
    cut, tasks = crawl.store.cut, []

    def watched(df, *more):
        out = cut(df, *more)
        if "chain" in df.columns or "body_hash" in df.columns and "id" not in df.columns:
            tasks.append(("fetched" if "chain" in df.columns else "parsed", out.count(), out.select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).distinct().count()))
        return out

    monkeypatch.setattr(crawl.store, "cut", watched)
    monkeypatch.setattr(http, "SHARE_URLS", 20, raising=False)
    monkeypatch.setattr(crawl, "FILE_ROWS", 8, raising=False)
    life = crawl.Lifecycle()
    t = crawl.run_crawl(spark, "https://w.invalid/", wide(), life)
    assert tasks[2][2] == 4 and tasks[3][2] > 1
    assert [x[:2] for x in tasks] == [("fetched", 2), ("parsed", 1), ("fetched", 90), ("parsed", 89)]  # the first level's robots file is a row
    u = "https://w.invalid"
    assert rows(t["pages"], "url", "depth", "status") == {(f"{u}/", 0, 200)} | {(f"{u}/p/{k}", 1, 200) for k in range(90) if k != 7}
    assert rows(t["crawl_failures"], "url", "reason") == {(f"{u}/p/7", f"robots.txt disallows {u}/p/7")} and rows(t["robots_files"], "origin", "status") == {(u, 200)}
    assert rows(t["resources"], "url") == {(f"{u}/i/1.png",), (f"{u}/i/2.png",)} and (life.written, life.failed, life.by_class[2]) == (90, 1, 90)


def test_hosts_are_shared_within_their_limits(spark, monkeypatch):
    monkeypatch.setattr(http, "SHARE_URLS", 20)
    asked = []

    def cache(delay="", config=http.FetchConfig()):
        ask = wide(delay)()
        return http.RobotsCache(lambda m, u: asked.append(u) or ask(m, u), config)

    urls = lambda *hosts: spark.createDataFrame([(f"https://{h}.invalid/p/{k}", 1) for h, n in hosts for k in range(n)], "url string, depth int")
    one, known = urls(("w", 90), ("x", 3)), cache()
    shared, n = http.shares(one, known)
    assert {h: s.widths for h, s in shared.items()} == {"w.invalid:443": (1, 1, 1, 1)} and n == min(5, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert http.shares(one, known)[0] == shared and asked == ["https://w.invalid/robots.txt"]
    assert http.shares(one, cache(config=http.FetchConfig(per_host=3)))[0]["w.invalid:443"].widths == (1, 1, 1)
    assert {s.widths for s in http.shares(urls(("w", 90), ("x", 30)), cache(config=http.FetchConfig(per_host=5)))[0].values()} == {(3, 2)}
    # A pace is one task's to keep; a file that can't be read forbids all; with large hosts for all cores there is nothing to divide.
    for c, u in ((cache("Crawl-delay: 2"), one), (cache(config=http.FetchConfig(delay=0.1)), one), (cache(config=http.FetchConfig(per_host=1)), one), (cache("#" * 70_000), one), (cache(), urls(*((f"h{k}", 21) for k in range(5)))), (cache(), urls(("w", 20)))):
        assert http.shares(u, c) == ({}, None)
    assert http.shares(one, http.RobotsCache(lambda m, u: http.Response(500))) == ({}, None)
    got = http.fetch_all(one, wide(), partitions=n, shared=shared).withColumn("p", F.spark_partition_id())
    pages = got.filter("kind = 'page'")
    assert rows(pages, "url", "depth") == rows(one, "url", "depth") and pages.count() == 93 and pages.filter("outcome <> 'landed'").count() == 1
    assert pages.filter("url like '%w.inv%'").select("p").distinct().count() == 4 and pages.filter("url like '%x.inv%'").select("p").distinct().count() == 1
    assert rows(got.filter("kind = 'robots'"), "url") == {("https://x.invalid",)}
    heads = http.head_all(one.select("url"), wide(), partitions=n, shared=shared).withColumn("p", F.spark_partition_id())
    assert heads.count() == 92 and heads.filter("url like '%w.inv%'").select("p").distinct().count() == 4


def test_difficult_answers(spark):
    waits = []
    ask = graph.difficult_site(waits.append)
    go = lambda path: http.follow(ask, f"https://d.invalid{path}", sleep=lambda s: None)
    assert (go("/redirect-chain/3").final, len(go("/redirect-chain/3").hops)) == ("https://d.invalid/redirect-chain/0", 3) and go("/redirect-chain/99").outcome == "more than 10 redirects"
    assert go("/redirect-loop/3/0").outcome == "redirect loop at https://d.invalid/redirect-loop/3/0" and len(go("/redirect-loop/3/0").hops) == 3
    assert go("/slow/90000").response.status == 200 and waits == [30.0] and go("/status/503").response.status == 503 and go("/none").response.status == 404
    assert [http.head(ask, f"https://d.invalid/static/img-{k}.jpg").content_length for k in (1, 3, 4)] == [20 << 10, None, 300 << 10]
    urls = spark.createDataFrame([(f"https://d.invalid{p}", 0) for p in ("/huge/9", "/malformed", "/redirect-loop/2/0")], "url string, depth int")
    got = {r["url"].rpartition("invalid")[2]: r for r in http.fetch_all(urls, graph.difficult_site).collect() if r["kind"] == "page"}
    assert got["/huge/9"]["truncated"] and len(got["/huge/9"]["html"]) == http.MAX_BODY and got["/redirect-loop/2/0"]["outcome"].startswith("redirect loop")
    links = extract(got["/malformed"]["html"], "https://d.invalid/malformed").links
    assert [x["target"] for x in links] == ["https://d.invalid/first", "https://d.invalid/second"]
