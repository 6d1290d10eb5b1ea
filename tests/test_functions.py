import pytest

from trawlspark.functions import body, robots
from trawlspark.functions.html import extract, robots_directives
from trawlspark.functions.text import collapse, fnv1a64
from trawlspark.functions.urls import canonical_url, percent_encode_needle, resolve
from trawlspark.sources import http, sitemaps

BASE = "https://example.com/shop/index.html"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("https://a.com/p#section", "https://a.com/p"), ("HTTPS://Example.COM/Path", "https://example.com/Path"), ("http://a.com:80/p", "http://a.com/p"), ("http://a.com:8080/p", "http://a.com:8080/p"),
        ("https://a.com", "https://a.com/"), ("https://bücher.de/p", "https://xn--bcher-kva.de/p"), ("https://a.com/p?b=2&a=1", "https://a.com/p?b=2&a=1"), ("https://a.com/p?", "https://a.com/p?"),
        ("https://a.com/a/b/../c", "https://a.com/a/c"), ("https://a.com/a/./b/", "https://a.com/a/b/"), ("https://a.com/é", "https://a.com/%C3%A9"), ("mailto:a@b.com", None), ("ftp://a.com/f", None), ("not a url", None), ("", None), ("http://", None), (None, None),
    ],
)
def test_canonical_url(text, want):
    assert canonical_url(text) == want
    if want:
        assert canonical_url(want) == want


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("https://a.com/dir/page", "sibling", "https://a.com/dir/sibling"), ("https://a.com/dir/page", "/root", "https://a.com/root"), ("https://a.com/dir/page", "../up", "https://a.com/up"), ("https://a.com/dir/page", "//o.com/x", "https://o.com/x"),
        ("https://a.com/dir/page", "#x", "https://a.com/dir/page"), ("https://a.com/dir/page", "", "https://a.com/dir/page"), ("https://a.com/d/p?a=1", "?b=2", "https://a.com/d/p?b=2"), ("https://a.com/p", "javascript:void(0)", None), ("https://a.com/p", None, None),
    ],
)
def test_resolve(base, href, want):
    assert resolve(base, href) == want


def test_malformed_markup_yields_what_it_supports():
    html = "<html><head><title>One <b>two</title><meta name=Description content='x &amp; y'><link rel='CANONICAL x' href=/c><body><h1>Open heading\n<p>text <a href='/1'>first <a href='/2'>second <img src=/i.png alt=bare><div>tail</body>"
    m = extract(html, BASE)
    assert (m.title, m.title_count, m.meta_description) == ("One <b>two", 1, "x & y")
    assert m.h1 == ["Open heading text first second tail"]
    assert [(x["href"], x["target"], x["text"]) for x in m.links] == [("/1", "https://example.com/1", "first"), ("/2", "https://example.com/2", "second tail")]
    assert m.images == [{"src": "/i.png", "alt": "bare"}]
    assert m.canonical_url == "https://example.com/c"
    assert len(m.words) == 6


def test_absent_is_not_empty():
    m, e = extract("<p>no body element", BASE), extract("<title></title><body> </body><img>", BASE)
    assert (m.title, m.title_count, m.meta_description, m.body_hash, m.words) == (None, 0, None, None, [])
    assert (e.title, e.title_count, e.body_hash, e.images) == ("", 1, None, [{"src": "", "alt": None}])


def test_code_and_comments_are_no_words_and_tags_part_them():
    m = extract("<body><b>one</b><b>two</b><script>var a = '</p>';</script><style>p {}</style><!-- not this -->three&nbsp;four</body>", BASE)
    assert m.words == ["one", "two", "three&nbsp;four"]
    assert m.body_hash == fnv1a64(b"one two three&nbsp;four")


def test_hash_known_answers():
    assert [fnv1a64(x) & 0xFFFFFFFFFFFFFFFF for x in (b"", b"a", b"foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]


def test_robots_meta_and_links_nofollow():
    assert robots_directives(" NONE , noarchive, max-snippet:5") == {"noindex", "nofollow", "noarchive"}
    m = extract('<meta name=robots content=index><meta name=Googlebot content=nofollow><a href="/x">y</a>', BASE)
    assert m.robots == {"nofollow"} and m.links[0]["nofollow"]


def test_collapse_and_needle():
    assert collapse(" a&nbsp;\n b &amp;amp; &amp &#x41; ") == "a b &amp; &amp A"
    assert percent_encode_needle("a é%") == "a %C3%A9%"


def test_bodies():
    assert (body.media_type("Text/HTML; charset=\"UTF-8\""), body.charset("text/html; charset=\"UTF-8\""), body.media_type(" ")) == ("text/html", "utf-8", None)
    assert [body.classify(x) for x in ("text/html", "application/pdf", "image/webp", "text/css", None)] == ["html", "pdf", "image", "other", "undeclared"]
    assert body.is_mismatch("html", b"%PDF-1.4") and not body.is_mismatch("undeclared", b"%PDF-") and not body.is_mismatch("html", b"  <!DOCTYPE HTML>")


def test_robots_rules():
    allows = lambda text, path: robots.parse(text, "TrawlBot").allows(path)
    assert not allows("User-agent: *\nDisallow: /a/\nAllow: /a/b/", "/a/x") and allows("User-agent: *\nDisallow: /a/\nAllow: /a/b/", "/a/b/x")
    assert allows("User-agent: *\nDisallow: /p\nAllow: /p", "/p") and allows("User-agent: *\nDisallow:", "/x")
    assert not allows("User-agent: *\nDisallow: /*.pdf$", "/d/r.pdf") and allows("User-agent: *\nDisallow: /*.pdf$", "/d/r.pdf?q")
    assert allows("User-agent: *\nDisallow: /\n\nUser-agent: trawlbot\nDisallow: /x", "/y") and allows("User-agent: Other\nDisallow: /", "/y")
    assert allows("Disallow: /before-any-agent", "/before-any-agent") and allows("<!DOCTYPE html><html>", "/a") and not allows("﻿User-agent: *\r\nDisallow: /x\r\n", "/x")
    r = robots.parse("Sitemap: https://a.com/s.xml\nUser-agent: TrawlBot\nCrawl-delay: 2", "TrawlBot")
    assert r.crawl_delay == 2 and r.sitemaps == ["https://a.com/s.xml"]
    assert [robots.from_response(s, "User-agent: *\nDisallow: /", "t").allows("/") for s in (200, 404, 503)] == [False, True, False]


def test_sitemaps():
    xml = "<urlset><url><loc> https://a.com/?a=1&amp;b=2 </loc><image:loc>https://a.com/i.png</image:loc></url><sm:loc>https://a.com/2</sm:loc><loc>https://a.com/2</loc></urlset>"
    assert sitemaps.parse(xml).locations == ["https://a.com/?a=1&b=2", "https://a.com/2", "https://a.com/2"]
    assert not sitemaps.parse(xml, 3).truncated and sitemaps.parse(xml, 2).truncated
    docs = {"https://a.com/i.xml": "<sitemapindex><loc>https://a.com/1.xml</loc></sitemapindex>", "https://a.com/1.xml": "<urlset><loc>https://a.com/x</loc></urlset>"}
    files, urls = sitemaps.discover("https://a.com/", ["https://a.com/i.xml", "https://a.com/gone.xml"], lambda u: (200, docs[u]) if u in docs else None)
    assert {(f["url"], f["status"], f["found_by"]) for f in files} == {("https://a.com/i.xml", 200, "robots"), ("https://a.com/gone.xml", 0, "robots"), ("https://a.com/1.xml", 200, "https://a.com/i.xml")}
    assert urls == [("https://a.com/x", "https://a.com/1.xml")]
    assert sitemaps.discover("https://a.com/", [], lambda u: (200, "<html>")) == ([], [])


def test_redirects_and_retries():
    site = {"https://a.com/1": http.Response(301, {"location": "/2"}), "https://a.com/2": http.Response(302, {"location": "/3"}), "https://a.com/3": http.Response(200), "https://a.com/l": http.Response(301, {"location": "/l"}), "https://a.com/n": http.Response(301)}
    go = lambda u, **k: http.follow(lambda m, x: site[x], u, **k)
    assert (go("https://a.com/1").final, len(go("https://a.com/1").hops)) == ("https://a.com/3", 2)
    assert go("https://a.com/l").outcome.startswith("redirect loop") and len(go("https://a.com/l").hops) == 1
    assert go("https://a.com/n").outcome == "no location" and go("https://a.com/1", most=1).outcome.startswith("more than")
    assert go("https://a.com/1", allowed=lambda u: f"robots.txt disallows {u}" if u.endswith("2") else None).outcome == "robots.txt disallows https://a.com/2"
    answers, waits = [http.Response(503), http.Response(429, {"retry-after": "3"}), http.Response(200)], []
    assert http.fetch(lambda m, u: answers.pop(0), "u", sleep=waits.append).status == 200 and waits == [0.5, 3.0]
    assert http.wait_before(1, 61) is None and http.wait_before(1, 0.1) == 0.5 and http.wait_before(3, None) is None
