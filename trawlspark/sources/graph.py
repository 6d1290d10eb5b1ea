"""A deterministic site of any size, from hashes of page numbers: a spanning tree, navigation and cross links."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .http import Response

NAVIGATION, EXTRA, BRANCH = 6, 14, 8
#: What a request to the difficult site can ask for at most.
MOST_HOPS, LONGEST_MS, MOST_MB = 20, 30_000, 16


def _draw(seed: int, salt: str, n: int | Column, *more: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id"), *more), F.lit(n) if isinstance(n, int) else n)


def site_pages(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """id, url, parent, has_description, noindex, n_images: about 12 % without description, 3 % noindex, up to five images."""
    p = spark.range(n).withColumn("parent", F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / BRANCH)))
    return p.select("id", F.concat(F.lit("https://site.invalid/p/"), F.col("id")).alias("url"), "parent", (_draw(seed, "description", 100) >= 12).alias("has_description"), (_draw(seed, "noindex", 100) < 3).alias("noindex"), _draw(seed, "images", 6).cast("int").alias("n_images"))


def site_links(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """source, target, kind, nofollow: every page is reached from page 0 through the tree."""
    p = spark.range(n)
    tree = p.filter("id > 0").select(F.floor((F.col("id") - 1) / BRANCH).alias("source"), F.col("id").alias("target"), F.lit("tree").alias("kind"))
    nav = p.select(F.col("id").alias("source"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(NAVIGATION, n) - 1).cast("long"))).alias("target")).withColumn("kind", F.lit("nav"))
    cross = p.select("id", F.explode(F.sequence(F.lit(0), F.lit(EXTRA - 1))).alias("k")).select(F.col("id").alias("source"), _draw(seed, "cross", n, F.col("k")).alias("target"), F.lit("cross").alias("kind"))
    every = tree.unionByName(nav).unionByName(cross)
    return every.withColumn("nofollow", F.pmod(F.xxhash64(F.lit(seed), "source", "target", "kind"), F.lit(4)) == 0)


def render(pages: DataFrame, links: DataFrame) -> DataFrame:
    """id, url, html: a page for each row, native text templates."""
    own = links.groupBy(F.col("source").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<a href="/p/'), "target", F.lit('">page '), "target", F.lit("</a>")))), "\n").alias("anchors"))
    head = F.concat(F.lit("<!DOCTYPE html><html><head><title>Page "), F.col("id"), F.lit(" of the generated site</title>"), F.when(F.col("has_description"), F.concat(F.lit('<meta name="description" content="What page '), F.col("id"), F.lit(' of the generated site is about.">'))).otherwise(""), F.when(F.col("noindex"), '<meta name="robots" content="noindex">').otherwise(""), F.lit("</head><body><h1>Page "), F.col("id"), F.lit("</h1>"))
    return pages.join(own, "id", "left").select("id", "url", F.concat(head, F.coalesce("anchors", F.lit("")), F.lit("</body></html>")).alias("html"))


def difficult_site(sleep: Callable[[float], None] = time.sleep) -> Callable[[str, str], Response]:
    """A transport for what goes wrong on the web: /redirect-chain/N, /redirect-loop/SIZE/STEP, /slow/MS, /huge/MB, /malformed, /status/CODE, and
    images /static/img-K.jpg, of which the third is missing and the fourth has 300 KB. Numbers are cut to the limits above."""
    page = {"content-type": "text/html; charset=utf-8"}

    def titled(name: str) -> Response:
        return Response(200, page, f"<!DOCTYPE html><html><head><title>{name}</title></head><body><h1>{name}</h1></body></html>".encode())

    def chain(n: int) -> Response:
        left = min(n, MOST_HOPS)
        return Response(301, {"location": f"/redirect-chain/{left - 1}"}) if left else titled("End of the chain")

    def loop(size: int, step: int) -> Response:
        return Response(302, {"location": f"/redirect-loop/{max(1, size)}/{(step + 1) % max(1, size)}"})

    def slow(ms: int) -> Response:
        sleep(min(ms, LONGEST_MS) / 1000)
        return titled("Slow")

    def huge(mb: int) -> Response:
        line = b"<p>words that fill a very large page, line after line after line</p>\n"
        return Response(200, page, b"<html><head><title>Huge</title></head><body>" + line * (max(1, min(mb, MOST_MB)) * (1 << 20) // len(line) + 1))

    def image(k: int) -> Response:
        size = {4: 300 << 10}.get(k, 20 << 10)
        return Response(404) if k == 3 else Response(200, {"content-type": "image/jpeg", "content-length": str(size)}, bytes(size))

    def malformed() -> Response:
        return Response(200, page, b"<html><head><title>Not well formed</title><body><p>open <a href=/first>one<div><b>more <a href='/second'>two</a> 1 < 2 <odd tag=x><p>end")

    routes = ((r"/redirect-chain/(\d+)", chain), (r"/redirect-loop/(\d+)/(\d+)", loop), (r"/slow/(\d+)", slow), (r"/huge/(\d+)", huge), (r"/status/(\d+)", lambda code: Response(code, {"content-type": "text/plain"}, b"status")), (r"/static/img-(\d+)\.jpg", image), (r"/malformed", malformed))

    def transport(method: str, url: str) -> Response:
        path = "/" + url.split("://", 1)[-1].partition("/")[2]
        for pattern, answer in routes:
            m = re.fullmatch(pattern, path)
            if m:
                r = answer(*map(int, m.groups()))
                return Response(r.status, r.headers) if method == "HEAD" else r
        return Response(404)

    return transport
