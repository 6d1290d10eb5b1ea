"""A deterministic crawl over the pages table, by integer formulas on page_id that Spark and DuckDB evaluate alike.

The SQL text of the base tables is shared with the oracles; what is asked of them is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URL = "CASE WHEN {0} = 1 THEN 'https://e.com/' WHEN {0} % 5 = 0 THEN concat('https://e.com/blog/post-', {0}) ELSE concat('https://e.com/section/word-', {0}) END"

M = f"""SELECT id, {URL.format('id')} AS url,
 CASE WHEN id % 50 = 0 THEN 500 WHEN id % 20 = 0 THEN 404 WHEN id % 33 = 0 THEN 301 ELSE 200 END AS status,
 CASE WHEN id = 1 THEN 0 ELSE 1 + id % 4 END AS depth,
 18000 + id % 4000 + CASE WHEN id % 41 = 0 THEN 9000 ELSE 0 END AS size,
 CASE WHEN id % 25 = 0 THEN 'pdf' WHEN id % 40 = 0 THEN 'image' ELSE 'html' END AS kind,
 CASE WHEN id % 41 = 0 THEN 10 ELSE 100 + (id * 37) % 900 END AS word_count,
 7 + id % 40 AS elapsed_ms, id % 10 = 0 AS noindex, id % 35 = 0 AS nosnippet,
 CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN '' WHEN id % 23 = 0 THEN concat('Café ', repeat('long title ', 7)) WHEN id % 7 = 0 THEN concat('Shared title for page group number ', id % 3) ELSE concat('Title number ', id, ' with a few more words') END AS title,
 CASE WHEN id % 17 = 0 THEN 0 WHEN id % 29 = 0 THEN 2 ELSE 1 END AS title_count,
 CASE WHEN id % 8 = 0 THEN NULL WHEN id % 9 = 0 THEN '' WHEN id % 11 = 0 THEN repeat('d', 170) WHEN id % 13 = 0 THEN 'Tom &am' WHEN id % 6 = 0 THEN concat('Shared description ', id % 2) ELSE concat('Description ', id, ', a sentence of summary that is padded to be seventy characters or more.') END AS meta_description,
 CASE WHEN id % 24 = 12 AND id + 12 <= n THEN id + 12 WHEN id % 12 = 0 THEN (id * 7) % n + 1 WHEN id % 4 = 0 THEN id END AS canonical_id,
 CASE WHEN id % 15 = 0 THEN NULL WHEN id % 14 = 0 THEN id % 3 ELSE id * 2654435761 END AS body_hash,
 CASE WHEN id % 16 = 0 THEN 0 WHEN id % 18 = 0 THEN 2 ELSE 1 END AS h1_count, id % 21 = 0 AS h1_empty,
 CASE WHEN id % 30 = 0 THEN 3 WHEN id % 31 = 0 THEN 2 ELSE 0 END AS redirect_hops, id % 4 AS image_count, n
FROM (SELECT page_id + 1 AS id, (SELECT count(*) FROM pages) AS n FROM pages) b"""

# Links by their place on the page: 0 to 2 internal (targets with id % 9 = 0 stay unlinked), 3 external, 4 to a forbidden page.
L = f"""SELECT id * 10 + k AS id, id AS src, k, CASE k WHEN 3 THEN concat(CASE WHEN id % 7 = 2 THEN 'http' ELSE 'https' END, '://other.invalid/ref/', id) WHEN 4 THEN concat('https://e.com/private/', id - id % 25 + 7) ELSE {URL.format('tid')} END AS target_url
FROM (SELECT id, k, (id * 7 + k * 13) % n + 1 AS tid FROM m, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) x) y
WHERE CASE k WHEN 3 THEN true WHEN 4 THEN id % 25 IN (7, 8) ELSE tid % 9 <> 0 END"""

IMAGES = """SELECT id, j, concat('/img/', (id * 3 + j) % 50, '.png') AS src, CASE WHEN (id + j) % 3 = 0 AND id % 5 = 3 THEN NULL WHEN (id + j) % 3 = 1 THEN '' ELSE concat('Image ', j) END AS alt, (id * 3 + j) % 50 AS r
FROM m, (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) x WHERE j < image_count"""

RESOURCES = """SELECT DISTINCT concat('https://e.com/img/', r, '.png') AS url, CASE r % 10 WHEN 3 THEN 404 ELSE 200 END AS status,
 CASE r % 10 WHEN 4 THEN 307200 WHEN 5 THEN NULL WHEN 6 THEN 102400 ELSE 20480 END AS content_length, 'image/png' AS content_type FROM images"""

FAILURES = """SELECT concat('https://e.com/private/', id) AS url, CASE WHEN id % 2 = 0 THEN concat('robots.txt disallows https://e.com/private/', id) ELSE concat('timed out: https://e.com/private/', id) END AS reason
FROM m WHERE id % 25 = 7"""

REDIRECTS = f"""SELECT concat('https://e.com/old/', id) AS source_url, CASE WHEN id % 2 = 0 THEN 301 ELSE 302 END AS status, CASE WHEN id % 93 = 5 THEN NULL ELSE {URL.format('id')} END AS final_url,
 id % 4 + 1 AS hops, CASE WHEN id % 93 = 5 THEN concat('redirect loop at https://e.com/old/', id) ELSE 'landed' END AS outcome FROM m WHERE id % 31 = 5"""

SITEMAP = """SELECT url, 'https://e.com/sitemap.xml' AS source FROM m WHERE id % 3 <> 0
UNION ALL SELECT concat('https://e.com/unreached/', id) AS url, 'https://e.com/sitemap-2.xml' AS source FROM m WHERE id <= 20"""

FRONTIER = """SELECT url, depth FROM m UNION ALL SELECT url, 2 AS depth FROM failures UNION ALL SELECT source_url AS url, 1 AS depth FROM redirects
UNION ALL SELECT concat('https://e.com/queued/', id) AS url, 3 AS depth FROM m WHERE id % 40 = 9"""

SHARED = {"m": M, "l": L, "images": IMAGES, "resources": RESOURCES, "failures": FAILURES, "redirects": REDIRECTS, "sitemap_urls": SITEMAP, "frontier": FRONTIER}


def with_clause() -> str:
    """The shared tables for an oracle."""
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in SHARED.items())


def on_model_sql(sql: str) -> str:
    """sql over the shared tables."""
    return f"{with_clause()}\n{sql}"


def _sql(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    for name in views:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **views)


def base_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    # Counted once, and not by each of the many plans that read m.
    m = _sql(spark, M.replace("(SELECT count(*) FROM pages)", f"CAST({pages.count()} AS BIGINT)"), pages=pages)
    images = _sql(spark, IMAGES, m=m)
    failures, redirects = _sql(spark, FAILURES, m=m), _sql(spark, REDIRECTS, m=m)
    return {
        "m": m, "l": _sql(spark, L, m=m), "images": images, "resources": _sql(spark, RESOURCES, images=images), "failures": failures, "redirects": redirects,
        "sitemap_urls": _sql(spark, SITEMAP, m=m), "frontier": _sql(spark, FRONTIER, m=m, failures=failures, redirects=redirects),
    }


def crawl_tables(spark: SparkSession, sf_dir: str, truncated: bool = False) -> dict[str, DataFrame]:
    """The crawl tables of schema.TABLES, without issues."""
    b, c = base_tables(spark, sf_dir), F.col
    m = b["m"]
    address = F.expr(URL.format("canonical_id"))
    pages = m.select(
        c("id").cast("long").alias("id"), "url", c("status").cast("int").alias("status"), c("depth").cast("int").alias("depth"), c("size").cast("long").alias("size"), F.lit(False).alias("truncated"),
        F.when(c("kind") == "html", "text/html").when(c("kind") == "pdf", "application/pdf").otherwise("image/png").alias("content_type"), "kind", c("elapsed_ms").cast("int").alias("elapsed_ms"),
        "title", "meta_description", F.when(c("canonical_id").isNotNull(), address).alias("canonical"), F.when(c("canonical_id").isNotNull(), address).alias("canonical_url"),
        "noindex", "nosnippet", c("word_count").cast("int").alias("word_count"), c("title_count").cast("int").alias("title_count"), c("body_hash").cast("long").alias("body_hash"), F.lit(False).alias("has_issue"),
    )
    h1 = F.when(c("h1_count") == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), c("h1_count").cast("int")), lambda i: F.when(c("h1_empty") & (i == 1), "").otherwise(F.concat(F.lit("Heading "), i.cast("string"), F.lit(" of "), c("id").cast("string")))))
    pictures = b["images"].groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "src", "alt"))), lambda x: F.struct(x["src"].alias("src"), x["alt"].alias("alt"))).alias("images"))
    hops = F.transform(F.sequence(F.lit(0), c("redirect_hops").cast("int")), lambda i: F.concat(F.lit("https://e.com/hop/"), i.cast("string")))
    detail = m.select("id", F.slice(hops, F.lit(1), c("redirect_hops").cast("int")).alias("redirect_chain"), h1.alias("h1"), F.when(c("id") % 2 == 0, F.array(F.lit("Second level"))).otherwise(F.array().cast("array<string>")).alias("h2"))
    detail = detail.join(pictures, "id", "left").select(c("id").cast("long").alias("page_id"), "redirect_chain", "h1", "h2", F.coalesce("images", F.from_json(F.lit("[]"), "array<struct<src: string, alt: string>>")).alias("images"))
    links = b["l"].select(c("id").cast("long").alias("id"), c("src").cast("long").alias("source_page_id"), c("target_url").alias("href"), "target_url", F.concat(F.lit("link "), c("k").cast("string")).alias("anchor_text"), (c("k") == 2).alias("nofollow"))
    chain = F.transform(F.sequence(F.lit(1), c("hops").cast("int")), lambda i: F.struct(F.concat(c("source_url"), F.lit("/"), i.cast("string")).alias("url"), c("status").cast("int").alias("status")))
    redirects = b["redirects"].select("source_url", c("status").cast("int").alias("status"), "final_url", chain.alias("chain"), "outcome")
    resources = b["resources"].select("url", c("status").cast("int").alias("status"), c("content_length").cast("long").alias("content_length"), "content_type")
    sitemaps = spark.range(1).select(F.lit("https://e.com/sitemap.xml").alias("url"), F.lit(200).alias("status"), F.lit(20).cast("long").alias("urls"), F.lit(False).alias("is_index"), F.lit("robots").alias("found_by"), F.lit(truncated).alias("truncated"))
    return {
        "pages": pages, "page_detail": detail, "links": links, "resources": resources, "crawl_failures": b["failures"], "crawl_redirects": redirects, "sitemaps": sitemaps,
        "sitemap_urls": b["sitemap_urls"], "frontier": b["frontier"].select("url", c("depth").cast("int").alias("depth")),
    }
