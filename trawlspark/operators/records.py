"""Page records to the crawl tables: what joins extraction with the audit, the grid and the exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TABLES
from ..sources.store import cut
from .extraction import resolved_urls

c = F.col


def _columns(table: str) -> list[tuple[str, str]]:
    """Name and type of each column of a crawl table."""
    out, depth, part = [], 0, ""
    for ch in TABLES[table] + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append((name, kind))
            part = ""
        else:
            part += ch
    return out


def with_ids(records: DataFrame) -> DataFrame:
    """One record for each URL (of several the one nearest to the seed) with an id: unique and, once written, fixed; not dense."""
    rest = [x for x in records.columns if x not in ("url", "id")]
    one = records.groupBy("url").agg(F.min_by(F.struct(*rest, *(["id"] if "id" in records.columns else [])), F.struct("depth", "status", "size")).alias("r")).select("url", "r.*")
    return one if "id" in records.columns else cut(one.withColumn("id", F.monotonically_increasing_id()))


def page_rows(records: DataFrame) -> DataFrame:
    own = {"has_issue": F.lit(False)}
    return records.select(*(own.get(name, c(name) if name in records.columns else F.lit(None)).cast(kind).alias(name) for name, kind in _columns("pages")))


def detail_rows(records: DataFrame) -> DataFrame:
    return records.select(c("id").alias("page_id"), "redirect_chain", "h1", "h2", "hreflang", "open_graph", "images")


def link_rows(records: DataFrame) -> DataFrame:
    """The links of every page in document order: an id is the page's, times a million, and the link's place."""
    each = records.select(c("id").alias("source_page_id"), F.posexplode("links").alias("k", "l"))
    return each.select((c("source_page_id") * 1_000_000 + c("k")).alias("id"), "source_page_id", "l.href", c("l.target").alias("target_url"), c("l.text").alias("anchor_text"), "l.nofollow")


def image_urls(records: DataFrame) -> DataFrame:
    """(url): every distinct image address, resolved against the pages that show it."""
    each = records.select(c("url").alias("page"), F.explode("images.src").alias("src")).distinct()
    return resolved_urls(each, "page", "src", "url").select("url").filter("url is not null").distinct()


def redirect_rows(answers: DataFrame) -> DataFrame:
    """crawl_redirects of fetched answers (see http.fetch_all): those with a hop, under the first hop's address and status."""
    walked = answers.filter(F.size("chain") > 0)
    return walked.select(F.get("chain", F.lit(0))["url"].alias("source_url"), F.get("chain", F.lit(0))["status"].alias("status"), "final_url", "chain", "outcome")


def failure_rows(answers: DataFrame) -> DataFrame:
    """crawl_failures of fetched answers: without a page and without a redirect, which would tell more."""
    return answers.filter((c("outcome") != "landed") & (F.size("chain") == 0)).select("url", c("outcome").alias("reason"))


def crawl_tables_of(records: DataFrame, **others: DataFrame) -> dict[str, DataFrame]:
    """The crawl tables of page records; others (crawl_failures, resources, ...) as given, else empty."""
    spark = records.sparkSession
    r = with_ids(records)
    made = {"pages": page_rows(r), "page_detail": detail_rows(r), "links": link_rows(r)}
    return {name: made.get(name) if name in made else others.get(name, spark.createDataFrame([], schema)) for name, schema in TABLES.items()}


def landed_redirects(tables: dict[str, DataFrame]) -> DataFrame:
    """Redirects with the page they end at: source_url, final_url, page_id, status of the page, hops."""
    pages = tables["pages"].select(c("url").alias("final_url"), c("id").alias("page_id"), c("status").alias("page_status"))
    return tables["crawl_redirects"].join(pages, "final_url").select("source_url", "final_url", "page_id", "page_status", F.size("chain").alias("hops"))
