"""Crawling by levels: the frontier, redirect walks and upserts, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut

c = F.col


def merge_frontier(old: DataFrame, new: DataFrame) -> DataFrame:
    """url, depth: the least depth of each URL."""
    return old.select("url", "depth").unionByName(new.select("url", "depth")).groupBy("url").agg(F.min("depth").alias("depth"))


def bfs_depths(links: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_urls: int | None = None) -> DataFrame:
    """links (source, target), seeds (url) -> url, depth: the fewest links from a seed.

    A level is the distinct targets of the level before that were not seen. Each level is written to shared storage once, and what was
    seen is the union of the levels' files, so nothing is computed or written again.
    """
    links = cut(links.select("source", "target").filter("target is not null").distinct())  # every level reads them
    level, depth = cut(seeds.select("url", F.lit(0).alias("depth")).distinct()), 0
    seen, total = level, level.count() if max_urls is not None else 0
    while (max_depth is None or depth < max_depth) and not level.isEmpty():
        depth += 1
        found = links.join(level.select(c("url").alias("source")), "source", "left_semi").select(c("target").alias("url")).distinct()
        level = found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        if max_urls is not None:
            level = level.orderBy("url").limit(max(0, max_urls - total))
        level = cut(level)
        total += level.count() if max_urls is not None else 0
        seen = seen.unionByName(level)  # each level's rows are written once
    return seen


def redirect_walk(start: DataFrame, hops: DataFrame, most: int = 10) -> DataFrame:
    """start (url), hops (url, status, location) -> url, chain (array of URLs), outcome (landed, loop, limit), final_url.

    The visited URLs travel with the row, at most ``most`` of them.
    """
    step = hops.filter(c("status").isin(301, 302, 303, 307, 308)).select(c("url").alias("at"), c("location").alias("next"))
    walk = start.select("url", c("url").alias("at"), F.array("url").alias("chain"), F.lit(None).cast("string").alias("outcome"))
    for _ in range(most + 1):
        j = walk.join(step, "at", "left")
        moves = c("outcome").isNull() & c("next").isNotNull() & (c("next") != "")
        outcome = (
            F.when(c("outcome").isNotNull(), c("outcome")).when(c("next").isNull(), "landed").when(c("next") == "", "no location")
            .when(F.size("chain") > most, "limit").when(F.array_contains("chain", c("next")), "loop")
        )
        goes = moves & (F.size("chain") <= most)
        walk = j.select("url", F.when(goes, c("next")).otherwise(c("at")).alias("at"), F.when(goes, F.array_append("chain", c("next"))).otherwise(c("chain")).alias("chain"), outcome.alias("outcome"))
    return walk.select("url", "chain", F.coalesce("outcome", F.lit("limit")).alias("outcome"), F.when(c("outcome") == "landed", c("at")).alias("final_url"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, keep_id: str | None = None) -> DataFrame:
    """The last row of each key by order; with keep_id, the key's first id stays. Rows meet in an aggregate that combines on the map side."""
    every = old.unionByName(new, allowMissingColumns=True)
    rest = [x for x in every.columns if x != key]
    last = every.groupBy(key).agg(F.max_by(F.struct(*rest), c(order)).alias("r"), *([F.min(keep_id).alias("_id")] if keep_id else []))
    return last.select(key, *((c("_id") if x == keep_id else c(f"r.{x}")).alias(x) for x in rest))


def first_writer_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [x for x in rows.columns if x != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), c(order)).alias("r")).select(key, *(c(f"r.{x}").alias(x) for x in rest))


def replace_outlinks(old: DataFrame, new: DataFrame) -> DataFrame:
    """The links of sources that were fetched again are those of the new rows only."""
    again = new.select("source_page_id").distinct()
    return old.join(again, "source_page_id", "left_anti").unionByName(new)


def follows(url: Column, seed: Column, nofollow: Column, subdomains: bool = False) -> Column:
    """Whether a crawl goes there: inside the site, and not marked nofollow."""
    from ..functions.columns import is_internal

    return is_internal(url, seed, subdomains) & ~nofollow
