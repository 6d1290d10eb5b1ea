"""Aggregations over findings and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KINDS, is_js_shell, severity_rank, severity_words
from .registry import Registry

c = F.col


def _distinct_counts(issues: DataFrame, *keys: str) -> DataFrame:
    """issues, urls and page_urls for each key. Findings are first summed up for each URL, so that the distinct counts are plain counts
    with partial sums and no row is multiplied."""
    by_url = issues.groupBy(*keys, "url", "page_id").agg(F.count("*").alias("n"))
    urls = by_url.groupBy(*keys, "url").agg(F.sum("n").alias("n"), F.max("page_id").isNotNull().alias("paged"))
    return urls.groupBy(*keys).agg(F.sum("n").alias("issues"), F.count("url").alias("urls"), F.count_if("paged").alias("page_urls"))


def issues_by_rule(issues: DataFrame) -> DataFrame:
    """rule_id, severity, issues, urls, page_urls; most findings first."""
    return _distinct_counts(issues, "rule_id", "severity").orderBy(c("issues").desc(), "rule_id")


def issues_by_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("issues")).orderBy(c("issues").desc(), "severity")


def issue_totals(issues: DataFrame) -> DataFrame:
    """One row: issues, pages_with_issues, urls_with_issues (pages, and URLs that never became one)."""
    subject = F.when(c("page_id").isNull(), c("url"))
    one = issues.groupBy("page_id", subject.alias("u")).agg(F.count("*").alias("n"))
    counted = one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("issues"), F.count("page_id").alias("pages_with_issues"), F.count("u").alias("pageless"))
    return counted.select("issues", "pages_with_issues", (c("pages_with_issues") + c("pageless")).alias("urls_with_issues"))


def pages_by_kind(pages: DataFrame) -> DataFrame:
    """kind, pages; in a fixed order, absent kinds left out."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), c("kind"))
    return pages.groupBy("kind").agg(F.count("*").alias("pages")).orderBy(F.when(order == 0, len(KINDS) + 1).otherwise(order), "kind")


def crawl_counts(pages: DataFrame) -> DataFrame:
    """One row in one pass: crawled, five status classes, indexable, noindex, js_shell."""
    classes = [F.count_if(c("status").between(k * 100, k * 100 + 99)).alias(f"status_{k}xx") for k in range(1, 6)]
    shell = is_js_shell(c("kind"), c("status"), c("word_count"), c("size"))
    return pages.agg(F.count("*").alias("crawled"), *classes, F.count_if(~c("noindex")).alias("indexable"), F.count_if("noindex").alias("noindex"), F.count_if(shell).alias("js_shell"))


def queued(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Discovered URLs without a page, as the API counts them: failures and redirect sources are among them."""
    return frontier.join(pages.select("url"), "url", "left_anti")


def frontier_state(t: dict[str, DataFrame]) -> DataFrame:
    """url, depth, done: whether a page, a failure or a redirect came of it."""
    outcomes = t["pages"].select("url").unionByName(t["crawl_failures"].select("url")).unionByName(t["crawl_redirects"].select(c("source_url").alias("url")))
    done = outcomes.distinct().withColumn("_done", F.lit(True))
    return t["frontier"].join(done, "url", "left").select("url", "depth", F.coalesce("_done", F.lit(False)).alias("done"))


def queued_strict(t: dict[str, DataFrame]) -> DataFrame:
    """What is really left to fetch."""
    return frontier_state(t).filter(~c("done")).select("url", "depth")


def crawl_overview(t: dict[str, DataFrame]) -> DataFrame:
    """One row: crawl_counts with queued and failed. Each part is one row."""
    one = crawl_counts(t["pages"])
    return one.crossJoin(queued(t["frontier"], t["pages"]).agg(F.count("*").alias("queued"))).crossJoin(t["crawl_failures"].agg(F.count("*").alias("failed")))


def rule_index(registry: Registry, issues: DataFrame, crawled: Column) -> DataFrame:
    """Every rule with its counts, zeros kept: fired first, then severity, count, id; share of the crawl only where all subjects are pages."""
    spark = issues.sparkSession
    rules = spark.createDataFrame([(r.id, r.severity) for r in registry.rules], "rule_id string, severity string")
    counts = issues_by_rule(issues).drop("severity")
    j = rules.join(counts, "rule_id", "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in ("issues", "urls", "page_urls")})
    j = j.withColumn("share", F.when(c("urls") == c("page_urls"), c("urls") / crawled))
    return j.orderBy(c("issues") == 0, severity_rank(c("severity")), c("issues").desc(), "rule_id")


def report_findings(issues: DataFrame) -> DataFrame:
    """rule_id, label, affected: worst first, then by how many URLs it touches."""
    one = _distinct_counts(issues, "rule_id", "severity")
    return one.select("rule_id", severity_words(c("severity")).alias("label"), c("urls").alias("affected"), severity_rank(c("severity")).alias("_rank")).orderBy("_rank", c("affected").desc(), "rule_id").drop("_rank")


def report_examples(issues: DataFrame, most: int = 5) -> DataFrame:
    """rule_id, position, url: each rule's first URLs. The smallest are kept while aggregating, so a rule's findings never meet in one task."""
    from pyspark.sql import Window

    each = issues.groupBy("rule_id", "url").agg(F.count("*").alias("n"))
    part = each.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(64)))
    near = Window.partitionBy("rule_id", "part").orderBy("url")
    first = part.withColumn("r", F.row_number().over(near)).filter(c("r") <= most)
    rows = first.select("rule_id", F.explode(F.array_repeat("url", F.least(c("n"), F.lit(most)).cast("int"))).alias("url"))
    last = Window.partitionBy("rule_id").orderBy("url")
    return rows.withColumn("position", F.row_number().over(last)).filter(c("position") <= most).select("rule_id", "position", "url")
