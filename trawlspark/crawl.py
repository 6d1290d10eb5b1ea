"""A crawl: levels of the frontier are fetched by the executors, extracted, and lead to the next; then images, sitemaps and the audit.

The driver holds the state and the limits, never the pages. Each round takes the pending URLs of least depth, deals them by host,
and writes what came back to shared storage, so that a lost executor or a stopped driver loses one round at most.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.urls import canonical_url
from .operators import audit as A
from .operators import records as R
from .operators.extraction import extract_records
from .operators.frontier import follows, merge_frontier
from .sources import http, sitemaps, store

c = F.col
RUNNING, PAUSED, CANCELLED, COMPLETED, COUNT_LIMIT, TIME_LIMIT, FAILED = "running", "paused", "cancelled", "completed", "count limit reached", "time limit reached", "failed"


@dataclass
class Progress:
    status: str
    admitted: int
    written: int
    queued: int
    failed: int
    by_class: dict[int, int]
    elapsed: float

    @property
    def urls_per_second(self) -> float:
        return self.written / self.elapsed if self.elapsed > 0 else 0.0


@dataclass
class Lifecycle:
    """What a running crawl may do next. pause, resume and cancel are called from other threads; they say whether they changed anything."""

    max_depth: int | None = None
    max_urls: int | None = None
    max_seconds: float | None = None
    clock: Callable[[], float] = time.monotonic
    status: str = RUNNING
    admitted: int = 0
    written: int = 0
    queued: int = 0
    failed: int = 0
    by_class: dict[int, int] = field(default_factory=lambda: dict.fromkeys(range(1, 6), 0))

    #: The records of the rounds that have ended: what can be read while the crawl goes on.
    parts: list[DataFrame] = field(default_factory=list)

    def live(self) -> DataFrame | None:
        """The pages so far, as rows of the pages table; None before the first round has ended. A round that is under way is not in it."""
        return R.page_rows(_union(list(self.parts)).withColumn("id", F.lit(None).cast("long"))) if self.parts else None

    def __post_init__(self) -> None:
        self.changed = threading.Condition()
        self.started, self.paused_at, self.paused = self.clock(), None, 0.0

    @property
    def terminal(self) -> bool:
        return self.status not in (RUNNING, PAUSED)

    @property
    def elapsed(self) -> float:
        """Seconds of running: those of a pause don't count."""
        now = self.clock()
        return now - self.started - self.paused - (now - self.paused_at if self.paused_at is not None else 0.0)

    def _to(self, status: str, *allowed: str) -> bool:
        with self.changed:
            if self.status not in allowed:
                return False
            if self.status == PAUSED and status != PAUSED:
                self.paused, self.paused_at = self.paused + self.clock() - self.paused_at, None
            if status == PAUSED:
                self.paused_at = self.clock()
            self.status = status
            self.changed.notify_all()
            return True

    def pause(self) -> bool:
        return self._to(PAUSED, RUNNING)

    def resume(self) -> bool:
        return self._to(RUNNING, PAUSED)

    def cancel(self) -> bool:
        return self._to(CANCELLED, RUNNING, PAUSED)

    def fail(self) -> bool:
        return self._to(FAILED, RUNNING, PAUSED)

    def complete(self) -> bool:
        return self._to(COMPLETED, RUNNING)

    def admit(self, wanted: int) -> int:
        """How many of so many URLs may be fetched now; waits while paused. None may once a limit is reached, which ends the crawl."""
        with self.changed:
            while self.status == PAUSED:
                self.changed.wait(0.5)
        if self.terminal:
            return 0
        if self.max_seconds is not None and self.elapsed >= self.max_seconds:
            self._to(TIME_LIMIT, RUNNING)
            return 0
        left = wanted if self.max_urls is None else min(wanted, self.max_urls - self.admitted)
        if wanted and left <= 0:
            self._to(COUNT_LIMIT, RUNNING)
            return 0
        self.admitted += left
        return left

    def record(self, status: int | None, n: int) -> None:
        """n answers of a status; one outside 100 to 599, or none, counts as failed."""
        if status is not None and 1 <= status // 100 <= 5:
            self.by_class[status // 100] += n
        else:
            self.failed += n

    def progress(self) -> Progress:
        return Progress(self.status, self.admitted, self.written, self.queued, self.failed, dict(self.by_class), self.elapsed)


#: URLs of one round, at most: bounds what a stopped driver loses.
ROUND = 1_000_000
#: Answers in one file, at most: a host's answers come from few tasks, and its pages are parsed by as many as there are files.
FILE_ROWS = 1024


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def run_crawl(
    spark: SparkSession, seed: str, transport_factory: Callable[[], http.Transport], lifecycle: Lifecycle | None = None, config: http.FetchConfig = http.FetchConfig(), subdomains: bool = False, check_images: bool = True,
    on_progress: Callable[[Progress], None] = lambda p: None, pending: DataFrame | None = None, seen: DataFrame | None = None, before: dict[str, DataFrame] | None = None, round_urls: int = ROUND,
) -> dict[str, DataFrame]:
    """Crawl from seed; the crawl tables with issues. pending and seen (url, depth) go on with a stopped crawl (see resume_state),
    whose tables (before) are part of the result."""
    life = lifecycle or Lifecycle()
    start = canonical_url(seed)
    if start is None:
        raise ValueError(f"not a crawlable address: {seed!r}")
    try:
        first = spark.createDataFrame([(start, 0)], "url string, depth int")
        pending = store.cut(first if pending is None else pending)
        known = store.cut(merge_frontier(seen, pending) if seen is not None else pending)
        records, answers, robots = [], [], []
        cache = http.RobotsCache(transport_factory(), config)  # of hosts that several tasks ask
        while True:
            due = pending if life.max_depth is None else pending.filter(c("depth") <= life.max_depth)
            waiting = due.count()
            life.queued = waiting
            on_progress(life.progress())
            # A part of a level, in the frontier's order, only where a limit or the size of a round asks for it.
            allowed = life.admit(min(waiting, round_urls))
            if not allowed:
                break
            taken = due if allowed == waiting else store.cut(due.orderBy("depth", "url").limit(allowed))
            shared, partitions = http.shares(taken, cache) if allowed > http.SHARE_URLS else (None, None)
            got = store.cut(http.fetch_all(taken, transport_factory, config, partitions, shared), FILE_ROWS)
            pages = got.filter("kind = 'page'").drop("kind", "body")
            robots.append(got.filter("kind = 'robots'").select(c("url").alias("origin"), "status", "body"))
            answers.append(pages)
            landed = pages.filter("outcome = 'landed'").select(c("final_url").alias("url"), "status", "depth", "html", "truncated", "content_type", "elapsed_ms", F.transform("chain", lambda x: x["url"]).alias("redirect_chain"))
            part = store.cut(extract_records(landed))
            records.append(part)
            life.parts.append(part)
            outcomes = part.select("status", F.lit(True).alias("landed")).unionByName(pages.filter("outcome <> 'landed'").select(F.lit(None).cast("int").alias("status"), F.lit(False).alias("landed")))
            for r in outcomes.groupBy("landed", "status").count().collect():  # one row for each status
                life.record(r["status"], r["count"])
                life.written += r["count"] * r["landed"]
            links = part.select("depth", F.explode("links").alias("l")).select(c("l.target").alias("url"), (c("depth") + 1).alias("depth"), "l.nofollow").filter("url is not null")
            found = links.filter(follows(c("url"), F.lit(start), c("nofollow"), subdomains)).groupBy("url").agg(F.min("depth").alias("depth"))
            new = store.cut(found.join(known, "url", "left_anti"))
            # Each level is written once; what is known is the union of the levels' files.
            left = None if allowed == waiting and life.max_depth is None else pending.join(taken, "url", "left_anti")
            pending = new if left is None else store.cut(left.unionByName(new))
            known = known.unionByName(new)
        life.complete()
        every, pages = (_union(records), _union(answers)) if records else (None, None)
        if every is None:
            every = extract_records(spark.createDataFrame([], "url string, html string"))
            pages = spark.createDataFrame([], http.ANSWERS).drop("kind", "body")
        if cache.rows:
            robots.append(spark.createDataFrame([(x["origin"], x["status"], x["body"]) for x in cache.rows], "origin string, status int, body string"))
        files, listed = _sitemaps(spark, start, transport_factory, config)
        tables = R.crawl_tables_of(
            every, crawl_failures=R.failure_rows(pages), crawl_redirects=R.redirect_rows(pages), frontier=known, sitemaps=files, sitemap_urls=listed,
            robots_files=_union(robots).dropDuplicates(["origin"]) if robots else spark.createDataFrame([], "origin string, status int, body string"),
            resources=store.cut(image_heads(R.image_urls(every), transport_factory, cache)) if check_images else spark.createDataFrame([], "url string, status int, content_length long, content_type string"),
            crawl=spark.createDataFrame([(start, life.max_depth, life.max_urls, None if life.max_seconds is None else int(life.max_seconds * 1e9), life.status == COMPLETED)], "seed_url string, max_depth int, max_urls long, max_duration_ns long, analysed boolean"),
        )
        if before is not None:
            tables = _joined(before, tables)
        tables = {k: store.cut(v) if k in ("pages", "links", "page_detail") else v for k, v in tables.items()}
        tables["issues"] = store.cut(A.audit(tables))
        tables["pages"] = A.with_issue_flag(tables["pages"], tables["issues"])
        on_progress(life.progress())
        return tables
    except BaseException:
        life.fail()
        raise


def image_heads(urls: DataFrame, transport_factory: Callable[[], http.Transport], cache: http.RobotsCache) -> DataFrame:
    """The image pass: urls (url) are written first, as they are counted by host and then asked for."""
    urls = store.cut(urls)
    shared, partitions = http.shares(urls, cache)
    return http.head_all(urls, transport_factory, cache.config, partitions, shared)


def _joined(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a stopped crawl and of what went on from it. Ids of the old part stay, those of the new one follow after them."""
    last = old["pages"].agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("n")).first()["n"]
    moved = {"pages": ("id",), "page_detail": ("page_id",), "links": ("source_page_id",)}
    out = dict(new)
    for name in ("pages", "page_detail", "links", "crawl_failures", "crawl_redirects", "robots_files", "resources"):
        part = new[name]
        for column in moved.get(name, ()):
            part = part.withColumn(column, c(column) + F.lit(last))
        if name == "links":
            part = part.withColumn("id", c("id") + F.lit(last * 1_000_000))
        out[name] = old[name].unionByName(part, allowMissingColumns=True)
    out["resources"], out["robots_files"] = out["resources"].dropDuplicates(["url"]), out["robots_files"].dropDuplicates(["origin"])
    return out


def _sitemaps(spark: SparkSession, start: str, transport_factory: Callable[[], http.Transport], config: http.FetchConfig) -> tuple[DataFrame, DataFrame]:
    """The sitemap pass: at most fifty files, read by the driver one after another."""
    transport, origin = transport_factory(), http.origin_of(start)
    cache = http.RobotsCache(transport, config)
    declared = cache.get(origin).sitemaps

    def fetched(url: str) -> tuple[int, str] | None:
        chain = http.follow(transport, url, config=config)
        return (chain.response.status, chain.response.body.decode("utf-8", "replace")) if chain.response else None

    files, listed = sitemaps.discover(origin, declared, fetched)
    return spark.createDataFrame(files, "url string, status int, urls long, is_index boolean, found_by string, truncated boolean"), spark.createDataFrame(listed, "url string, source string")


def resume_state(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """pending and seen of a stored crawl: the frontier without pages, failures and redirects, and all of it."""
    done = tables["pages"].select("url").unionByName(tables["crawl_failures"].select("url")).unionByName(tables["crawl_redirects"].select(c("source_url").alias("url")))
    known = tables["frontier"].select("url", "depth")
    return known.join(done.distinct(), "url", "left_anti"), known
