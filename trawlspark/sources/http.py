"""Fetching with an injected transport: robots gate, redirects, retries, and one host at a time for each task.

``transport(method, url) -> Response`` does the network's part; Spark deals the URLs by host, so that a host's requests are one
task's and its pace can be kept. A host without a pace that has very many URLs is dealt over several tasks (see shares).
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import robots
from ..functions.columns import host, port
from ..functions.urls import resolve
from ..shipping import map_arrow

#: Fixed values of the fetcher's policy.
REDIRECTS = (301, 302, 303, 307, 308)
RETRIED = (429, 502, 503, 504)
MAX_REDIRECTS, MAX_BODY, ATTEMPTS = 10, 8 << 20, 3
ROBOTS_REDIRECTS = 5
FIRST_WAIT, LONGEST_WAIT, LONGEST_RETRY_AFTER = 0.5, 30.0, 60.0
#: A host with more URLs than SHARE_URLS may be dealt over several tasks, which are told its robots.txt; one of more than SHARE_ROBOTS characters is not sent.
SHARE_URLS, SHARE_ROBOTS = 2000, 1 << 16


@dataclass
class Response:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


Transport = Callable[[str, str], Response]


@dataclass(frozen=True)
class FetchConfig:
    agent: str = "trawlspark"
    timeout: float = 30.0
    per_host: int = 4
    delay: float = 0.0
    max_body: int = MAX_BODY
    max_redirects: int = MAX_REDIRECTS


@dataclass
class Chain:
    start: str
    hops: list[dict] = field(default_factory=list)
    outcome: str = "landed"
    final: str | None = None
    response: Response | None = None


@dataclass
class Head:
    url: str
    status: int
    content_length: int | None
    content_type: str | None


def standard_transport(config: FetchConfig = FetchConfig()) -> Transport:
    """A transport of the standard library: follows nothing, reads one byte more than a body may have."""
    import urllib.error
    import urllib.request

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args):
            return None

    opener = urllib.request.build_opener(Stay)

    def transport(method: str, url: str) -> Response:
        ask = urllib.request.Request(url, method=method, headers={"User-Agent": config.agent})
        try:
            answer = opener.open(ask, timeout=config.timeout)
        except urllib.error.HTTPError as e:
            answer = e
        with answer:
            return Response(answer.status, {k.lower(): v for k, v in answer.headers.items()}, b"" if method == "HEAD" else answer.read(config.max_body + 1))

    return transport


class Pace:
    """Even spacing of a host's requests, for several threads: each takes the next free moment."""

    def __init__(self, delay: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.delay, self.clock, self.sleep, self.next, self.lock = delay, clock, sleep, None, threading.Lock()

    def wait(self) -> None:
        if self.delay <= 0:
            return
        with self.lock:
            now = self.clock()
            at = now if self.next is None else max(now, self.next)
            self.next = at + self.delay
        if at > now:
            self.sleep(at - now)


def origin_of(url: str) -> str:
    """Scheme, host and port of a canonical URL."""
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc.rpartition('@')[2]}"


def wait_before(attempt: int, retry_after: float | None) -> float | None:
    """Seconds before attempt number attempt (1 is the first retry); None to give up. Retry-After may ask for more than the own backoff, never less."""
    if attempt >= ATTEMPTS:
        return None
    own = min(LONGEST_WAIT, FIRST_WAIT * 2 ** (attempt - 1))
    if retry_after is None:
        return own
    return None if retry_after > LONGEST_RETRY_AFTER else max(own, retry_after)


def fetch(transport: Transport, url: str, method: str = "GET", sleep: Callable[[float], None] = time.sleep) -> Response:
    """One answer, after retries. A body beyond MAX_BODY is cut."""
    attempt = 0
    while True:
        try:
            r = transport(method, url)
        except OSError:
            r = None
        if r is not None and r.status not in RETRIED:
            return r
        attempt += 1
        after = r.headers.get("retry-after") if r else None
        wait = wait_before(attempt, float(after) if after and after.isdigit() else None)
        if wait is None:
            if r is None:
                raise ConnectionError(f"no answer: {url}")
            return r
        sleep(wait)


def head(transport: Transport, url: str, **options) -> Head:
    """What a HEAD request says: the length is the header's."""
    r = fetch(transport, url, "HEAD", **options)
    length = r.headers.get("content-length", "").strip()
    return Head(url, r.status, int(length) if length.isdigit() else None, r.headers.get("content-type"))


def follow(transport: Transport, url: str, allowed: Callable[[str], str | None] = lambda u: None, most: int | None = None, config: FetchConfig = FetchConfig(), before: Callable[[], None] = lambda: None, **options) -> Chain:
    """The redirects from url on: landed, loop, limit, no location, or why the walk was refused (what allowed returns)."""
    most = config.max_redirects if most is None else most
    chain, at, seen = Chain(url), url, {url}
    while True:
        refused = allowed(at)
        if refused:
            chain.outcome = refused
            return chain
        before()
        try:
            r = fetch(transport, at, **options)
        except OSError as e:
            chain.outcome = str(e)
            return chain
        if r.status not in REDIRECTS:
            chain.final, chain.response = at, r
            return chain
        if len(chain.hops) >= most:
            chain.outcome = f"more than {most} redirects"
            return chain
        location = r.headers.get("location", "")
        target = resolve(at, location) if location else None
        chain.hops.append({"url": at, "status": r.status, "location": location, "target": target})
        if target is None:
            chain.outcome = "no location"
            return chain
        if target in seen:
            chain.outcome = f"redirect loop at {target}"
            return chain
        seen.add(target)
        at = target


class RobotsCache:
    """The robots.txt of each origin, fetched once, over at most five redirects. What can't be read forbids the origin."""

    def __init__(self, transport: Transport, config: FetchConfig = FetchConfig(), **options):
        self.transport, self.config, self.options = transport, config, options
        self.rules: dict[str, robots.Rules] = {}
        self.rows: list[dict] = []  # origin, status, body of what was fetched
        self.reasons: dict[str, str] = {}
        self.lock = threading.Lock()

    def get(self, origin: str) -> robots.Rules:
        with self.lock:
            if origin not in self.rules:
                chain = follow(self.transport, f"{origin}/robots.txt", most=ROBOTS_REDIRECTS, **self.options)
                if chain.response is None:
                    self.reasons[origin] = chain.outcome
                    self.rules[origin] = robots.Rules(everything=False)
                    self.rows.append({"origin": origin, "status": 0, "body": None})
                else:
                    text = chain.response.body[: self.config.max_body].decode("utf-8", "replace")
                    self.rules[origin] = robots.from_response(chain.response.status, text, self.config.agent)
                    if 500 <= chain.response.status < 600:
                        self.reasons[origin] = f"HTTP {chain.response.status}"
                    self.rows.append({"origin": origin, "status": chain.response.status, "body": text if 200 <= chain.response.status < 300 else None})
            return self.rules[origin]

    def learn(self, shared: dict[str, Share]) -> None:
        """The robots files of shared hosts, which were fetched before."""
        for s in shared.values():
            self.rules[s.origin] = robots.from_response(s.status, s.body, self.config.agent)

    def refused(self, url: str) -> str | None:
        """Why a URL may not be fetched, or None."""
        origin = origin_of(url)
        if self.get(origin).allows(url[len(origin) :] if url.startswith(origin) else "/" + url.split("://", 1)[-1].partition("/")[2]):
            return None
        return f"robots.txt could not be read: {self.reasons[origin]}" if origin in self.reasons else f"robots.txt disallows {url}"


HOPS = "array<struct<url: string, status: int, location: string, target: string>>"
ANSWERS = f"kind string, url string, depth int, status int, final_url string, html string, content_type string, truncated boolean, elapsed_ms int, chain {HOPS}, outcome string, body string"
_HOP = pa.struct([("url", pa.string()), ("status", pa.int32()), ("location", pa.string()), ("target", pa.string())])
SCHEMA = pa.schema([
    ("kind", pa.string()), ("url", pa.string()), ("depth", pa.int32()), ("status", pa.int32()), ("final_url", pa.string()), ("html", pa.string()), ("content_type", pa.string()), ("truncated", pa.bool_()), ("elapsed_ms", pa.int32()),
    ("chain", pa.list_(_HOP)), ("outcome", pa.string()), ("body", pa.string()),
])
#: Rows whose bodies a task holds: per_host of them are under way.
AT_ONCE = 32


@dataclass(frozen=True)
class Share:
    """A host that several tasks ask: its origin's robots.txt, and how many requests each of the tasks may have under way."""

    origin: str
    status: int
    body: str | None
    widths: tuple[int, ...]


def _key() -> Column:
    return F.concat(host(F.col("url")), F.lit(":"), port(F.col("url")).cast("string"))


def shares(urls: DataFrame, cache: RobotsCache) -> tuple[dict[str, Share], int | None]:
    """The hosts of urls (url) to deal over several tasks, and over how many partitions all are dealt: those with more than SHARE_URLS URLs
    and without a pace, which only one task could keep.

    per_host requests of a host are under way as ever: its tasks divide them. There are as many tasks as cores are left for it. cache fetches
    the robots files, on the driver and once; none is asked for where all cores have a large host of their own.
    """
    config, spark, out = cache.config, urls.sparkSession, {}
    cores = spark.sparkContext.defaultParallelism
    counted = urls.groupBy(_key().alias("host")).agg(F.count("*").alias("n"), F.min("url").alias("first"), F.max("url").alias("last"))
    large = F.collect_list(F.when(F.col("n") > SHARE_URLS, F.struct("host", "first", "last")))
    hosts, large = counted.agg(F.count("*"), large).first()
    tasks = min(config.per_host, cores // max(1, len(large)))
    for r in large if tasks > 1 and config.delay <= 0 else []:
        origin = origin_of(r["first"])
        if origin_of(r["last"]) != origin or cache.get(origin).crawl_delay or origin in cache.reasons:
            continue
        robot = next(x for x in cache.rows if x["origin"] == origin)
        if len(robot["body"] or "") <= SHARE_ROBOTS:
            out[r["host"]] = Share(origin, robot["status"], robot["body"], tuple(config.per_host // tasks + (k < config.per_host % tasks) for k in range(tasks)))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out, max(len(out) * tasks, min(most, len(out) * tasks + hosts - len(out))) if out else None


def _by_host(urls: DataFrame, partitions: int | None, shared: dict[str, Share]) -> DataFrame:
    """urls with host and share, the number of the task within those of its host."""
    dealt = urls.withColumn("host", _key()).withColumn("share", F.lit(0))
    if not shared:
        return (dealt.repartition(partitions, "host") if partitions else dealt.repartition("host")).sortWithinPartitions("host")
    n = max(partitions or 1, sum(len(s.widths) for s in shared.values()))
    share, place, start = F.lit(0), F.pmod(F.xxhash64("host"), F.lit(n)).cast("int"), 0
    for name, s in shared.items():  # a partition for each of its tasks, none of which another shared host has
        share = F.when(F.col("host") == name, F.pmod(F.xxhash64("url"), F.lit(len(s.widths))).cast("int")).otherwise(share)
        place = F.when(F.col("host") == name, F.lit(start) + F.col("share")).otherwise(place)
        start += len(s.widths)
    return dealt.withColumn("share", share).repartitionById(n, place).sortWithinPartitions("host")


class _Pools:
    """Threads for as many requests as may be under way: per_host, or what a shared host's task has of them."""

    def __init__(self, config: FetchConfig, shared: dict[str, Share]):
        self.config, self.shared, self.pools = config, shared, {}

    def __enter__(self) -> _Pools:
        return self

    def __exit__(self, *_) -> None:
        for p in self.pools.values():
            p.shutdown()

    def map(self, function: Callable[[dict], object], rows: list[dict]) -> Iterator:
        """What function gives for each row; other hosts are waited for before and after a shared one."""
        for (name, k), part in groupby(rows, lambda r: (r["host"] if r["host"] in self.shared else None, r["share"])):
            n = self.config.per_host if name is None else self.shared[name].widths[k]
            if n == 1:
                yield from map(function, part)
            else:
                yield from self.pools.setdefault(n, ThreadPoolExecutor(n)).map(function, list(part))


def fetch_all(urls: DataFrame, transport_factory: Callable[[], Transport], config: FetchConfig = FetchConfig(), partitions: int | None = None, shared: dict[str, Share] | None = None) -> DataFrame:
    """urls (url, depth) -> rows of ANSWERS: a "page" for each URL (outcome "landed", or why there is none) and the "robots" files on the way.

    A host's URLs are one task's: its robots.txt is fetched once, its pace is kept, and at most per_host requests are under way. A host
    with very many URLs takes as long as its pace asks for, which no division would shorten; where it asks for none, shared (see shares) divides
    the host's URLs and its requests between tasks. Their robots files are not among the rows.
    """
    shared = shared or {}
    dealt = _by_host(urls.select("url", F.col("depth").cast("int").alias("depth")), partitions, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transport = transport_factory()
        cache, paces, told = RobotsCache(transport, config), {}, 0
        cache.learn(shared)

        def one(row: dict) -> dict:
            begun = time.monotonic()
            pace = paces[row["host"]]
            chain = follow(transport, row["url"], cache.refused, config=config, before=pace.wait)
            record = dict.fromkeys(SCHEMA.names) | {"kind": "page", "url": row["url"], "depth": row["depth"], "chain": chain.hops, "outcome": chain.outcome, "elapsed_ms": int((time.monotonic() - begun) * 1000)}
            if chain.response is not None:
                r = chain.response
                body = r.body[: config.max_body]
                record |= {"status": r.status, "final_url": chain.final, "html": body.decode("utf-8", "replace"), "content_type": r.headers.get("content-type"), "truncated": len(r.body) > config.max_body}
            return record

        with _Pools(config, shared) as pools:
            for batch in batches:
                rows = batch.to_pylist()
                for k in range(0, len(rows), AT_ONCE):
                    part = rows[k : k + AT_ONCE]
                    for row in part:
                        if row["host"] not in paces:
                            rules = cache.get(origin_of(row["url"]))
                            paces = {row["host"]: Pace(max(config.delay, rules.crawl_delay or 0))} | paces
                    out = list(pools.map(one, part))
                    files = [dict.fromkeys(SCHEMA.names) | {"kind": "robots", "url": x["origin"], "status": x["status"], "body": x["body"]} for x in cache.rows[told:]]
                    told = len(cache.rows)
                    yield pa.RecordBatch.from_pylist(out + files, SCHEMA)

    return map_arrow(dealt, run, ANSWERS)


def head_all(urls: DataFrame, transport_factory: Callable[[], Transport], config: FetchConfig = FetchConfig(), partitions: int | None = None, shared: dict[str, Share] | None = None) -> DataFrame:
    """urls (url) -> url, status, content_length, content_type of those that answer a HEAD request; others are absent."""
    shared = shared or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transport = transport_factory()
        cache = RobotsCache(transport, config)
        cache.learn(shared)

        def one(row: dict) -> Head | None:
            try:
                return None if cache.refused(row["url"]) else head(transport, row["url"])
            except OSError:
                return None

        with _Pools(config, shared) as pools:
            for batch in batches:
                found = [x for x in pools.map(one, batch.to_pylist()) if x is not None]
                yield pa.RecordBatch.from_pylist([vars(x) for x in found], pa.schema([("url", pa.string()), ("status", pa.int32()), ("content_length", pa.int64()), ("content_type", pa.string())]))

    return map_arrow(_by_host(urls.select("url"), partitions, shared), run, "url string, status int, content_length long, content_type string")


def robots_rows(df: DataFrame) -> DataFrame:
    """robots_files with access: rules, redirect, none (nothing is allowed) or all, by status."""
    s = F.col("status")
    return df.withColumn("access", F.when(s.between(200, 299), "rules").when(s.between(300, 399), "redirect").when(s.between(500, 599), "none").otherwise("all"))
