"""A crawl as one object: the operations that an application calls."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crawl, schema
from .functions.urls import canonical_url
from .operators import audit as A
from .operators import export, grid, lookups, overviews, views
from .operators.registry import Registry
from .sources import http, store


class CrawlError(ValueError):
    pass


class NoCrawlOpen(CrawlError):
    pass


class BadSeed(CrawlError):
    def __init__(self, seed: str, suggestion: str | None):
        super().__init__(f"not a crawlable address: {seed!r}" + (f"; did you mean {suggestion}?" if suggestion else ""))
        self.suggestion = suggestion


class Missing(CrawlError):
    """No such crawl or page."""


class StoreError(CrawlError):
    """A crawl's folder can't be read or written."""


class ExportError(CrawlError):
    """A file could not be written whole."""


class AlreadyRunning(CrawlError):
    """One crawl runs at a time."""


class OutputExists(CrawlError):
    def __init__(self, path: str, suggestion: str):
        super().__init__(f"{path} exists; {suggestion} is free")
        self.suggestion = suggestion


@dataclass(frozen=True)
class CrawlSettings:
    """Limits of a crawl: refused, not adjusted, where they make no sense."""

    seed: str
    max_depth: int | None = None
    max_urls: int | None = None
    max_seconds: float | None = None
    concurrency: int = 4

    def __post_init__(self):
        if not 1 <= self.concurrency <= 16:
            raise CrawlError("concurrency is 1 to 16")
        if any(x is not None and x <= 0 for x in (self.max_urls, self.max_seconds)):
            raise CrawlError("a limit of zero crawls nothing")
        if canonical_url(self.seed) is None:
            raise BadSeed(self.seed, seed_suggestion(self.seed))


def seed_suggestion(seed: str) -> str | None:
    """The address that a seed without a scheme probably means."""
    text = seed.strip()
    return canonical_url("https://" + text) if text and "://" not in text and "." in text.split("/")[0] and " " not in text else None


def output_name(seed: str) -> str:
    """A file name from a seed's host: without www., in lower case, other characters than ASCII letters and digits as hyphens."""
    host = re.sub(r"^(www\.)+", "", seed.rsplit("://", 1)[-1].split("/")[0]).strip()
    return (re.sub(r"[^A-Za-z0-9]", "-", host).lower().strip("-") or "crawl") + ".crawl"


def free_name(path: str) -> str:
    """path, or the first of path-2, path-3, ... that doesn't exist."""
    p, k = Path(path), 2
    while p.exists():
        p, k = Path(path).with_name(f"{Path(path).stem}-{k}{Path(path).suffix}"), k + 1
    return str(p)


class Crawl:
    """A stored crawl."""

    def __init__(self, spark: SparkSession, root: str | None = None, tables: dict[str, DataFrame] | None = None, registry: Registry | None = None):
        if root is None and tables is None:
            raise NoCrawlOpen("no crawl is open")
        self.tables = tables if tables is not None else store.open_crawl(spark, root)
        self.registry = registry or A.standard_registry()

    def analyse(self, root: str) -> Crawl:
        """Audit the crawl, and store it with its findings; what marks it as analysed is written last."""
        t = dict(self.tables)
        t["issues"] = store.cut(A.audit(t))
        t["pages"] = A.with_issue_flag(t["pages"], t["issues"])
        store.save(t, root, analysed=True)
        return Crawl(t["issues"].sparkSession, root, registry=self.registry)

    def query_rows(self, filters: tuple[grid.Filter, ...] = (), sort: str = "url", descending: bool = False, offset: int = 0, limit: int = 100) -> tuple[DataFrame, int]:
        for f in filters:
            if f.shape == "exists":
                self._known(str(f.value))
        return grid.query_rows(self.tables["pages"], grid.SortSpec(sort, descending, filters), offset, limit, self.tables["issues"])

    def _known(self, rule: str) -> None:
        if all(r.id != rule for r in self.registry.rules):
            raise grid.UnknownRule(rule)

    def supported_sorts(self, filters: tuple[grid.Filter, ...]) -> list[str]:
        return grid.supported_sorts(filters)

    def issue_overview(self) -> dict[str, DataFrame]:
        i = self.tables["issues"]
        return {"by_rule": overviews.issues_by_rule(i), "by_severity": overviews.issues_by_severity(i), "totals": overviews.issue_totals(i)}

    def crawl_overview(self) -> DataFrame:
        return overviews.crawl_overview(self.tables)

    def site_structure(self, prefix: str | None = None) -> tuple[DataFrame, int]:
        if prefix is None:
            root = lookups.crawl_root(self.tables["pages"]).first()
            prefix = root[0] if root else ""
        return lookups.structure_window(lookups.structure(self.tables["pages"], prefix))

    def page_detail(self, page_id: int) -> DataFrame:
        found = lookups.page_detail(self.tables, page_id)
        if self.tables["pages"].filter(F.col("id") == page_id).isEmpty():
            raise Missing(f"no page {page_id}")
        return found

    def resource_rows(self, offset: int = 0, limit: int = 100) -> DataFrame:
        return grid.window(lookups.resource_rows(self.tables), [F.col("url")], offset, limit)

    def sitemap_urls(self, offset: int = 0, limit: int = 100) -> DataFrame:
        return grid.window(lookups.sitemap_rows(self.tables), [F.col("url")], offset, limit)

    def sitemap_summary(self) -> DataFrame:
        return lookups.sitemap_summary(self.tables)

    def sitemap_files(self) -> DataFrame:
        """The sitemap files that were read: those without an answer have status 0."""
        return self.tables["sitemaps"].orderBy("url")

    def rules(self) -> list[dict[str, str]]:
        return [{"id": r.id, "severity": r.severity, "description": r.description, "remedy": r.remedy} for r in self.registry.rules]

    def view(self, name: str) -> DataFrame:
        return views.view_rows(self.tables, name)

    def report(self) -> list[str]:
        """The report's paragraphs."""
        overview, summary = self.crawl_overview().first().asDict(), self.sitemap_summary().first().asDict()
        examples: dict[str, list[str]] = {}
        for r in overviews.report_examples(self.tables["issues"]).orderBy("rule_id", "position").collect():  # five for each of thirty rules
            examples.setdefault(r["rule_id"], []).append(r["url"])
        findings = [{"label": r["label"], "affected": r["affected"], "description": self.registry.get(r["rule_id"]).description, "remedy": self.registry.get(r["rule_id"]).remedy, "urls": examples.get(r["rule_id"], [])} for r in overviews.report_findings(self.tables["issues"]).collect()]
        root = lookups.crawl_root(self.tables["pages"]).first()
        return export.report_paragraphs(root[0] if root else "", overview, findings, summary)

    def export(self, path: str, subject: str = "pages", filters: tuple[grid.Filter, ...] = (), sort: grid.SortSpec | None = None) -> None:
        """A file in the format of its extension: csv, json, xlsx, docx or pdf. An existing file is not overwritten."""
        kind = export.format_of(path)
        if Path(path).exists():
            raise OutputExists(path, free_name(path))
        if kind in ("docx", "pdf"):
            (export.write_docx if kind == "docx" else export.write_pdf)(self.report(), path)
        elif kind == "xlsx":
            dropped = {k: n for k, n in export.export_workbook(self.tables, self.crawl_overview().first().asDict(), path).items() if n}
            if dropped:
                raise ExportError(f"{path} is not whole: " + ", ".join(f"{n:,} rows of {k} are beyond a sheet's last row" for k, n in dropped.items()))
        else:
            with open(path, "w", encoding="utf-8", newline="") as out:
                (export.write_csv if kind == "csv" else export.write_json)(export.export_rows(self.tables, subject, filters, sort), out)


class Engine:
    """What an application holds: at most one open crawl, and at most one that runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.crawl = spark, None
        self.lifecycle: crawl.Lifecycle | None = None
        self.worker: threading.Thread | None = None
        self.error: BaseException | None = None

    def engine_info(self) -> dict[str, object]:
        return {"version": schema.VERSION, "spark": self.spark.version, "rules": len(A.standard_registry().rules), "formats": export.FORMATS}

    def rules(self) -> list[dict[str, str]]:
        return Crawl(self.spark, tables={}).rules()

    def suggest_output(self, seed: str, folder: str = ".") -> str:
        return free_name(str(Path(folder) / output_name(seed)))

    def open_crawl(self, root: str) -> Crawl:
        self.crawl = Crawl(self.spark, root)
        return self.crawl

    def close_crawl(self) -> None:
        self.crawl = None

    def current_crawl(self) -> Crawl:
        if self.crawl is None:
            raise NoCrawlOpen("no crawl is open")
        return self.crawl

    def may_start(self) -> bool:
        return self.worker is None or not self.worker.is_alive()

    def start_crawl(self, settings: CrawlSettings, root: str, transport_factory: Callable[[], http.Transport] | None = None, on_progress: Callable[[crawl.Progress], None] = lambda p: None, resume: str | None = None) -> crawl.Lifecycle:
        """Crawl in the background and store the result in root, which is then open. resume: the folder of a crawl to go on with."""
        if not self.may_start():
            raise AlreadyRunning("a crawl is running")
        config = http.FetchConfig(per_host=settings.concurrency)
        make = transport_factory or (lambda: http.standard_transport(config))
        self.lifecycle, self.error = crawl.Lifecycle(settings.max_depth, settings.max_urls, settings.max_seconds), None
        life = self.lifecycle

        def run() -> None:
            try:
                old = store.open_crawl(self.spark, resume) if resume else None
                pending, seen = crawl.resume_state(old) if old else (None, None)
                tables = crawl.run_crawl(self.spark, settings.seed, make, life, config, on_progress=on_progress, pending=pending, seen=seen, before=old)
                store.save(tables, root, analysed=life.status == crawl.COMPLETED)
                self.crawl = Crawl(self.spark, root)
            except Exception as e:  # told to who waits for the crawl
                self.error = e

        self.worker = threading.Thread(target=run, daemon=True)
        self.worker.start()
        return life

    def wait(self, timeout: float | None = None) -> None:
        """Until the running crawl ends; its error is raised here."""
        if self.worker is not None:
            self.worker.join(timeout)
        if self.error is not None:
            raise StoreError(str(self.error)) from self.error

    def _running(self) -> crawl.Lifecycle:
        if self.lifecycle is None:
            raise Missing("no crawl was started")
        return self.lifecycle

    def pause_crawl(self) -> bool:
        return self._running().pause()

    def resume_crawl(self) -> bool:
        return self._running().resume()

    def cancel_crawl(self) -> bool:
        return self._running().cancel()

    def live_pages(self) -> DataFrame | None:
        """The pages of the running crawl so far."""
        return self._running().live()

    def progress(self) -> crawl.Progress:
        return self._running().progress()
