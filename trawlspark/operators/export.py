"""Exports: CSV and JSON of a view, a workbook, and a report in Word's and the portable document format.

Rows stream from the partitions one by one (``toLocalIterator``) into the file, so the
driver holds no more than a batch; ``write_parts`` lets the executors write instead.
"""

from __future__ import annotations

import csv
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import TextIO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import Filter, SortSpec, matching
from .lookups import resource_rows, sitemap_rows

PAGE_COLUMNS = ("url", "status", "depth", "size", "content_type", "kind", "noindex", "title", "meta_description", "canonical", "word_count", "elapsed_ms")
IMAGE_COLUMNS = ("url", "status", "content_length", "content_type", "issues")
SITEMAP_COLUMNS = ("url", "status", "source")
FORMATS = ("csv", "json", "xlsx", "docx", "pdf")
MAX_SHEET_ROWS = 1_048_575


class UnknownFormat(ValueError):
    pass


def format_of(path: str) -> str:
    kind = Path(path).suffix.lower().removeprefix(".")
    if kind not in FORMATS:
        raise UnknownFormat(path)
    return kind


def export_rows(t: dict[str, DataFrame], subject: str = "pages", filters: tuple[Filter, ...] = (), sort: SortSpec | None = None) -> DataFrame:
    """What an export of pages, images or sitemap writes. Filters and sort apply to pages."""
    if subject == "images":
        return resource_rows(t).select(*IMAGE_COLUMNS).orderBy("url")
    if subject == "sitemap":
        return sitemap_rows(t).select(*SITEMAP_COLUMNS).orderBy("url")
    if subject != "pages":
        raise ValueError(f"unknown subject: {subject}")
    rows = matching(t["pages"], filters, t.get("issues"))
    rows = rows.orderBy(*sort.order()) if sort else rows.orderBy("id")
    return rows.select(*PAGE_COLUMNS)


def _cell(value: object) -> object:
    return int(value) if isinstance(value, bool) else value


def write_csv(rows: DataFrame, out: TextIO) -> int:
    """Header and rows; null and empty are both empty; line feeds end lines. Returns the number of rows."""
    w = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    w.writerow(rows.columns)
    n = 0
    for row in rows.toLocalIterator():
        w.writerow(["" if v is None else _cell(v) for v in row])
        n += 1
    return n


def json_lines(rows: DataFrame) -> DataFrame:
    """One column, value: each row as a JSON object with sorted keys and nulls kept."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json(rows: DataFrame, out: TextIO) -> int:
    n = 0
    for row in json_lines(rows).toLocalIterator():
        out.write(("[\n" if n == 0 else ",\n") + row[0])
        n += 1
    out.write("\n]\n" if n else "[]\n")
    return n


def write_parts(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A folder of part files, written by the executors: for exports too large for one file."""
    if kind == "csv":
        rows.write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")
    else:
        json_lines(rows).write.text(path)


# ---- workbook -----------------------------------------------------------------------------------

_SHEET = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _column(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


def _row(number: int, values: Iterable[object]) -> str:
    cells = []
    for k, v in enumerate(values):
        at = f"{_column(k)}{number}"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            cells.append(f'<c r="{at}"><v>{v}</v></c>')
        elif v is not None:
            cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(v)))}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'


def write_workbook(path: str, sheets: dict[str, tuple[list[str], Iterator[Iterable[object]]]]) -> dict[str, int]:
    """An XLSX file, row by row. Returns the rows that did not fit on each sheet."""
    dropped: dict[str, int] = {}
    names = list(sheets)
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, name in enumerate(names, 1):
            header, rows = sheets[name]
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write((_SHEET + _row(1, header)).encode())
                n = 0
                for n, row in enumerate(rows, 1):
                    if n <= MAX_SHEET_ROWS:
                        f.write(_row(n + 1, row).encode())
                f.write(b"</sheetData></worksheet>")
            dropped[name] = max(0, n - MAX_SHEET_ROWS)
    return dropped


def export_workbook(t: dict[str, DataFrame], overview: dict[str, object], path: str) -> dict[str, int]:
    """Summary, Issues and Pages, and Images and Sitemap where they have rows."""
    from ..functions.columns import severity_rank

    issues = t["issues"].orderBy(severity_rank(F.col("severity")), "rule_id", "url").select("severity", "rule_id", "url", "detail")
    pages = t["pages"].orderBy("id").select("url", "status", F.when(F.col("noindex"), "noindex").otherwise("Indexable").alias("indexability"), "title", "meta_description", "word_count", F.round(F.col("size") / 1024, 0).cast("long").alias("size_kb"), "depth")
    sheets = {"Summary": (["fact", "value"], iter(overview.items())), "Issues": (issues.columns, issues.toLocalIterator()), "Pages": (pages.columns, pages.toLocalIterator())}
    images = export_rows(t, "images")
    if not images.isEmpty():
        sheets["Images"] = (images.columns, images.toLocalIterator())
    listed = export_rows(t, "sitemap").withColumn("status", F.coalesce(F.col("status").cast("string"), F.lit("Not reached")))
    if not listed.isEmpty():
        sheets["Sitemap"] = (listed.columns, listed.toLocalIterator())
    return write_workbook(path, sheets)


# ---- report -------------------------------------------------------------------------------------

NOT_CHECKED = ("hreflang", "structured data", "pagination", "JavaScript rendering", "page speed")


def report_paragraphs(site: str, overview: dict[str, object], findings: list[dict], summary: dict[str, object]) -> list[str]:
    """The report's text: facts, notes, and each finding with its remedy and first URLs."""
    out = [f"Site audit: {site}", f"{overview['crawled']:,} pages crawled, {len(findings)} kinds of findings."]
    if overview.get("js_shell"):
        out.append(f"{overview['js_shell']:,} pages have much markup and almost no text; scripts are not run, so what is said of them may not be what visitors see.")
    if summary.get("files"):
        missing = summary["not_listed"]
        tail = f"{missing:,} crawled pages are in no sitemap." if missing is not None else "A sitemap was too long to be read whole, so what it leaves out is unknown."
        out.append(f"The sitemaps list {summary['urls']:,} addresses, {summary['not_crawled']:,} of which no link reaches. {tail}")
    for f in findings:
        out.append(f"{f['label']}: {f['description']} ({f['affected']:,} addresses) {f['remedy']}")
        out += [f"    {u}" for u in f["urls"]]
    return [*out, "Not checked: " + ", ".join(NOT_CHECKED) + "."]


def write_docx(paragraphs: list[str], path: str) -> None:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(_CONTROL.sub("", p))}</w:t></w:r></w:p>' for p in paragraphs)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def write_pdf(paragraphs: list[str], path: str, width: int = 95, lines: int = 60) -> None:
    """Plain pages of text."""
    import textwrap

    flat = [x for p in paragraphs for x in (textwrap.wrap(p, width, subsequent_indent=" " * (len(p) - len(p.lstrip()))) or [""])]
    pages = [flat[i : i + lines] for i in range(0, len(flat), lines)] or [[]]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", None, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        shown = b"".join(b"(" + re.sub(rb"([\\()])", rb"\\\1", x.encode("cp1252", "replace")) + b") Tj T*\n" for x in page)
        stream = b"BT /F1 9 Tf 12 TL 50 790 Td\n" + shown + b"ET"
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    Path(path).write_bytes(out)
