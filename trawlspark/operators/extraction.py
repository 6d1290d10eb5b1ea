"""Raw pages to page records: one Arrow stage over (url, html, ...), everything after it native."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import body as B
from ..functions import urls
from ..functions.html import ROBOTS, Markup, extract
from ..functions.text import fnv1a64_many
from ..schema import RECORD, RECORD_FIELDS
from ..shipping import map_arrow, ship

#: Rows a task parses at a time; with pages of up to 8 MB this bounds its memory.
ROWS_AT_ONCE = 256
#: What a response may come with; null where the input lacks the column.
TRANSPORT = {"status": "int", "depth": "int", "truncated": "boolean", "content_type": "string", "elapsed_ms": "int", "time_to_headers_ms": "int", "redirect_chain": "array<string>"}
_LINK = pa.struct([("href", pa.string()), ("target", pa.string()), ("text", pa.string()), ("nofollow", pa.bool_())])
_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
    "hreflang": pa.list_(pa.struct([("lang", pa.string()), ("href", pa.string())])), "open_graph": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])),
    "links": pa.list_(_LINK), "images": pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string())])),
}


def _record(url: str, html: str | None, t: dict) -> dict:
    raw = (html or "").encode()
    mime = B.media_type(t["content_type"])
    kind = B.classify(mime)
    wrong = B.is_mismatch(kind, raw)
    m = extract(html or "", url) if kind == "html" and not wrong else Markup()
    return {
        "url": url, "status": t["status"], "depth": t["depth"], "size": len(raw), "truncated": bool(t["truncated"]), "content_type": mime, "charset": B.charset(t["content_type"]),
        "kind": kind, "content_type_mismatch": wrong, "elapsed_ms": t["elapsed_ms"], "time_to_headers_ms": t["time_to_headers_ms"], "redirect_chain": t["redirect_chain"] or [],
        "title": m.title, "title_count": m.title_count, "meta_description": m.meta_description, "h1": m.h1, "h2": m.h2, "canonical": m.canonical, "canonical_url": m.canonical_url,
        **{d: d in m.robots for d in ROBOTS}, "hreflang": m.hreflang, "open_graph": m.open_graph, "links": m.links, "images": m.images, "word_count": len(m.words), "body_hash": " ".join(m.words).encode() if m.words else None,
    }


def extract_records(pages: DataFrame) -> DataFrame:
    """pages: url, html and any columns of TRANSPORT (defaults: status 200, depth 0, text/html). A record for each page with a crawlable URL."""
    default = {"status": F.lit(200), "depth": F.lit(0), "truncated": F.lit(False), "content_type": F.lit("text/html")}
    have = set(pages.columns)
    source = pages.select("url", "html", *(F.col(c).cast(t).alias(c) if c in have else default.get(c, F.lit(0 if t == "int" else None)).cast(t).alias(c) for c, t in TRANSPORT.items()))
    kinds = {name: _ARROW[name] if "struct" in kind else _ARROW[kind] for name, kind in RECORD_FIELDS.items()}
    order = list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS_AT_ONCE):
                records = []
                for row in whole.slice(i, ROWS_AT_ONCE).to_pylist():
                    url = urls.canonical_url(row["url"])
                    if url is not None:
                        records.append(_record(url, row["html"], row))
                full = [r for r in records if r["body_hash"] is not None]
                for r, h in zip(full, fnv1a64_many([r["body_hash"] for r in full]).tolist(), strict=True):
                    r["body_hash"] = h
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in records], kinds[c]) for c in order], order)

    return map_arrow(source, run, RECORD)


def outlinks(records: DataFrame) -> DataFrame:
    """(url, k, href, target, text, nofollow) in document order."""
    return records.select("url", F.posexplode("links").alias("k", "l")).select("url", "k", "l.href", "l.target", "l.text", "l.nofollow")


def _urls_udf(function, *columns: Column) -> Column:
    if len(columns) == 1:

        @F.pandas_udf("string")
        def one(a: pd.Series) -> pd.Series:
            return a.map(lambda x: function(x) if isinstance(x, str) else None)

        return one(*columns)

    @F.pandas_udf("string")
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype=object)

    return two(*columns)


def canonical_urls(df: DataFrame, column: str, into: str) -> DataFrame:
    ship(df.sparkSession)
    return df.withColumn(into, _urls_udf(urls.canonical_url, F.col(column)))


def resolved_urls(df: DataFrame, base: str, href: str, into: str) -> DataFrame:
    ship(df.sparkSession)
    return df.withColumn(into, _urls_udf(urls.resolve, F.col(base), F.col(href)))


def text_hashes(df: DataFrame, column: str, into: str) -> DataFrame:
    """The FNV-1a hash of a text's bytes; null for null."""
    ship(df.sparkSession)

    @F.pandas_udf("long")
    def hashed(a: pd.Series) -> pd.Series:
        there = a.map(lambda x: isinstance(x, str)).to_numpy(bool)
        out = pd.Series(pd.array(np.zeros(len(a), np.int64), dtype="Int64")).mask(~there)
        out[there] = fnv1a64_many([x.encode() for x in a[there]])
        return out

    return df.withColumn(into, hashed(F.col(column)))
