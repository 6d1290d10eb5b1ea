"""The URL, hash, robots and sitemap functions as SQL functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import robots, urls
from .text import fnv1a64_many


def register_functions(spark: SparkSession, agent: str = "trawlspark") -> list[str]:
    """normalize_url(url), join_url(base, href), fnv1a64(text), robots_allows(file, path) and parse_sitemap(xml); their names."""
    ship(spark)

    @F.pandas_udf("string")
    def normalize_url(a: pd.Series) -> pd.Series:
        return a.map(lambda x: urls.canonical_url(x) if isinstance(x, str) else None)

    @F.pandas_udf("string")
    def join_url(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([urls.resolve(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype=object)

    @F.pandas_udf("long")
    def fnv1a64(a: pd.Series) -> pd.Series:
        there = [isinstance(x, str) for x in a]
        found = iter(fnv1a64_many([x.encode() for x in a if isinstance(x, str)]).tolist())
        return pd.Series([next(found) if t else None for t in there], dtype="Int64")

    @F.pandas_udf("boolean")
    def robots_allows(a: pd.Series, b: pd.Series) -> pd.Series:
        rules: dict[str, robots.Rules] = {}
        out = []
        for text, path in zip(a, b, strict=True):
            if not isinstance(text, str) or not isinstance(path, str):
                out.append(None)
                continue
            if text not in rules:
                rules = {text: robots.parse(text, agent)}
            out.append(rules[text].allows(path))
        return pd.Series(out, dtype="boolean")

    @F.pandas_udf("array<string>")
    def parse_sitemap(a: pd.Series) -> pd.Series:
        from trawlspark.sources import sitemaps

        return a.map(lambda x: sitemaps.parse(x).locations if isinstance(x, str) else None)

    made = {"normalize_url": normalize_url, "join_url": join_url, "fnv1a64": fnv1a64, "robots_allows": robots_allows, "parse_sitemap": parse_sitemap}
    for name, function in made.items():
        spark.udf.register(name, function)
    return list(made)
