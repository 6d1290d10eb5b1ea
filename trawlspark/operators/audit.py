"""The standard registry and the whole audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .page_rules import PAGE_RULES, page_findings, page_subjects
from .registry import Registry
from .site_rules import SITE_RULES, site_findings


def standard_registry() -> Registry:
    registry = Registry()
    for rule in (*PAGE_RULES, *SITE_RULES):
        registry.add(rule)
    return registry


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """All findings of all rules."""
    return page_findings(page_subjects(tables)).unionByName(site_findings(tables))


def with_issue_flag(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """pages with has_issue set where a finding names the page."""
    flagged = issues.filter("page_id is not null").select(F.col("page_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return pages.drop("has_issue").join(flagged, "id", "left").withColumn("has_issue", F.coalesce("_hit", F.lit(False))).drop("_hit")
