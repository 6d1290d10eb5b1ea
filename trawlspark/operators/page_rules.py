"""Rules that look at one page: all of them are one projection and one explode over a single scan.

Their input is pages joined with page_detail (and the links' targets for mixed content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dangling_entity
from .registry import PageRule

c = F.col
_TEXT = "array<string>"


def once(condition: Column, detail: Column | None = None) -> Column:
    """One finding where the condition holds."""
    return F.when(condition, F.array(detail if detail is not None else F.lit(None).cast("string")))


def _chars(name: str) -> Column:
    return F.char_length(name)


def _count(n: Column, words: str) -> Column:
    return F.concat(n.cast("string"), F.lit(words))


def _missing_alt() -> Column:
    bare = F.filter("images", lambda i: i["alt"].isNull())
    detail = F.concat(F.size(bare).cast("string"), F.lit(" of "), F.size("images").cast("string"), F.lit(" images: "), F.get(bare, F.lit(0))["src"])
    return once(F.size(bare) > 0, detail)


def _mixed_content() -> Column:
    return F.when(c("url").startswith("https://"), F.transform(F.filter("links", lambda x: x["target"].startswith("http://")), lambda x: x["href"]))


PAGE_RULES = (
    PageRule("response.4xx", "warning", "The server says the page is not there.", "Restore it, redirect it, or stop linking to it.", lambda: once(c("status").between(400, 499), F.concat(F.lit("HTTP "), c("status").cast("string"))), False),
    PageRule("response.5xx", "critical", "The server failed to answer.", "Find the fault in the server's log.", lambda: once(c("status") >= 500, F.concat(F.lit("HTTP "), c("status").cast("string"))), False),
    PageRule("response.redirect-chain", "warning", "The page is reached over more than two redirects.", "Link to the final address.", lambda: once(F.size("redirect_chain") > 2, _count(F.size("redirect_chain"), " redirects")), False),
    PageRule("response.mixed-content", "critical", "A secure page links to an insecure address.", "Use https in the link.", _mixed_content),
    PageRule("title.missing", "critical", "There is no title.", "Write one for this page.", lambda: once(c("title").isNull())),
    PageRule("title.too-long", "warning", "The title has more than 60 characters.", "Say the same in fewer.", lambda: once(_chars("title") > 60, _count(_chars("title"), " characters"))),
    PageRule("title.too-short", "warning", "The title has fewer than 30 characters.", "Use the room to describe the page.", lambda: once(_chars("title") < 30, _count(_chars("title"), " characters"))),
    PageRule("title.multiple", "warning", "There are several titles.", "Leave one.", lambda: once(c("title_count") > 1, _count(c("title_count"), " <title> elements"))),
    PageRule("description.missing", "warning", "There is no meta description.", "Write one.", lambda: once(c("meta_description").isNull())),
    PageRule("description.too-long", "warning", "The description has more than 160 characters.", "Cut it to what a result shows.", lambda: once(_chars("meta_description") > 160, _count(_chars("meta_description"), " characters"))),
    PageRule("description.too-short", "notice", "The description has fewer than 70 characters.", "Say more about the page.", lambda: once(_chars("meta_description") < 70, _count(_chars("meta_description"), " characters"))),
    PageRule("description.truncated-entity", "warning", "The description ends inside an HTML entity.", "Cut it before escaping it.", lambda: once(dangling_entity(c("meta_description")).isNotNull(), dangling_entity(c("meta_description")))),
    PageRule("content.missing-h1", "warning", "There is no main heading.", "Add one.", lambda: once(F.size("h1") == 0)),
    PageRule("content.multiple-h1", "notice", "There are several main headings.", "Keep one, demote the others.", lambda: once(F.size("h1") > 1, _count(F.size("h1"), " <h1> elements"))),
    PageRule("content.empty-h1", "warning", "A main heading is empty.", "Fill or remove it.", lambda: once(F.exists("h1", lambda x: x == ""))),
    PageRule("content.thin", "warning", "The page has fewer than 200 words.", "Add what a visitor came for.", lambda: once(c("word_count") < 200, _count(c("word_count"), " words"))),
    PageRule("indexability.noindex", "warning", "The page asks not to be indexed.", "Make sure that this is meant.", lambda: once(c("noindex"))),
    PageRule("indexability.canonical-elsewhere", "notice", "The page names another page as canonical.", "Make sure that this is meant.", lambda: once(c("canonical_url") != c("url"), c("canonical_url"))),
    PageRule("media.missing-alt", "warning", "An image has no alt attribute.", "Describe it, or leave alt empty for decoration.", _missing_alt),
)

KNOWN = frozenset(r.id for r in PAGE_RULES)
#: Rules that read more than the pages table; of a rule that is not listed here, everything is at hand.
NEED_DETAIL = frozenset(("response.redirect-chain", "content.missing-h1", "content.multiple-h1", "content.empty-h1", "media.missing-alt"))
NEED_LINKS = frozenset(("response.mixed-content",))


def page_subjects(tables: dict[str, DataFrame], rules: tuple[PageRule, ...] = PAGE_RULES) -> DataFrame:
    """What the rules read: pages, with their detail and their links (array of href, target in document order) if a rule asks for them.

    Of the links only insecure ones matter, so the others are filtered at the scan and don't shuffle.
    """
    named = {r.id for r in rules}
    none = F.array()
    empty = {"redirect_chain": none.cast(_TEXT), "h1": none.cast(_TEXT), "images": F.from_json(F.lit("[]"), "array<struct<src: string, alt: string>>"), "links": F.from_json(F.lit("[]"), "array<struct<href: string, target: string>>")}
    j = tables["pages"]
    if named & NEED_DETAIL or not named <= KNOWN:
        detail = tables["page_detail"].select("page_id", "redirect_chain", "h1", "images")
        j = j.join(detail, c("id") == detail["page_id"], "left").drop("page_id")
    if named & NEED_LINKS or not named <= KNOWN:
        links = _insecure_links(tables["links"]) if named <= KNOWN else _links(tables["links"])
        j = j.join(links, c("id") == links["page_id"], "left").drop("page_id")
    return j.withColumns({k: F.coalesce(k, v) if k in j.columns else v for k, v in empty.items()})


def _insecure_links(links: DataFrame) -> DataFrame:
    return _links(links.filter(c("target_url").startswith("http://")))


def _links(links: DataFrame) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("id", "href", c("target_url").alias("target"))))
    return links.groupBy(c("source_page_id").alias("page_id")).agg(F.transform(own, lambda x: F.struct(x["href"].alias("href"), x["target"].alias("target"))).alias("links"))


def page_findings(subjects: DataFrame, rules: tuple[PageRule, ...] = PAGE_RULES) -> DataFrame:
    """(url, page_id, rule_id, severity, detail): all rules in one projection, whatever their number."""
    found = []
    for r in rules:
        details = F.when(c("kind") == "html", r.details()) if r.html_only else r.details()
        found.append(_tagged(r, details))
    every = F.concat(*found) if len(found) > 1 else found[0]
    return subjects.select("url", c("id").alias("page_id"), F.explode(every).alias("f")).select("url", "page_id", "f.rule_id", "f.severity", "f.detail")


def _tagged(rule: PageRule, details: Column) -> Column:
    tag = lambda d: F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), d.alias("detail"))
    return F.transform(F.coalesce(details, F.array().cast(_TEXT)), tag)
