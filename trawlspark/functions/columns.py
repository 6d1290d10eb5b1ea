"""Expressions over columns of the crawl tables: native, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of entities whose cut-off remains are looked for (fixed values).
ENTITY_NAMES = ("amp", "apos", "hellip", "ldquo", "lsquo", "mdash", "nbsp", "ndash", "quot", "rdquo", "rsquo", "lt", "gt")
ENTITY_PREFIXES = tuple(sorted({n[:k] for n in ENTITY_NAMES for k in range(1, len(n) + 1)}))
SEVERITIES = ("critical", "warning", "notice")
SEVERITY_WORDS = {"critical": "Issue", "warning": "Warning", "notice": "Opportunity"}
KINDS = ("html", "pdf", "image", "other", "undeclared")


def dangling_entity(text: Column) -> Column:
    """The unfinished entity at the end of a text ("&hell"), or null."""
    tail = F.substring_index(text, "&", -1)
    broken = tail.isin(*ENTITY_PREFIXES) | tail.rlike(r"\A#(?:[xX][0-9a-fA-F]+|[0-9]+)\z")
    return F.when(text.contains("&") & broken, F.concat(F.lit("&"), tail))


def media_type(content_type: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.substring_index(content_type, ";", 1))), F.lit(""))


def kind_of(mime: Column) -> Column:
    return F.when(mime.isNull(), "undeclared").when(mime.isin("text/html", "application/xhtml+xml"), "html").when(mime == "application/pdf", "pdf").when(mime.startswith("image/"), "image").otherwise("other")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


def severity_words(severity: Column) -> Column:
    return F.when(severity == "critical", "Issue").when(severity == "warning", "Warning").otherwise("Opportunity")


def status_tone(status: Column) -> Column:
    return F.when(status.between(200, 299), "good").when(status.between(300, 399), "moved").when(status.between(400, 499), "bad").when(status >= 500, "broken")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def port(url: Column) -> Column:
    written = F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1), F.lit("")).cast("int")
    return F.coalesce(written, F.when(url.startswith("https:"), 443).otherwise(80))


def base_host(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def is_internal(url: Column, seed: Column, subdomains: bool = False) -> Column:
    """Same base host and port, where a scheme's own port counts as none; with subdomains, hosts below the seed's too."""
    mine, home = base_host(host(url)), base_host(host(seed))
    own = lambda u: F.nullif(port(u), F.when(u.startswith("https:"), 443).otherwise(80))
    same_port = own(url).eqNullSafe(own(seed))
    below = mine.endswith(F.concat(F.lit("."), home)) if subdomains else F.lit(False)
    return same_port & ((mine == home) | below)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:]*://[^/]*(/[^?#]*)?", 1)


def url_params(url: Column) -> Column:
    """What follows the first question mark, or null."""
    return F.when(url.contains("?"), F.regexp_extract(url, r"\?(?s)(.*)$", 1))


def url_notes(url: Column) -> Column:
    """What is unusual about a URL's path."""
    path = path_of(url)
    plain = F.regexp_replace(path, "%[0-9A-Fa-f]{2}", "")
    deep = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) > 5
    notes = ((plain.rlike("[A-Z]"), "capitals"), (path.contains("_"), "underscores"), (path.contains("%"), "encoded characters"), (deep, "deep path"))
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in notes)), lambda x: x.isNotNull())


def crumbs(url: Column) -> Column:
    """Host and path segments, as a search result shows them."""
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    return F.array_join(F.concat(F.array(host(url)), parts), " › ")


def json_or_null(text: Column, kind: str) -> Column:
    """A detail field that is kept as JSON text; null where it doesn't parse, never an error."""
    return F.from_json(text, kind, {"mode": "PERMISSIVE"})


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def is_js_shell(kind: Column, status: Column, words: Column, size: Column) -> Column:
    """Much markup and almost no text: a page that waits for a script."""
    return (kind == "html") & status.between(200, 299) & (words < 50) & (size > 20_000)
