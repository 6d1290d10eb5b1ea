"""DuckDB SQL for the findings, written from the rules' definitions and not from the Spark code."""

from __future__ import annotations

from .site_model import URL, with_clause

_HTML = "kind = 'html'"
_CANON = URL.format("canonical_id")
_PREFIXES = "'" + "','".join(sorted({n[:k] for n in "amp apos hellip ldquo lsquo mdash nbsp ndash quot rdquo rsquo lt gt".split() for k in range(1, len(n) + 1)})) + "'"
_TAIL = "regexp_extract(meta_description, '&([^&]*)$', 1)"
_DANGLING = f"(contains(meta_description, '&') AND ({_TAIL} IN ({_PREFIXES}) OR regexp_full_match({_TAIL}, '#([xX][0-9a-fA-F]+|[0-9]+)')))"

#: rule: (severity, condition on m, detail)
PAGE = {
    "response.4xx": ("warning", "status BETWEEN 400 AND 499", "'HTTP ' || status"),
    "response.5xx": ("critical", "status >= 500", "'HTTP ' || status"),
    "response.redirect-chain": ("warning", "redirect_hops > 2", "redirect_hops || ' redirects'"),
    "title.missing": ("critical", f"{_HTML} AND title IS NULL", "NULL"),
    "title.too-long": ("warning", f"{_HTML} AND length(title) > 60", "length(title) || ' characters'"),
    "title.too-short": ("warning", f"{_HTML} AND length(title) < 30", "length(title) || ' characters'"),
    "title.multiple": ("warning", f"{_HTML} AND title_count > 1", "title_count || ' <title> elements'"),
    "description.missing": ("warning", f"{_HTML} AND meta_description IS NULL", "NULL"),
    "description.too-long": ("warning", f"{_HTML} AND length(meta_description) > 160", "length(meta_description) || ' characters'"),
    "description.too-short": ("notice", f"{_HTML} AND length(meta_description) < 70", "length(meta_description) || ' characters'"),
    "description.truncated-entity": ("warning", f"{_HTML} AND {_DANGLING}", f"'&' || {_TAIL}"),
    "content.missing-h1": ("warning", f"{_HTML} AND h1_count = 0", "NULL"),
    "content.multiple-h1": ("notice", f"{_HTML} AND h1_count > 1", "h1_count || ' <h1> elements'"),
    "content.empty-h1": ("warning", f"{_HTML} AND h1_empty AND h1_count > 0", "NULL"),
    "content.thin": ("warning", f"{_HTML} AND word_count < 200", "word_count || ' words'"),
    "indexability.noindex": ("warning", f"{_HTML} AND noindex", "NULL"),
    "indexability.canonical-elsewhere": ("notice", f"{_HTML} AND canonical_id IS NOT NULL AND canonical_id <> id", _CANON),
}
_LINKED = "(SELECT target_url, count(DISTINCT src) AS n FROM l GROUP BY target_url)"
#: rule: (severity, SELECT url, page_id, detail)
OTHER = {
    "response.mixed-content": ("critical", "SELECT m.url, m.id AS page_id, l.target_url AS detail FROM m JOIN l ON l.src = m.id WHERE m.kind = 'html' AND l.target_url LIKE 'http://%'"),
    "media.missing-alt": ("warning", "SELECT m.url, m.id AS page_id, s.missing || ' of ' || s.total || ' images: ' || s.first_src AS detail FROM m JOIN (SELECT id, count(*) AS total, count(*) FILTER (WHERE alt IS NULL) AS missing, min_by(src, j) FILTER (WHERE alt IS NULL) AS first_src FROM images GROUP BY id) s ON s.id = m.id WHERE m.kind = 'html' AND s.missing > 0"),
    "response.redirect-loop": ("critical", "SELECT source_url AS url, CAST(NULL AS BIGINT) AS page_id, hops || ' hops' AS detail FROM redirects WHERE lower(outcome) LIKE 'redirect loop%'"),
    "title.duplicate": ("warning", "SELECT url, id AS page_id, title AS detail FROM m WHERE title IN (SELECT title FROM m WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1)"),
    "description.duplicate": ("warning", "SELECT url, id AS page_id, meta_description AS detail FROM m WHERE meta_description IN (SELECT meta_description FROM m WHERE meta_description IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"),
    "content.duplicate-body": ("warning", "SELECT url, id AS page_id, CAST(NULL AS VARCHAR) AS detail FROM m WHERE body_hash IN (SELECT body_hash FROM m WHERE body_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"),
    "indexability.canonical-non-200": ("critical", "SELECT a.url, a.id AS page_id, b.url || ' returns ' || b.status AS detail FROM m a JOIN m b ON b.id = a.canonical_id WHERE b.status <> 200"),
    "indexability.canonical-chain": ("warning", "SELECT a.url, a.id AS page_id, 'via ' || b.url || ' to ' || z.url AS detail FROM m a JOIN m b ON b.id = a.canonical_id JOIN m z ON z.id = b.canonical_id WHERE a.canonical_id <> a.id AND b.canonical_id <> b.id"),
    "indexability.blocked-but-linked": ("warning", f"SELECT f.url, CAST(NULL AS BIGINT) AS page_id, 'linked from ' || k.n || ' page(s)' AS detail FROM failures f JOIN {_LINKED} k ON k.target_url = f.url WHERE lower(f.reason) LIKE 'robots.txt disallows%'"),
    "media.broken-image": ("warning", "SELECT url, CAST(NULL AS BIGINT) AS page_id, 'returns ' || status AS detail FROM resources WHERE status >= 400"),
    "media.oversized-image": ("notice", "SELECT url, CAST(NULL AS BIGINT) AS page_id, (content_length // 1024) || ' KB' AS detail FROM resources WHERE status = 200 AND content_length > 102400"),
    "links.broken-internal": ("warning", f"SELECT m.url, m.id AS page_id, m.status || ', linked from ' || k.n || ' page(s)' AS detail FROM m JOIN {_LINKED} k ON k.target_url = m.url WHERE m.status >= 400"),
    "links.orphan-page": ("notice", "SELECT url, id AS page_id, CAST(NULL AS VARCHAR) AS detail FROM m WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM l WHERE l.target_url = m.url)"),
}
PAGE_LEVEL = (*PAGE, "response.mixed-content", "media.missing-alt")


def finding_sql(rule: str) -> str:
    if rule in PAGE:
        severity, where, detail = PAGE[rule]
        rows = f"SELECT url, id AS page_id, CAST({detail} AS VARCHAR) AS detail FROM m WHERE {where}"
    else:
        severity, rows = OTHER[rule]
    return f"SELECT url, page_id, '{rule}' AS rule_id, '{severity}' AS severity, detail FROM ({rows})"


def all_findings(rules: tuple[str, ...] = (*PAGE, *OTHER)) -> str:
    return "\nUNION ALL ".join(finding_sql(r) for r in rules)


def on_model(sql: str, issues: bool = False) -> str:
    """sql over the shared tables, with issues if it asks for them."""
    return f"{with_clause()}{f', issues AS ({all_findings()})' if issues else ''}\n{sql}"
