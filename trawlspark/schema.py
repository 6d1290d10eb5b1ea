"""The crawl tables. One crawl is one folder with a Parquet table for each."""

VERSION = 1

TABLES = {
    "pages": "id long, url string, status int, depth int, size long, truncated boolean, content_type string, charset string, kind string, content_type_mismatch boolean, elapsed_ms int, time_to_headers_ms int, title string, meta_description string, canonical string, canonical_url string, noindex boolean, nofollow boolean, noarchive boolean, nosnippet boolean, word_count int, title_count int, body_hash long, has_issue boolean",
    "page_detail": "page_id long, redirect_chain array<string>, h1 array<string>, h2 array<string>, hreflang array<struct<lang: string, href: string>>, open_graph array<struct<name: string, value: string>>, images array<struct<src: string, alt: string>>",
    "links": "id long, source_page_id long, href string, target_url string, anchor_text string, nofollow boolean",
    "crawl": "seed_url string, max_depth int, max_urls long, max_duration_ns long, analysed boolean",
    "frontier": "url string, depth int",
    "crawl_failures": "url string, reason string",
    "crawl_redirects": "source_url string, status int, final_url string, chain array<struct<url: string, status: int, location: string, target: string>>, outcome string",
    "issues": "url string, page_id long, rule_id string, severity string, detail string",
    "resources": "url string, status int, content_length long, content_type string",
    "sitemaps": "url string, status int, urls long, is_index boolean, found_by string, truncated boolean",
    "sitemap_urls": "url string, source string",
    "robots_files": "origin string, status int, body string",
}

#: A page record as the extractor returns it.
RECORD_FIELDS = {
    "url": "string", "status": "int", "depth": "int", "size": "long", "truncated": "boolean", "content_type": "string", "charset": "string", "kind": "string", "content_type_mismatch": "boolean",
    "elapsed_ms": "int", "time_to_headers_ms": "int", "redirect_chain": "array<string>", "title": "string", "title_count": "int", "meta_description": "string", "h1": "array<string>", "h2": "array<string>",
    "canonical": "string", "canonical_url": "string", "noindex": "boolean", "nofollow": "boolean", "noarchive": "boolean", "nosnippet": "boolean",
    "hreflang": "array<struct<lang: string, href: string>>", "open_graph": "array<struct<name: string, value: string>>",
    "links": "array<struct<href: string, target: string, text: string, nofollow: boolean>>", "images": "array<struct<src: string, alt: string>>", "word_count": "int", "body_hash": "long",
}
RECORD = ", ".join(f"{name} {kind}" for name, kind in RECORD_FIELDS.items())
