"""What a response is: declared media type, charset, and what its first bytes say."""

from __future__ import annotations

#: First bytes of known formats (fixed values); WEBP has four bytes of length in between.
MAGIC = (("pdf", b"%PDF-"), ("image", b"\x89PNG\r\n\x1a\n"), ("image", b"\xff\xd8\xff"), ("image", b"GIF87a"), ("image", b"GIF89a"))


def media_type(content_type: str | None) -> str | None:
    name = (content_type or "").split(";")[0].strip().lower()
    return name or None


def charset(content_type: str | None) -> str | None:
    for part in (content_type or "").split(";")[1:]:
        key, _, value = part.partition("=")
        if key.strip().lower() == "charset":
            return value.strip().strip("\"'").lower() or None
    return None


def classify(mime: str | None) -> str:
    if mime is None:
        return "undeclared"
    if mime in ("text/html", "application/xhtml+xml"):
        return "html"
    if mime == "application/pdf":
        return "pdf"
    return "image" if mime.startswith("image/") else "other"


def sniff(body: bytes) -> str | None:
    for kind, start in MAGIC:
        if body.startswith(start):
            return kind
    if body[:4] == b"RIFF" and body[8:12] == b"WEBP":
        return "image"
    head = body[:512].lstrip(b" \t\r\n\x0c").lower()  # the window is cut first: a body of blanks is no scan
    return "html" if head.startswith((b"<!doctype html", b"<html")) else None


def is_mismatch(declared: str, body: bytes) -> bool:
    found = sniff(body)
    return declared != "undeclared" and found is not None and found != declared
