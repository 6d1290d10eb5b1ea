"""Canonical crawl URLs: one string for each page, or None for what a crawler never fetches."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote, urljoin

DEFAULT_PORTS = {"http": "80", "https": "443"}
_URL = re.compile(r"(?i)^(https?):[/\\]+([^/\\?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$", re.S)
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")
#: Percent-encoded in paths and in queries besides controls and non-ASCII (fixed values).
_PATH, _QUERY = ' "#<>?`{}^', " \"#<>'"
_FORBIDDEN_HOST = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")


def _encode(text: str, unsafe: str) -> str:
    if not re.search(rf"[^\x21-\x7e]|[{re.escape(unsafe)}]", text):
        return text
    return "".join("".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) if ord(c) < 0x21 or ord(c) > 0x7E or c in unsafe else c for c in text)


def _resolve_dots(path: str) -> str:
    """Dot segments resolved; the result starts with a slash."""
    out: list[str] = []
    parts = path.replace("\\", "/").split("/")[1:] or [""]
    for i, part in enumerate(parts):
        plain, last = part.lower().replace("%2e", "."), i == len(parts) - 1
        if plain in (".", ".."):
            if plain == ".." and out:
                out.pop()
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def _host(host: str) -> str | None:
    if host.startswith("["):
        return host.lower() if re.fullmatch(r"\[[0-9a-fA-F:.]+\]", host) else None
    host = unquote(host) if "%" in host else host
    name = host.lower() if host.isascii() else _ascii_name(host)
    if not name or _FORBIDDEN_HOST.search(name):
        return None
    labels = name.removesuffix(".").split(".")
    return _ipv4(labels) if re.fullmatch(r"[0-9]+|0x[0-9a-f]*", labels[-1]) else name


def _ascii_name(host: str) -> str | None:
    """A host in punycode by IDNA 2008: sharp s, final sigma and joiners are letters of their own, other characters fold."""
    folded = "".join(ch if ch in "ßς\u200c\u200d" else ch.casefold() for ch in host.translate({0x3002: ".", 0xFF0E: ".", 0xFF61: "."}) if ch != "\u00ad")
    try:
        return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in unicodedata.normalize("NFKC", folded).split("."))
    except UnicodeError:
        return None


def _ipv4(labels: list[str]) -> str | None:
    """Dotted decimal of one to four numbers (decimal, 0 octal, 0x hexadecimal), the last of which fills what is left; None if they are none."""
    if len(labels) > 4:
        return None
    try:
        n = [int(x[2:] or "0", 16) if x.startswith("0x") else int(x, 8) if len(x) > 1 and x[0] == "0" else int(x) for x in labels]
    except ValueError:
        return None
    if any(x > 255 for x in n[:-1]) or n[-1] >= 256 ** (5 - len(n)):
        return None
    whole = n[-1] + sum(x << 8 * (3 - k) for k, x in enumerate(n[:-1]))
    return ".".join(str(whole >> s & 255) for s in (24, 16, 8, 0))


def canonical_url(text: str | None) -> str | None:
    """Scheme and host in lower case, default port and fragment gone, an empty path made "/", dot segments resolved, hosts in punycode,
    other characters percent-encoded. Trailing slash, path case, query order and an empty query stay. None unless http or https with a host."""
    if text is None:
        return None
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    m = _URL.match(text)
    if not m:
        return None
    scheme, authority, path, query = m[1].lower(), m[2], m[3], m[4] or ""
    user, _, place = authority.rpartition("@")
    split = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", place)
    host = _host(split[1]) if split else None
    if not host:
        return None
    port = split[2] or ""
    if port and int(port) > 65535:
        return None
    port = str(int(port)) if port else ""
    tail = f":{port}" if port and port != DEFAULT_PORTS[scheme] else ""
    return f"{scheme}://{user + '@' if user else ''}{host}{tail}{_encode(_resolve_dots(path or '/'), _PATH)}{_encode(query, _QUERY)}"


def resolve(base: str | None, href: str | None) -> str | None:
    """href against the page it is on; None for other schemes and what can't be parsed."""
    if base is None or href is None:
        return None
    href = re.sub(r"[\t\n\r]", "", href.strip("".join(map(chr, range(0x21)))))
    scheme = _SCHEME.match(href)
    if scheme:
        name = scheme[0][:-1].lower()
        if name not in DEFAULT_PORTS:
            return None
        if re.match(r"[/\\]", href[len(scheme[0]) :]):
            return canonical_url(href)
        if not base.lower().startswith(name + ":"):
            return canonical_url(f"{name}://{href[len(scheme[0]) :]}")
        href = href[len(scheme[0]) :]  # the base's own scheme and no slashes: a relative link
    at = base.split("#")[0]
    if href == "" or href.startswith("#"):
        return canonical_url(at)
    path, mark, rest = re.match(r"(?s)([^?#]*)([?#]?)(.*)", href).groups()
    path = path.replace("\\", "/")
    if path.startswith("//"):
        return canonical_url(at.split(":")[0] + ":" + path + mark + rest)
    if not path:
        return canonical_url(at.split("?")[0] + mark + rest)
    joined = urljoin(at.split("?")[0], "./" + path if ":" in path.split("/")[0] else path)
    return canonical_url(joined + mark + rest)


def percent_encode_needle(needle: str) -> str:
    """Non-ASCII characters as %XX of their UTF-8 bytes; ASCII as it is."""
    return "".join(c if c.isascii() else "".join(f"%{b:02X}" for b in c.encode()) for c in needle)
