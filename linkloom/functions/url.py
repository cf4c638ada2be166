"""Canonical keys of page urls."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of index documents, paging parameters and identifier parameters.
INDEX = frozenset(f"{name}.{kind}" for name in ("index", "default") for kind in ("html", "htm", "php", "asp", "aspx", "jsp"))
PAGES = frozenset("page paged pg pagenum page_no pagenumber seite pagina sayfa strona".split())
OFFSETS = frozenset("start offset limitstart".split())
IDS = frozenset("page_id p post id article product_id".split())
#: Names that mark a page of a listing without being kept as a number.
MORE_PAGES = frozenset("p currentpage pageindex page_index".split())
PAGINATION = PAGES | OFFSETS | MORE_PAGES


def _query(raw: str, keep: frozenset[str] = frozenset(), drop: frozenset[str] = frozenset()) -> str:
    """The parameters that select another page, sorted; ``keep`` and ``drop`` are a tenant's own names."""
    kept: dict[str, str] = {}
    for part in raw.split("&"):
        name, _, value = part.partition("=")
        name, value = unquote(name).lower(), unquote(value).lower()
        if name in kept or name in drop:
            continue
        if name in PAGES or name in OFFSETS:
            if value.isascii() and value.isdigit() and int(value) > (1 if name in PAGES else 0):
                kept[name] = str(int(value))
        elif (name in IDS or name in keep) and re.fullmatch(r"[\w.-]{1,64}", value):
            kept[name] = str(int(value)) if value.isascii() and value.isdigit() else value
    return "&".join(f"{n}={quote(v)}" for n, v in sorted(kept.items()))


def is_kept(name: str, keep: frozenset[str] = frozenset(), drop: frozenset[str] = frozenset()) -> bool:
    """Whether keys keep this query parameter."""
    name = name.strip().lower()
    return name not in drop and name in PAGES | OFFSETS | IDS | keep


def normalise(url: str | None, keep: frozenset[str] = frozenset(), drop: frozenset[str] = frozenset()) -> str | None:
    """host/path?query of a web address, the same for all its spellings; null for anything else. Keys map to themselves."""
    if not url or not url.strip():
        return None
    url = url.strip()
    if url.startswith("//"):
        url = f"http:{url}"
    has_scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(?!\d)", url)
    if has_scheme and not url.lower().startswith(("http://", "https://")) or url.startswith(("/", "?", "#")):
        return None
    try:
        parts = urlsplit(url if has_scheme else f"http://{url}")
        host, port = (parts.hostname or "").rstrip("."), parts.port
        host = host if host.isascii() else host.encode("idna").decode()
    except (ValueError, UnicodeError):
        return None
    if "." not in host:
        return None
    bare = re.sub(r"^www\d*\.", "", host)
    host = bare if "." in bare else host
    if port not in (None, 80, 443):
        host += f":{port}"
    out: list[str] = []
    for piece in unquote(parts.path).split("/"):
        piece = piece.split(";")[0].lower()
        if piece == "..":
            del out[-1:]
        elif piece not in ("", "."):
            out.append(piece)
    if out and out[-1] in INDEX:
        out.pop()
    path, query = "".join(f"/{quote(p)}" for p in out), _query(parts.query, keep, drop)
    return host + path + (f"?{query}" if query else "")


def url_key(url: Column) -> Column:
    """The key of a url column, in Arrow batches: host names need IDNA, which Spark has no expression for."""

    def keys(urls: pd.Series) -> pd.Series:
        return urls.map(normalise)

    return F.pandas_udf(keys, T.StringType())(url)


def host_of(key: Column) -> Column:
    """The host of a key."""
    return F.regexp_extract(key, "^[^/?]*", 0)


def _after_host(url: Column) -> Column:
    """Path and query of a url, a key (host/path) or a bare path, lower-cased and without the fragment."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^\\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?]*|(?=[^/?])[^/?]*)", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_host(url), "^[^?]*", 0)


def is_sitemap(url: Column) -> Column:
    """A path segment with the word sitemap, or site followed by map; the host never counts, nor does an extension."""
    segments = F.transform(F.split(path_of(url), "/"), lambda s: F.regexp_replace(F.regexp_replace(s, "(?<=.)\\.[^.]*$", ""), "[^0-9a-z]+", " "))
    return F.exists(segments, lambda s: s.rlike("(?:^| )(?:sitemap|site map)(?: |$)"))


def is_pagination(url: Column) -> Column:
    """A page of a listing: a pagination parameter with any value, or /page/2, /p/2 or /page-2 in the path."""
    names = "|".join(sorted(PAGINATION))
    query = F.regexp_extract(_after_host(url), "^[^?]*\\?(.*)$", 1)
    return F.concat(F.lit("&"), query).rlike(f"&\\s*(?:{names})\\s*(?:=|&|$)") | path_of(url).rlike("(?:^|/)(?:page-[0-9]+|(?:page|p)/+[0-9]+)(?:/|$)")


def normal_path(path: Column) -> Column:
    """A configured path: lower case, one slash before it, none behind."""
    return F.concat(F.lit("/"), F.lower(F.regexp_replace(F.trim(path), "^/+|/+$", "")))


def under_paths(url: Column, paths: list[str]) -> Column:
    """Whether the url's path is one of ``paths`` or lies below one."""
    own, found = normal_path(path_of(url)), F.lit(False)
    for p in paths:
        p = "/" + p.strip().strip("/").lower()
        found = found | (own == p) | own.startswith(p.rstrip("/") + "/")
    return found
