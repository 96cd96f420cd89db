"""Addresses, headers, base64 and content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.core import any_of, blank_to_null, col, text


def url_decode(url: Column | str) -> Column:
    """Percent-decoding as UTF-8; plus signs and broken escapes stay, invalid bytes become the replacement character."""
    kept_plus = F.replace(col(url), F.lit("+"), F.lit("%2B"))
    escaped = F.regexp_replace(kept_plus, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.locate("%", col(url)) == 0, col(url)).otherwise(F.url_decode(escaped))


def url_domain(url: Column | str) -> Column:
    """Host of a valid absolute URL: lower case, user part, port and trailing dots removed; NULL without a host."""
    authority = F.regexp_extract(F.trim(col(url)), r"^[A-Za-z][A-Za-z0-9+.\-]*:/+([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    is_file = F.lower(F.trim(col(url))).startswith("file:")
    valid = ~is_file & ~host.rlike(r"[\s<>^|%]")
    return F.when(valid, blank_to_null(F.regexp_replace(F.lower(host), r"\.+$", "")))


def url_from_key(key: Column | str) -> Column:
    """The last http(s) address inside a cache key; the key itself when it has none."""
    found = F.regexp_extract(col(key), r"^[\s\S]*(https?://[\s\S]*)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(col(key))


def base64_decoded_size(encoded_length: Column, tail: Column) -> Column:
    """Decoded size from the encoded length and the padding in the last two characters."""
    padding = F.length(F.regexp_extract(tail, r"(=*)$", 1))
    size = F.call_function("div", encoded_length, F.lit(4)) * 3 - padding
    return F.greatest(size, F.lit(0))


def response_headers(raw: Column | str) -> Column:
    """Header text to (status, map): lines are split at the first colon, keys in lower case, the last one wins."""
    lines = F.filter(F.transform(F.split(col(raw), r"\r?\n|\u0000"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    pairs = F.transform(
        F.filter(F.slice(lines, 2, 100000), lambda x: x.contains(":")),
        lambda x: F.struct(
            F.lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1))).alias("k"),
            F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v"),
        ),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v")))
    return F.struct(
        blank_to_null(F.trim(F.regexp_extract(first, r"^\S+ (.*)$", 1))).alias("status"),
        F.map_from_entries(last).alias("headers"),
    )


# Content types whose body is kept, and types by file extension.
DISPLAYABLE_PREFIXES = (
    "image/", "text/", "application/json", "application/javascript",
    "application/x-javascript", "application/xml", "application/xhtml",
)
TYPE_BY_EXTENSION = [
    (r"\.js$", "application/javascript"), (r"\.css$", "text/css"), (r"\.json$", "application/json"),
    (r"\.html?$", "text/html"), (r"\.svg$", "image/svg+xml"),
]


def is_displayable(content_type: Column | str) -> Column:
    ct = F.trim(text(content_type))
    return any_of([ct.startswith(p) for p in DISPLAYABLE_PREFIXES])


def content_type_of(mime: Column | str, url: Column | str) -> Column:
    """Recorded type, else a type from the extension."""
    path = F.lower(F.regexp_extract(col(url), r"^([^?#]*)", 1))
    guess = F.when(F.lit(False), F.lit(""))
    for pattern, name in TYPE_BY_EXTENSION:
        guess = guess.when(path.rlike(pattern), name)
    return F.coalesce(blank_to_null(mime), guess)
