"""Scalar functions on names, paths, HTTP texts and retries, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def url_safe(text: Column) -> Column:
    """Per-byte %XX of all but letters, digits and ``-_.``"""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("~"), F.lit("%7E"))


def url_safe_decode(text: Column) -> Column:
    """Inverse of ``url_safe``; ``+`` stays."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def query_decode(text: Column) -> Column:
    """%XX and ``+`` of a query string."""
    return F.url_decode(text)


def object_name(text: Column) -> Column:
    """Object names in a request path: ``% / space ? & =`` in this order."""
    pairs = (("%", "%25"), ("/", "%2F"), (" ", "%20"), ("?", "%3F"), ("&", "%26"), ("=", "%3D"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def bucket(text: Column, n: int = 1000) -> Column:
    """One of ``n`` buckets, by MD5 so that any engine agrees."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(n))


def path_component(file_id: Column, page_index: Column) -> Column:
    """``bucket/name/page`` of a stored page."""
    return F.format_string("%03d/%s/%d", bucket(file_id), url_safe(file_id), page_index)


def page_key(file_id: Column, page_index: Column) -> Column:
    """Display of a page's key."""
    return F.concat(file_id, F.lit(":page"), page_index.cast("string"))


def retry_delay(attempt: Column, base_ms: int = 100, most_ms: int = 5000) -> Column:
    """Milliseconds before an attempt: doubling from ``base_ms``, at most ``most_ms``."""
    return F.least(F.lit(base_ms) * F.pow(F.lit(2), F.least(attempt, F.lit(12))).cast("long"), F.lit(most_ms))


def status_class(status: Column) -> Column:
    """``ok``, ``transient`` (worth a retry) or ``permanent``."""
    return F.when(status < 400, "ok").when(status.isin(429, 500, 502, 503, 504), "transient").otherwise("permanent")


def status_code(line: Column) -> Column:
    """Code of a status line; null if there's none."""
    return F.regexp_extract(line, r"^\S+\s+(\d{1,5})(?:\s|$)", 1).try_cast("int")


def content_length(headers: Column) -> Column:
    """Value of the Content-Length header; null if there's none."""
    return F.regexp_extract(headers, r"(?m)^[Cc]ontent-[Ll]ength: *(\d+)", 1).try_cast("long")


def header_end(text: Column) -> Column:
    """Place of the first empty line, from 0; -1 if there's none."""
    return F.instr(text, "\r\n\r\n") - 1


def request_path(line: Column) -> Column:
    """Path of a request line, without its query."""
    return F.regexp_extract(line, r"^\S+ ([^ ?]*)", 1)


def query_value(line: Column, name: str) -> Column:
    """First value of a parameter in a request line, decoded; null if absent."""
    found = F.regexp_extract(line, rf"^\S+ [^ ?]*\?(?:[^ ]*?&)??{name}=([^& ]*)", 1)
    return F.when(line.rlike(rf"^\S+ [^ ?]*\?(?:[^ ]*&)?{name}="), F.url_decode(found))


def truncated(text: Column, most: int = 200) -> Column:
    """At most ``most`` characters."""
    return F.left(text, F.lit(most))


def hex_literal(data: Column) -> Column:
    """``0x...`` of bytes."""
    return F.concat(F.lit("0x"), F.lower(F.hex(data)))


def is_stale(cached_at: Column, now: Column, ttl_seconds: int = 300) -> Column:
    """Whether an entry is older than its time to live."""
    return F.unix_micros(now) - F.unix_micros(cached_at) > ttl_seconds * 1_000_000
