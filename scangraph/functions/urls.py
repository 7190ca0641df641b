"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Percent codes that are written back as plain characters, or the reverse.
_PLAIN = (("%3A", ":"), ("%2F", "/"), ("%3F", "?"), ("%3D", "="), ("%26", "&"), ("%7E", "~"))


def sanitize_url(url: Column) -> Column:
    """Percent-encode all but unreserved characters and ``:/?=&``; null becomes empty.

    The form encoding of the JVM is adjusted: it writes blanks as ``+`` and keeps ``*``.
    A literal ``%`` is always encoded as ``%25``, so the replacements cannot meet user text.
    """
    encoded = F.url_encode(F.coalesce(url, F.lit("")))
    encoded = F.replace(encoded, F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    for code, char in _PLAIN:
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded


def url_host(url: Column) -> Column:
    """Host part of a URL, with or without scheme; empty for relative paths.

    Ideographic full stops separate labels as ``.`` does.
    """
    rest = F.regexp_replace(url, r"\A(?:[A-Za-z0-9+.\-]+:)?//", "")
    authority = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    host_port = F.substring_index(authority, "@", -1)
    host = F.trim(F.substring_index(host_port, ":", 1))
    return F.translate(F.rtrim(host, F.lit(".")), "。．｡", "...")
