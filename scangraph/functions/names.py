"""Domain name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted syntax of a domain name in its ASCII form.
DOMAIN = (
    r"\A(?:[a-zA-Z0-9](?:[a-zA-Z0-9_-]{0,61}[A-Za-z0-9])?\.)++"
    r"[A-Za-z0-9][A-Za-z0-9_-]{0,61}[A-Za-z]\z"
)


def ascii_name(name: Column) -> Column:
    """IDNA form of a name; null when it has none.

    The JVM's converter is called only for names with non-ASCII characters, so nothing crosses to
    a Python worker.
    """
    converted = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name, F.lit(1))
    return F.when(name.rlike(r"\A\p{ASCII}*\z"), name).otherwise(converted)


def is_domain(name: Column) -> Column:
    """Syntax check of a domain name; false for null and for names without IDNA form."""
    return F.coalesce(ascii_name(name).rlike(DOMAIN), F.lit(False))


def is_domain_or_wildcard(name: Column) -> Column:
    """Like ``is_domain``, with any ``*.`` left out of the check."""
    stripped = F.replace(name, F.lit("*."), F.lit(""))
    return is_domain(name) | (name.contains("*.") & is_domain(stripped))


def strip_root_dot(name: Column) -> Column:
    """Name without one trailing dot."""
    return F.regexp_replace(name, r"\.\z", "")
