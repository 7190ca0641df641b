"""IP address checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted address syntax.
IPV4 = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}"
IPV6_GROUP = r"(?:0*(?:[0-9a-fA-F]{1,4}|10000))?"


def is_ipv4(address: Column) -> Column:
    """Four decimal groups of at most 255; leading zeros are allowed."""
    return address.rlike(rf"\A{IPV4}\z")


def is_ipv6(address: Column) -> Column:
    """At most eight groups, or six before an IPv4 tail.

    A group is blank or a hex number of at most 65536. At most one group may be blank, or the
    first two.
    """
    shape = address.rlike(rf"\A(?:{IPV6_GROUP}:){{1,7}}{IPV6_GROUP}\z") | address.rlike(
        rf"\A(?:{IPV6_GROUP}:){{1,6}}{IPV4}\z"
    )
    groups = F.split(address, ":")
    blanks = F.size(groups) - F.size(F.array_remove(groups, ""))
    leading = address.startswith("::") | (address == ":")
    return shape & ((blanks < 2) | ((blanks == 2) & leading))


def is_ip(address: Column) -> Column:
    """True for an IPv4 or IPv6 address; false for null."""
    return F.coalesce(is_ipv4(address) | is_ipv6(address), F.lit(False))
