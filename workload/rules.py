"""Public-suffix rules of the workload; the library itself has none."""

from __future__ import annotations

from pyspark.sql import SparkSession

from scangraph.functions.suffixes import SuffixRules

# An excerpt of the public suffix list for the test tables.
RULES = (
    "ac", "at", "au", "com.au", "net.au", "org.au", "be", "biz", "br", "com.br", "ca", "cc", "ch",
    "cn", "com.cn", "*.ck", "!www.ck", "co", "com", "cz", "de", "dev", "dk", "edu", "es", "eu", "fi",
    "fr", "gov", "hu", "ie", "in", "co.in", "info", "int", "io", "it", "jp", "ac.jp", "co.jp",
    "ne.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "me", "mil", "mx", "com.mx", "net", "nl", "no",
    "nz", "co.nz", "org", "pl", "com.pl", "pt", "ro", "ru", "se", "sk", "tv", "uk", "ac.uk", "co.uk",
    "gov.uk", "org.uk", "us", "xyz", "za", "co.za",
)
PRIVATE_RULES = ("blogspot.com", "cloudfront.net", "github.io", "herokuapp.com", "s3.amazonaws.com")


def suffix_rules(spark: SparkSession) -> SuffixRules:
    return SuffixRules.of(spark, RULES, PRIVATE_RULES)
