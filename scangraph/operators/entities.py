"""Vertex sets: certificates, domains and addresses, keyed by a prefixed natural key (``guid``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scangraph.functions.addresses import is_ip
from scangraph.functions.names import is_domain_or_wildcard, strip_root_dot
from scangraph.functions.suffixes import SuffixRules, ancestor, union_all, with_chain_length, with_location_host

CERT_ATTRIBUTES = ["subject", "issuer", "notBefore", "notAfter", "basicConstraints", "isCa", "numAltNames"]


def cert_key(sha256: Column) -> Column:
    return F.concat(F.lit("c_"), sha256)


def domain_key(name: Column) -> Column:
    return F.concat(F.lit("d_"), name)


def ip_key(address: Column) -> Column:
    return F.concat(F.lit("ip_"), address)


def clean_hosts(hosts: DataFrame) -> DataFrame:
    return hosts.withColumn("server_name", strip_root_dot(F.col("server_name")))


def clean_dns(dns: DataFrame) -> DataFrame:
    return dns.withColumn("domain", strip_root_dot(F.col("domain")))


def clean_certs(certs: DataFrame) -> DataFrame:
    """Certificates with a well-formed digest, keyed."""
    return certs.where(F.length("sha256") == 64).withColumn("guid", cert_key(F.col("sha256")))


def san_list(names: Column) -> Column:
    """JSON list of alternative names as an array; null for JSON null, other values and bad JSON."""
    return F.from_json(names, "array<string>")


def san_entries(certs: DataFrame) -> DataFrame:
    """One row per alternative name, routed to ``domain_name`` or ``ip``."""
    name = F.col("alt_name")
    return (
        certs.select("guid", F.explode(san_list(F.col("altNames"))).alias("alt_name"))
        .withColumn("is_ip", is_ip(name))
        .select("guid", F.when(~F.col("is_ip"), name).alias("domain_name"), F.when(F.col("is_ip"), name).alias("ip"))
    )


def raw_domain_names(
    sans: DataFrame, hosts: DataFrame, dns: DataFrame, http: DataFrame, rules: SuffixRules
) -> DataFrame:
    """Every name seen in a scan, once."""
    # Few URLs stand in many rows; each is parsed and looked up once.
    targets = with_location_host(http.select("location").distinct(), "location", rules, "target")
    names = union_all(
        [
            sans.select("domain_name"),
            hosts.select("server_name"),
            dns.select("domain"),
            targets.select("target"),
        ]
    )
    return names.where(F.col("domain_name").isNotNull()).distinct()


def domain_hierarchy(names: DataFrame, rules: SuffixRules) -> DataFrame:
    """All names and their parents as distinct ``domain_name``, ``parent``.

    One pass gives both the domain vertices and the parent edges. Parents are generated row by row;
    no chain is held as a whole.
    """
    sized = with_chain_length(names, "domain_name", rules).where(F.col("_length") > 0)
    steps = F.explode(F.sequence(F.lit(0), F.col("_length") - 1)).alias("step")
    rows = sized.select("_name", "_length", steps).select(
        ancestor(F.col("_name"), F.col("step")).alias("domain_name"),
        F.when(F.col("step") < F.col("_length") - 1, ancestor(F.col("_name"), F.col("step") + 1)).alias("parent"),
    )
    parent = F.when(is_domain_or_wildcard(F.col("domain_name")), F.col("parent"))
    return rows.select("domain_name", parent.alias("parent")).distinct()


def addresses(sans: DataFrame, hosts: DataFrame, dns: DataFrame) -> DataFrame:
    """Valid addresses of all sources, once."""
    every = union_all([hosts.select("ip"), dns.select("ip"), sans.select("ip")]).distinct()
    return every.where(is_ip(F.col("ip"))).withColumn("guid", ip_key(F.col("ip")))


def certificates(certs: DataFrame) -> DataFrame:
    """One row per certificate with the largest value of every attribute."""
    return certs.groupBy("guid", "sha1", "sha256").agg(*[F.max(c).alias(c) for c in CERT_ATTRIBUTES])
