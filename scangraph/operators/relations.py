"""Edges between vertex keys: one builder per relation, and the merge of repeated observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangraph.functions.suffixes import SuffixRules, union_all, with_location_host
from scangraph.functions.urls import sanitize_url
from scangraph.operators.entities import cert_key, domain_key, ip_key

# Fixed value: the handshake error of a server that could not prove possession of its key.
NO_POSSESSION = "invalid signature by the server certificate"

# Attributes of a merged edge and the observation columns they come from.
_SETS = {
    "scan_dates": "scan_date",
    "server_name_indicators": "sni",
    "locations": "location",
    "scan_src": "scan_src",
}
_UNBOUNDED = ("server_name_indicators", "locations")


def returns(hosts: DataFrame) -> DataFrame:
    """Address to the certificate it sent."""
    return hosts.select(
        ip_key(F.col("ip")).alias("from"),
        cert_key(F.col("cert_hash")).alias("to"),
        (F.col("cert_valid") == 1).alias("valid"),
        "scan_date",
    )


def deployed_on(hosts: DataFrame) -> DataFrame:
    """Certificate to an address that proved possession of its key."""
    proven = F.col("error_data").isNull() | ~F.col("error_data").contains(NO_POSSESSION)
    return hosts.where(F.col("cert_hash").isNotNull() & proven).select(
        cert_key(F.col("cert_hash")).alias("from"),
        ip_key(F.col("ip")).alias("to"),
        (F.col("cert_valid") == 1).alias("valid"),
        "scan_date",
    )


def resolves(dns: DataFrame, hosts: DataFrame) -> DataFrame:
    """Domain to address, from DNS answers and from names that were probed."""
    resolved = dns.select(
        domain_key(F.col("domain")).alias("from"), ip_key(F.col("ip")).alias("to"), "scan_src", "scan_date"
    )
    probed = hosts.select(
        domain_key(F.col("server_name")).alias("from"),
        ip_key(F.col("ip")).alias("to"),
        (F.col("cert_valid") == 1).alias("valid"),
        "scan_date",
    )
    return resolved.unionByName(probed, allowMissingColumns=True)


def contains(sans: DataFrame) -> DataFrame:
    """Certificate to every domain and address it names."""
    domains = sans.select(F.col("guid").alias("from"), domain_key(F.col("domain_name")).alias("to"))
    ips = sans.select(F.col("guid").alias("from"), ip_key(F.col("ip")).alias("to"))
    return union_all([domains, ips]).where(F.col("to").isNotNull())


def redirects(http: DataFrame, hosts: DataFrame, rules: SuffixRules) -> DataFrame:
    """Domain to the domain its web server redirects to.

    Targets are resolved before the join, so only rows that can become an edge are shuffled.
    """
    # Few URLs stand in many rows; each is parsed, looked up and encoded once.
    urls = http.select("location").where(F.col("location").isNotNull()).distinct()
    known = with_location_host(urls, "location", rules, "target").where(F.col("target").isNotNull())
    targets = http.join(known.withColumn("encoded", sanitize_url(F.col("location"))), "location")
    keys = [c for c in ("scan_date", "source", "id") if c in http.columns and c in hosts.columns]
    named = hosts.where(F.col("server_name").isNotNull()).select(*keys, "server_name", "cert_valid")
    return targets.join(named, keys).select(
        domain_key(F.col("server_name")).alias("from"),
        domain_key(F.col("target")).alias("to"),
        F.col("encoded").alias("location"),
        (F.col("cert_valid") == 1).alias("valid"),
        "scan_date",
    )


def parent_domains(hierarchy: DataFrame) -> DataFrame:
    """Domain to its immediate parent."""
    return hierarchy.where(F.col("parent").isNotNull()).select(
        domain_key(F.col("domain_name")).alias("from"), domain_key(F.col("parent")).alias("to")
    )


def swap_ends(edges: DataFrame) -> DataFrame:
    """The same edges pointing the other way."""
    first, second = edges.columns[:2]
    return edges.select(F.col(second).alias(first), F.col(first).alias(second), *edges.columns[2:])


def edge_values(edges: DataFrame, column: str) -> DataFrame:
    """The distinct values of ``column`` of every edge, one per row: all URLs or server names it was seen with."""
    return edges.select("from", "to", column).dropna().distinct()


def merge_observations(edges: DataFrame, lists: tuple[str, ...] = ()) -> DataFrame:
    """One row per edge: sorted sets of dates and sources, and whether any observation was valid.

    Dates, sources and validity combine on the map side, so an edge that was seen in a third of all
    rows reaches its reducer as one row per task. Without ``scan_date`` the edges are just distinct.
    Edges with a null end would be dropped by the id lookup and are left out here.

    Dates and scan sources are as few as there were scans. URLs and server names are not bounded:
    ``edge_values`` has them as rows. ``lists`` asks for ``locations`` or ``server_name_indicators`` as
    one sorted list per edge, for graphs whose edges are known to have few; the list is then complete.
    """
    known = edges.where(F.col("from").isNotNull() & F.col("to").isNotNull())
    if "scan_date" not in edges.columns:
        return known.distinct()
    wanted = {out: c for out, c in _SETS.items() if c in edges.columns and (out not in _UNBOUNDED or out in lists)}
    keys = [c for c in edges.columns if c not in {"valid", *_SETS.values()}]
    merged = [F.sort_array(F.collect_set(c)).alias(out) for out, c in wanted.items()]
    if "valid" in edges.columns:
        merged.append(F.max("valid").alias("valid"))
    return known.groupBy(*keys).agg(*merged)


def attach_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Replace both ends by numeric ids; edges whose ends are no vertices are dropped.

    ``ids`` has one row per key, so a hub on the edge side is split by the adaptive skew join.
    """
    src = ids.select(F.col("guid").alias("from"), F.col("id").alias("src"))
    dst = ids.select(F.col("guid").alias("to"), F.col("id").alias("dst"))
    rest = [c for c in edges.columns if c not in ("from", "to")]
    return edges.join(src, "from").join(dst, "to").select("src", "dst", *rest)


def typed_union(relations: dict[str, DataFrame]) -> DataFrame:
    """All named relations as ``src``, ``dst``, ``type``."""
    return union_all([df.select("src", "dst", F.lit(name).alias("type")) for name, df in relations.items()])


def reverse_valid(edges: DataFrame) -> DataFrame:
    """Valid edges with swapped ends; dates are kept where there are any."""
    kept = [c for c in ("scan_dates",) if c in edges.columns]
    return edges.where("valid").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *kept)
