"""From scan tables to a graph of typed vertices and relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scangraph.functions.suffixes import SuffixRules, union_all
from scangraph.operators import entities, relations
from scangraph.operators.degrees import degrees, with_degrees
from scangraph.operators.ids import dense_ids
from scangraph.sources.graph_files import Graph
from scangraph.storage import Workspace

RELATION_COLUMNS = {
    "returns": ["scan_dates", "valid"],
    "deployed_on": ["scan_dates", "valid"],
    "resolves": ["scan_dates", "valid", "scan_src"],
    "contains": [],
    "redirects": ["scan_dates", "valid"],
    "parent_domain": [],
    "subdomain": [],
}

_EDGE_SCHEMA = {
    "scan_dates": "array<date>",
    "valid": "boolean",
    "scan_src": "array<string>",
    "locations": "array<string>",
}


@dataclass(frozen=True)
class Scans:
    """Scan tables of all dates.

    ``hosts``: id, ip, server_name, error_data, cert_hash, cert_valid, scan_date[, source];
    ``http``: id, location, scan_date[, source]; ``certs``: sha1, sha256, altNames and the vertex
    attributes; ``dns``: ip, domain, scan_src, scan_date.
    """

    hosts: DataFrame
    http: DataFrame
    certs: DataFrame
    dns: DataFrame


def raw_edges(scans: Scans, hierarchy: DataFrame | None, rules: SuffixRules, name: str) -> DataFrame:
    """All observations of one relation between natural keys.

    ``hierarchy`` is needed for ``parent_domain`` only; ``subdomain`` is left to its mirror.
    """
    if name == "parent_domain":
        return relations.parent_domains(hierarchy)
    if name == "contains":
        return relations.contains(entities.san_entries(entities.clean_certs(scans.certs)))
    hosts = entities.clean_hosts(scans.hosts)
    if name == "resolves":
        return relations.resolves(entities.clean_dns(scans.dns), hosts)
    if name == "redirects":
        return relations.redirects(scans.http, hosts, rules)
    return {"returns": relations.returns, "deployed_on": relations.deployed_on}[name](hosts)


def observed_edges(
    scans: Scans, hierarchy: DataFrame | None, rules: SuffixRules, name: str, lists: tuple[str, ...] = ()
) -> DataFrame:
    """Merged edges of one relation; ``lists`` as in ``merge_observations``."""
    return relations.merge_observations(raw_edges(scans, hierarchy, rules, name), lists)


def domain_names(scans: Scans, rules: SuffixRules) -> DataFrame:
    """Distinct names of all scans before their parents are added."""
    return entities.raw_domain_names(
        entities.san_entries(entities.clean_certs(scans.certs)),
        entities.clean_hosts(scans.hosts),
        entities.clean_dns(scans.dns),
        scans.http,
        rules,
    )


def vertex_keys(scans: Scans, hierarchy: DataFrame) -> DataFrame:
    """Distinct keys of all vertices. The prefixes keep the three kinds apart."""
    certs = entities.clean_certs(scans.certs)
    ips = entities.addresses(entities.san_entries(certs), scans.hosts, scans.dns)
    return union_all(
        [
            certs.select("guid").distinct(),
            hierarchy.select(entities.domain_key(F.col("domain_name")).alias("guid")),
            ips.select("guid"),
        ]
    )


def _wide(name: str, df: DataFrame) -> DataFrame:
    columns = [
        (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _EDGE_SCHEMA.items()
    ]
    return df.select("from", "to", F.lit(name).alias("type"), *columns)


def _with_subdomains(edges: DataFrame) -> DataFrame:
    """Add the reverse of every ``parent_domain`` edge as ``subdomain`` without a second join."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "type")]
    forward = F.struct("src", "dst", "type")
    backward = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("subdomain").alias("type"))
    both = F.when(F.col("type") == "parent_domain", F.array(forward, backward)).otherwise(F.array(forward))
    return edges.select(F.explode(both).alias("end"), *rest).select("end.*", *rest)


def build_graph(
    spark: SparkSession,
    scans: Scans,
    rules: SuffixRules,
    work: Workspace | None = None,
    url_lists: bool = False,
) -> Graph:
    """Build all vertices and relations; intermediate tables go to ``work``.

    ``rules`` should be the whole public suffix list: redirects to a host below an unlisted suffix are
    no edges. The URLs of every redirect are rows of ``details["redirects"]``; with ``url_lists`` its
    edge also has them as a list, which grows with the number of URLs.

    Edges of all relations are merged on their natural keys first and then share one id lookup for
    each end. Degrees are joined to the id table once, and domain and address vertices are read off
    that table, since their key holds their only attribute.
    """
    work = work or Workspace.fresh(spark)

    names = work.write(domain_names(scans, rules), "names")
    hierarchy = work.write(entities.domain_hierarchy(names, rules), "hierarchy")
    ids = dense_ids(vertex_keys(scans, hierarchy), "guid", work)

    redirects = work.write(raw_edges(scans, hierarchy, rules, "redirects"), "redirects")
    observed = {n: observed_edges(scans, hierarchy, rules, n) for n in RELATION_COLUMNS if n not in ("redirects", "subdomain")}
    listed = ("locations",) if url_lists else ()
    observed["redirects"] = relations.merge_observations(redirects, listed)
    edges = relations.attach_ids(union_all([_wide(n, df) for n, df in observed.items()]), ids)
    stored = work.write(_with_subdomains(edges), "relations", partition_by="type")

    kind = F.substring_index("guid", "_", 1).alias("kind")
    index = work.write(
        with_degrees(ids, degrees(stored.select("src", "dst"))).select("id", "guid", "inDegree", "outDegree", kind),
        "vertices",
        partition_by="kind",
    )

    def keyed(prefix: str) -> DataFrame:
        return index.where(F.col("kind") == prefix).drop("kind")

    certs = entities.certificates(entities.clean_certs(scans.certs)).join(keyed("c"), "guid")
    certs = certs.select("id", "sha1", "sha256", *entities.CERT_ATTRIBUTES, "inDegree", "outDegree")

    def valued(prefix: str, column: str) -> DataFrame:
        value = F.expr(f"substring(guid, {len(prefix) + 2})")
        return keyed(prefix).select("id", value.alias(column), "inDegree", "outDegree")

    urls = relations.edge_values(redirects, "location")
    details = {"redirects": work.write(relations.attach_ids(urls, ids), "locations")}
    cert_vertices = work.write(certs, "certs")
    if not work.resume:
        for name in ("names", "hierarchy", "keys", "keys_unordered", "redirects"):
            work.delete(name)
    return Graph(
        vertices={"cert": cert_vertices, "domain": valued("d", "domain_name"), "ip": valued("ip", "ip")},
        relations={
            name: stored.where(F.col("type") == name).select("src", "dst", *columns)
            for name, columns in {**RELATION_COLUMNS, "redirects": ["scan_dates", "valid", *listed]}.items()
        },
        details=details,
    )
