"""One query per operator, over the scan tables of ``views``.

Arrays are joined to text and scores rounded, so that results can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scangraph.functions.addresses import is_ip, is_ipv4, is_ipv6
from scangraph.functions.suffixes import (
    parent_domain,
    union_all,
    with_domain_chain,
    with_location_host,
)
from scangraph.functions.urls import sanitize_url
from scangraph.operators import entities, relations
from scangraph.operators.degrees import degrees, kind_masks, mask_degrees, mirror, undirected_degrees, vertex_union
from scangraph.operators.ids import dense_ids
from scangraph.operators.propagation import (
    affected_counts,
    anomalies,
    neighbour_degrees,
    propagate,
    score_histogram,
    scores_by_kind,
    seed_vertices,
)
from scangraph.plans.build import RELATION_COLUMNS, build_graph, domain_names, observed_edges, vertex_keys
from scangraph.plans.rank import run_experiment
from scangraph.sources import blocklists
from scangraph.sources.blocklists import Blocklist
from scangraph.sources.certificates import pem_to_der, with_fingerprints
from scangraph.sources.experiment import Experiment, read_scores
from scangraph.sources.graph_files import Graph, read_graph, read_graph_csv, write_graph, write_graph_csv
from scangraph.sources.resolver import flatten_answers
from scangraph.sources.scans import HOSTS_COLUMNS, HOSTS_SCHEMA, load_csv
from scangraph.storage import Workspace, list_names
from workload import views
from workload.rules import suffix_rules

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, Query] = {}


def query(function: Query) -> Query:
    ALL[function.__name__] = function
    return function


def _listed(column: str) -> Column:
    return F.concat_ws(";", F.col(column).cast("array<string>")).alias(column)


def _flat(df: DataFrame) -> DataFrame:
    arrays = {name for name, kind in df.dtypes if kind.startswith("array")}
    return df.select(*[_listed(c) if c in arrays else F.col(c) for c in df.columns])


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = suffix_rules(spark)
    return entities.domain_hierarchy(domain_names(views.scans(spark, sf_dir), rules), rules)


_graphs: dict[tuple[str, str], Graph] = {}
_scores: dict[tuple[str, ...], DataFrame] = {}
_reports: dict[tuple[str, ...], list[tuple[str, int, int]]] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a scale, built once per session and read from its tables afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        work = Workspace.fresh(spark)
        _graphs[key] = build_graph(spark, views.stored_scans(spark, sf_dir, work), suffix_rules(spark), url_lists=True)
        work.close()
    return _graphs[key]


def _natural_keys(g: Graph) -> DataFrame:
    """``id, name`` over all vertex kinds."""
    return union_all(
        [
            g["cert"].select("id", entities.cert_key(F.col("sha256")).alias("name")),
            g["domain"].select("id", entities.domain_key(F.col("domain_name")).alias("name")),
            g["ip"].select("id", entities.ip_key(F.col("ip")).alias("name")),
        ]
    )


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    kinds = {"ip": "ip", "domain_name": "domain", "sha1": "cert"}
    return union_all(
        [
            seed_vertices(blocked, g[kinds[column]], column).select(F.lit(column).alias("experiment"), "id")
            for column, blocked in views.blocklists(spark, sf_dir).items()
        ]
    )


# Parameters of the propagations that queries share.
_RUNS = {
    "3 rounds": {"epsilon": 0.0, "max_iter": 3},
    "3 rounds, both ways": {"epsilon": 0.0, "max_iter": 3, "bidirectional": True},
    "3 rounds, distinct neighbours": {"epsilon": 0.0, "max_iter": 3, "degree": "distinct"},
    "converged": {"epsilon": 0.01, "max_iter": 100},
    "converged, by changes": {"epsilon": 0.01, "max_iter": 100, "only_changes": True},
}


def _relations(spark: SparkSession, sf_dir: str, bidirectional: bool = False) -> DataFrame:
    found = graph(spark, sf_dir).relations
    left_out = ("deployed_on", "parent_domain") if bidirectional else ()
    return relations.typed_union({n: df for n, df in found.items() if n not in left_out})


def _propagated(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, run)
    if key not in _scores:
        edges = _relations(spark, sf_dir, "bidirectional" in _RUNS[run])
        vertices = vertex_union(graph(spark, sf_dir).vertices)
        report = _reports[key] = []
        _scores[key] = propagate(spark, vertices, edges, _seeds(spark, sf_dir), **_RUNS[run], report=report)
    return _scores[key]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 8) + F.lit(0.0))  # no negative zero


# Scalar functions


@query
def ip_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address checks over every address and every name of the scans."""
    s = views.scans(spark, sf_dir)
    sans = entities.san_entries(entities.clean_certs(s.certs))
    texts = union_all([s.hosts.select("ip"), s.dns.select("ip"), s.dns.select("domain"), sans.select("ip")])
    text = F.col("ip")
    return texts.distinct().select(
        text.alias("value"), is_ipv4(text).alias("v4"), is_ipv6(text).alias("v6"), is_ip(text).alias("valid")
    )


@query
def sanitized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.page_hosts(spark, sf_dir).select("page_id", sanitize_url(F.col("url")).alias("url"))


@query
def sanitized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same encoding over texts with all kinds of characters."""
    return views.table(spark, sf_dir, "documents").select("doc_id", sanitize_url(F.col("text")).alias("url"))


@query
def location_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    http = views.scan_http(spark, sf_dir)
    return with_location_host(http, "location", suffix_rules(spark), "target").select("id", "location", "target")


@query
def domain_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = views.page_hosts(spark, sf_dir).select("page_id", "host")
    chains = with_domain_chain(hosts, "host", suffix_rules(spark))
    return _flat(chains.select("page_id", "host", "chain", parent_domain(F.col("chain")).alias("parent")))


@query
def cert_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pem = views.pem_documents(spark, sf_dir)
    return with_fingerprints(pem.select("id", pem_to_der(F.col("cert")).alias("der"))).select("id", "sha1", "sha256")


@query
def alias_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_answers(views.resolver_lines(spark, sf_dir))


@query
def parsed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanner CSV with quotes, line breaks and malformed rows, written from all events and documents and read again."""
    path = Workspace.fresh(spark).path("hosts.csv")
    views.write_hosts_csv(spark, sf_dir, path)
    hosts = load_csv(spark, path, HOSTS_SCHEMA, HOSTS_COLUMNS)
    return hosts.withColumn("error_data", F.sha2("error_data", 256))


# Entities


@query
def san_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.san_entries(entities.clean_certs(views.scan_certs(spark, sf_dir)))


@query
def domain_names_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_names(views.scans(spark, sf_dir), suffix_rules(spark))


@query
def domain_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hierarchy(spark, sf_dir)


@query
def ip_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scans(spark, sf_dir)
    return entities.addresses(entities.san_entries(entities.clean_certs(s.certs)), s.hosts, s.dns)


@query
def cert_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.certificates(entities.clean_certs(views.scan_certs(spark, sf_dir)))


@query
def dense_vertex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = vertex_keys(views.scans(spark, sf_dir), _hierarchy(spark, sf_dir))
    return dense_ids(keys, "guid", Workspace.fresh(spark))


@query
def dense_customer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = views.table(spark, sf_dir, "customer").select("c_name")
    return dense_ids(keys, "c_name", Workspace.fresh(spark))


# Relations between natural keys


def _observed(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hierarchy = _hierarchy(spark, sf_dir) if name == "parent_domain" else None
        found = observed_edges(views.scans(spark, sf_dir), hierarchy, suffix_rules(spark), name, ("locations",))
        return _flat(found)

    return run


for _name in ("returns", "deployed_on", "resolves", "contains", "redirects", "parent_domain"):
    ALL[f"{_name}_edges"] = _observed(_name)


@query
def subdomain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.swap_ends(_observed("parent_domain")(spark, sf_dir))


def _named_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = entities.clean_hosts(views.scan_hosts(spark, sf_dir))
    return hosts.select(
        entities.ip_key(F.col("ip")).alias("from"),
        entities.cert_key(F.col("cert_hash")).alias("to"),
        F.col("server_name").alias("sni"),
        "scan_date",
    )


@query
def returns_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that also collect the server names they were seen with."""
    return _flat(relations.merge_observations(_named_returns(spark, sf_dir), ("server_name_indicators",)))


@query
def return_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The server names of every edge, as rows."""
    return relations.edge_values(_named_returns(spark, sf_dir), "sni")


@query
def redirect_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs of every edge, as rows."""
    hosts = entities.clean_hosts(views.scan_hosts(spark, sf_dir))
    edges = relations.redirects(views.scan_http(spark, sf_dir), hosts, suffix_rules(spark))
    return relations.edge_values(edges, "location")


# The graph


@query
def graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations with numeric ids and merged attributes."""
    wide = [
        df.select(
            F.lit(name).alias("type"),
            "src",
            "dst",
            *[
                (F.concat_ws(";", F.col(c).cast("array<string>")) if c in df.columns else F.lit("")).alias(c)
                for c in ("scan_dates", "scan_src", "locations")
            ],
            (F.col("valid") if "valid" in df.columns else F.lit(None).cast("boolean")).alias("valid"),
        )
        for name, df in graph(spark, sf_dir).relations.items()
    ]
    return union_all(wide)


@query
def graph_certs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)["cert"]


@query
def graph_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)["domain"]


@query
def graph_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)["ip"]


@query
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(_relations(spark, sf_dir))


@query
def graph_undirected_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return undirected_degrees(_relations(spark, sf_dir))


# Sets of relations whose degrees are asked for together.
_DEGREE_SETS = {
    "all": list(RELATION_COLUMNS),
    "names": ["contains", "redirects", "parent_domain", "subdomain"],
    "hosting": ["returns", "deployed_on", "resolves"],
    "resolves": ["resolves"],
}


@query
def distinct_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and neighbours of every vertex, for several sets of relations at once."""
    kinds = list(RELATION_COLUMNS)
    return mask_degrees(kind_masks(_relations(spark, sf_dir), kinds), kinds, _DEGREE_SETS)


@query
def graph_vertex_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertex_union(graph(spark, sf_dir).vertices)


@query
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir)


@query
def reverse_valid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(relations.reverse_valid(graph(spark, sf_dir)["resolves"]))


@query
def mirrored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror(_relations(spark, sf_dir, bidirectional=True))


@query
def mirrored_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = vertex_union(graph(spark, sf_dir).vertices)
    return neighbour_degrees(vertices, mirror(_relations(spark, sf_dir, bidirectional=True)))


@query
def trade_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of the graph in which every line item leads from its part to its supplier."""
    items = views.table(spark, sf_dir, "lineitem")
    part, supplier = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    return degrees(items.select(part.alias("src"), supplier.alias("dst")))


# Propagation


@query
def blocklist_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeds(spark, sf_dir)


@query
def listed_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List files written from all events, read back and matched with the graph together."""
    work = Workspace.fresh(spark)
    folder = work.path("blocklists")
    views.write_lists(spark, sf_dir, folder)
    lists = [Blocklist(f"{folder}/{name}") for name in list_names(spark, folder)]
    return blocklists.listed_vertices(spark, lists, graph(spark, sf_dir).vertices)


@query
def scores_3_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds for all blocklists, by natural key."""
    scores = _propagated(spark, sf_dir, "3 rounds")
    named = scores.join(_natural_keys(graph(spark, sf_dir)), "id")
    return _rounded(named.select("experiment", "name", "score", "fixed"))


@query
def score_histogram_3_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_histogram(_rounded(_propagated(spark, sf_dir, "3 rounds"))).withColumnRenamed("count", "vertices")


@query
def score_anomalies_3_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(anomalies(_propagated(spark, sf_dir, "3 rounds")))


@query
def score_anomalies_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores above 1 where stored degrees are too small, as in a graph whose tables don't belong together."""
    vertices = vertex_union(graph(spark, sf_dir).vertices).select("id", F.lit(1).cast("long").alias("outDegree"))
    scores = propagate(spark, vertices, _relations(spark, sf_dir), _seeds(spark, sf_dir), **_RUNS["3 rounds"])
    return _rounded(anomalies(scores))


@query
def affected_3_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affected_counts(_propagated(spark, sf_dir, "3 rounds"))


@query
def ip_scores_3_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _propagated(spark, sf_dir, "3 rounds")
    return _rounded(scores_by_kind(graph(spark, sf_dir)["ip"], scores))


@query
def scores_3_rounds_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_propagated(spark, sf_dir, "3 rounds, both ways"))


@query
def scores_3_rounds_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_propagated(spark, sf_dir, "3 rounds, distinct neighbours"))


@query
def scores_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _propagated(spark, sf_dir, "converged")
    named = scores.join(_natural_keys(graph(spark, sf_dir)), "id")
    return _rounded(named.select("experiment", "name", "score", "fixed"))


@query
def scores_by_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The converging run in which a round sends only what has changed."""
    scores = _propagated(spark, sf_dir, "converged, by changes")
    named = scores.join(_natural_keys(graph(spark, sf_dir)), "id")
    return _rounded(named.select("experiment", "name", "score", "fixed"))


class _StoppedError(Exception):
    pass


@query
def scores_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The converging run, stopped behind its second round and begun again in the same folder."""
    inputs = vertex_union(graph(spark, sf_dir).vertices), _relations(spark, sf_dir), _seeds(spark, sf_dir)
    work = Workspace(spark, Workspace.fresh(spark).root, resume=True)

    def stop(step: int) -> None:
        if step == 2:
            raise _StoppedError

    with suppress(_StoppedError):
        propagate(spark, *inputs, **_RUNS["converged"], work=work, on_round=stop)
    scores = propagate(spark, *inputs, **_RUNS["converged"], work=work)
    named = scores.join(_natural_keys(graph(spark, sf_dir)), "id")
    return _rounded(named.select("experiment", "name", "score", "fixed"))


@query
def stored_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of a graph that replaced another one on disk."""
    whole, folder = graph(spark, sf_dir), Workspace.fresh(spark).path("graph")
    part = Graph(whole.vertices, {**whole.relations, "returns": whole["returns"].where("valid")})
    for written in (part, whole):
        write_graph(written, folder)
    return relations.typed_union(read_graph(spark, folder).relations)


@query
def graph_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose scan sources are free text, with the separator and the escape sign in it, through graph CSV."""
    odd = views.odd_sources(graph(spark, sf_dir)["resolves"])
    path = Workspace.fresh(spark).path("resolves.relation")
    write_graph_csv(odd, path)
    found = read_graph_csv(spark, path)
    rows = found.select("src", "dst", "valid", F.posexplode_outer("scan_src").alias("place", "scan_src"))
    return rows


@query
def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of lists that changed between two runs, written as CSV and read back."""
    work = Workspace.fresh(spark)
    write_graph(graph(spark, sf_dir), work.path("tls_graph"), made_from="the workload's scans")
    files = {"ip": "ip.ip", "domain_name": "domain_name.dn", "sha1": "sha1.sha1"}
    lists = views.blocklists(spark, sf_dir)
    # The second run finds one list as it was, one that has grown and one that is new.
    first = {"sha1": lists["sha1"], "ip": lists["ip"].where(F.hash("ip") % 2 == 0)}
    for written in (first, {"ip": lists["ip"], "domain_name": lists["domain_name"]}):
        for column, listed in written.items():
            listed.write.mode("overwrite").text(work.path(f"blocklists/{files[column]}"))
        experiment = Experiment.from_dir(spark, work.root)
        run_experiment(spark, experiment, work.path("out"), **_RUNS["converged"], output_type="csv")
    keys = {"ip": ("ip", entities.ip_key), "domain": ("domain_name", entities.domain_key), "cert": ("sha256", entities.cert_key)}
    rows = []
    for name, kinds in read_scores(spark, work.path("out")).items():
        column = name.rpartition("_")[0]
        for kind, df in kinds.items():
            value, key = keys[kind]
            rows.append(df.select(F.lit(column).alias("experiment"), key(F.col(value)).alias("name"), "score", "fixed"))
    return _rounded(union_all(rows))


@query
def rounds_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vertices of each blocklist moved in each round until it converged."""
    _propagated(spark, sf_dir, "converged")
    rows = _reports[(spark.sparkContext.applicationId, sf_dir, "converged")]
    return spark.createDataFrame(rows, "experiment string, round int, changed long")
