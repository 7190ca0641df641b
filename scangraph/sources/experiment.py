"""An experiment folder: a graph, blocklists and, afterwards, scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scangraph.operators.propagation import scores_by_kind
from scangraph.sources.blocklists import Blocklist, listed_vertices
from scangraph.sources.graph_files import Graph, graph_state, header_path, read_graph, read_graph_csv, write_graph_csv
from scangraph.sources.snapshots import fresh_folder, read_pointer, replace_pointer
from scangraph.storage import file_states, fingerprint, list_names, partition_folder, path_exists


@dataclass(frozen=True)
class Experiment:
    """``<location>/tls_graph`` and every list in ``<location>/blocklists``, sorted by name."""

    graph: Graph
    blocklists: list[Blocklist]
    bidirectional: bool = False
    #: Digest of what the graph was made from.
    graph_state: str = ""

    @classmethod
    def from_dir(cls, spark: SparkSession, location: str, bidirectional: bool = False) -> Experiment:
        lists = [Blocklist(f"{location}/blocklists/{n}") for n in list_names(spark, f"{location}/blocklists")]
        graph = read_graph(spark, f"{location}/tls_graph", bidirectional)
        state = graph_state(spark, f"{location}/tls_graph")
        return cls(graph, sorted(lists, key=lambda b: b.name), bidirectional, state)

    def seeds(self, spark: SparkSession, names: set[str] | None = None) -> DataFrame:
        """``experiment, id`` of every listed vertex, of the named blocklists or of all."""
        chosen = [b for b in self.blocklists if names is None or b.name in names]
        return listed_vertices(spark, chosen, self.graph.vertices)


def _states(spark: SparkSession, experiment: Experiment, run: str, output_type: str) -> dict[str, str]:
    """What the scores of each list are made from: the list's files, graph, parameters and format."""
    made_from = (run, output_type, experiment.graph_state)
    return {b.name: fingerprint(*made_from, *file_states(spark, b.location)) for b in experiment.blocklists}


def pending_lists(spark: SparkSession, experiment: Experiment, directory: str, run: str, output_type: str) -> set[str]:
    """Blocklists whose scores are not in ``directory`` yet for the same list, graph, run and format."""
    written = (read_pointer(spark, directory) or {"lists": {}})["lists"]
    states = _states(spark, experiment, run, output_type)
    return {name for name, state in states.items() if written.get(name, {}).get("state") != state}


def write_scores(
    experiment: Experiment, scores: DataFrame, directory: str, names: set[str], run: str, output_type: str = "parquet"
) -> None:
    """Write the scores of the named lists to a fresh folder, one pass per vertex kind, then make them current.

    Other lists' scores stay current where they are. A list that reaches no vertex of a kind has no rows of it.
    The pointer tells for every list the folder, the format and what the scores were made from.
    """
    spark, folder = scores.sparkSession, fresh_folder()
    states = _states(spark, experiment, run, output_type)
    for kind, vertices in experiment.graph.vertices.items():
        path = f"{directory}/{folder}/{kind}"
        rows = scores_by_kind(vertices, scores).hint("rebalance")
        if output_type == "csv":
            write_graph_csv(rows, path, partition_by="experiment")
        else:
            rows.write.partitionBy("experiment").parquet(path)
    lists = (read_pointer(spark, directory) or {"lists": {}})["lists"]
    lists |= {name: {"folder": folder, "output_type": output_type, "state": states[name]} for name in names}
    replace_pointer(spark, directory, {"lists": lists}, {entry["folder"] for entry in lists.values()})


def read_scores(spark: SparkSession, directory: str) -> dict[str, dict[str, DataFrame]]:
    """The current score tables as ``{experiment: {kind: rows}}``, in the types they had, whatever their format."""
    found: dict[str, dict[str, DataFrame]] = {}
    for name, entry in sorted((read_pointer(spark, directory) or {"lists": {}})["lists"].items()):
        for kind in ("ip", "domain", "cert"):
            root = f"{directory}/{entry['folder']}/{kind}"
            path = partition_folder(spark, root, {"experiment": name})
            if not path_exists(spark, path):
                continue
            if entry["output_type"] == "csv":
                rows = read_graph_csv(spark, path, multi_line=kind == "cert", header=header_path(root))
                rows = rows.withColumns({"score": F.col("score").cast("double"), "fixed": F.col("fixed").cast("boolean")})
            else:
                rows = spark.read.parquet(path)
            found.setdefault(name, {})[kind] = rows
    return found
