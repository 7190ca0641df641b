"""From a graph and blocklists to threat scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scangraph.operators.degrees import vertex_union
from scangraph.operators.propagation import propagate
from scangraph.operators.relations import typed_union
from scangraph.sources.experiment import Experiment, pending_lists, write_scores
from scangraph.storage import Workspace, fingerprint


def run_experiment(
    spark: SparkSession,
    experiment: Experiment,
    out: str | None = None,
    epsilon: float = 0.01,
    max_iter: int = 100,
    output_type: str = "parquet",
    overwrite: bool = False,
    degree: str = "parallel",
    work: Workspace | None = None,
) -> DataFrame | None:
    """Propagate the blocklists of an experiment and, with ``out``, write scores per vertex kind.

    Lists whose scores are in ``out`` already, from the same list, graph and parameters, are left out unless
    ``overwrite``; None when that leaves nothing to do.
    """
    graph = experiment.graph
    run, names = fingerprint(epsilon, max_iter, experiment.bidirectional, degree), {b.name for b in experiment.blocklists}
    if out and not overwrite:
        names = pending_lists(spark, experiment, out, run, output_type)
        if not names:
            return None
    scores = propagate(
        spark,
        vertex_union(graph.vertices),
        typed_union(graph.relations),
        experiment.seeds(spark, names),
        epsilon=epsilon,
        max_iter=max_iter,
        bidirectional=experiment.bidirectional,
        degree=degree,
        work=work,
    )
    if out:
        write_scores(experiment, scores, out, names, run, output_type)
    return scores
