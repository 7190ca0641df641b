"""Typed Internet graphs from dated scans, built and scored with Spark DataFrames."""

from scangraph.functions.suffixes import SuffixRules
from scangraph.operators.propagation import propagate
from scangraph.plans.build import Scans, build_graph
from scangraph.plans.rank import run_experiment
from scangraph.sources.graph_files import Graph, read_graph, write_graph

__all__ = [
    "Graph",
    "Scans",
    "SuffixRules",
    "build_graph",
    "propagate",
    "read_graph",
    "run_experiment",
    "write_graph",
]
