"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, work, name: str) -> DataFrame:
    """``node, root`` of every node that has an edge ``a, b``; equal roots mean the same component.

    In each round every node moves to its least neighbour (or stays, if it is less itself) and edges are
    relabelled; what is left are fewer nodes, at most half of them. Stars, as near copies make them, are
    done in one or two rounds. The moves of all rounds are then followed in turn. All joins are between
    written tables, so hubs are split by the adaptive skew join.
    """
    current = work.write(edges.select("a", "b").where("a <> b").distinct(), f"{name}_0")
    moves: list[DataFrame] = []
    while not current.isEmpty():
        step = len(moves) + 1
        both = current.union(current.select("b", "a"))
        move = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        moves.append(work.write(move, f"{name}_{step}_moves"))
        left = moves[-1].select("a", F.col("to").alias("new_a"))
        right = moves[-1].select(F.col("a").alias("b"), F.col("to").alias("new_b"))
        moved = current.join(left, "a").join(right, "b").where("new_a <> new_b")
        moved = moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
        current = work.write(moved.distinct(), f"{name}_{step}")
    if not moves:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for move in moves[1:]:
        later = move.select(F.col("a").alias("root"), "to")
        roots = roots.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return work.write(roots, name)
