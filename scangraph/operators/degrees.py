"""Vertex degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangraph.functions.suffixes import union_all


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree per vertex from one scan of ``src``, ``dst``; duplicate edges all count."""
    out = F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    into = F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    ends = edges.select(F.inline(F.array(out, into)))
    return ends.groupBy("id").agg(F.sum("i").alias("inDegree"), F.sum("o").alias("outDegree"))


def kind_masks(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """``src, dst, mask`` of every pair that has an edge: bit ``i`` tells of an edge of type ``kinds[i]``.

    One aggregation that combines on the map side. Degrees of all kinds, of any of them together, and those
    that count neighbours once, follow from the pairs.
    """
    if len(kinds) > 62:
        raise ValueError("a mask holds 62 kinds of edges")
    bit = F.lit(None).cast("long")
    for i, kind in enumerate(kinds):
        bit = F.when(F.col("type") == kind, 1 << i).otherwise(bit)
    known = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst", bit.alias("bit"))
    return known.where(F.col("bit").isNotNull()).groupBy("src", "dst").agg(F.bit_or("bit").alias("mask"))


def mask_degrees(masks: DataFrame, kinds: list[str], wanted: dict[str, list[str]]) -> DataFrame:
    """In- and out-degrees per vertex for every set of kinds in ``wanted``, by its name, from one scan of the pairs.

    ``<name>In`` and ``<name>Out`` count edges of different kinds between two vertices each; ``<name>DistinctIn`` and
    ``<name>DistinctOut`` count neighbours. A vertex with an edge of any kind has a row.
    """
    sums = []
    for name, own in wanted.items():
        among = F.col("mask").bitwiseAND(sum(1 << kinds.index(k) for k in set(own)))
        for end, here in (("In", F.col("into")), ("Out", ~F.col("into"))):
            sums.append(F.sum(F.when(here, F.bit_count(among)).otherwise(0)).alias(f"{name}{end}"))
            sums.append(F.count_if(here & (among != 0)).alias(f"{name}Distinct{end}"))
    out = F.struct(F.col("src").alias("id"), F.lit(False).alias("into"))
    into = F.struct(F.col("dst").alias("id"), F.lit(True).alias("into"))
    ends = masks.select(F.inline(F.array(out, into)), "mask")
    return ends.groupBy("id").agg(*sums)


def undirected_degrees(edges: DataFrame) -> DataFrame:
    """Number of edge ends per vertex."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def with_degrees(vertices: DataFrame, degree: DataFrame) -> DataFrame:
    """Attach degrees by ``id``; vertices without edges get 0."""
    added = [c for c in degree.columns if c != "id"]
    return vertices.join(degree, "id", "left").fillna(0, subset=added)


def finish_vertices(vertices: DataFrame, ids: DataFrame, degree: DataFrame) -> DataFrame:
    """Distinct vertices with their id and degrees instead of the natural key."""
    numbered = vertices.distinct().join(ids, "guid")
    columns = [c for c in vertices.columns if c != "guid"]
    return with_degrees(numbered.select("id", *columns), degree)


def vertex_union(vertices: dict[str, DataFrame]) -> DataFrame:
    """``id``, ``inDegree``, ``outDegree`` of all kinds."""
    parts = [
        df.select(*[c for c in ("id", "inDegree", "outDegree") if c in df.columns]) for df in vertices.values()
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.fillna(0, subset=[c for c in ("inDegree", "outDegree") if c in merged.columns])


def mirror(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once."""
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return union_all([edges.select("src", "dst"), reverse]).distinct()
