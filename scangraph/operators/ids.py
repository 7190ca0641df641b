"""Dense numeric ids without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scangraph.storage import Workspace

# monotonically_increasing_id() puts the partition above 33 bits of row number.
_ROW_BITS = 33


def dense_ids(keys: DataFrame, key: str, work: Workspace, name: str = "keys") -> DataFrame:
    """Number distinct ``keys`` by rank: 0-based, gap-free and the same in every run.

    The keys are range-partitioned and sorted in parallel and written with their position inside the
    partition. Only the partition sizes, one row each, are summed up to offsets. Ranges are found by a sample, which
    reads its input once more, so the keys are written before.
    """
    keys = work.write(keys.select(key), f"{name}_unordered")
    ordered = keys.select(key).repartitionByRange(key).sortWithinPartitions(key)
    chunk = F.spark_partition_id()
    position = F.monotonically_increasing_id() - F.shiftleft(chunk.cast("long"), _ROW_BITS)
    placed = work.write(ordered.select(key, chunk.alias("chunk"), position.alias("position")), name)

    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("chunk").agg(F.count("*").alias("size"))
    offsets = sizes.select("chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    numbered = placed.join(F.broadcast(offsets), "chunk")
    return numbered.select(key, (F.col("offset") + F.col("position")).alias("id"))
