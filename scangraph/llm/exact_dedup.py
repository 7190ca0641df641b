"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and named by integers;
then adjacent names are paired and the distinct pairs named again, until one name is left of each text.
Two texts have the same (number of rounds, name) exactly when they are equal: no digest decides.

Hot texts are met in three places. A block is sent to the sort once per batch of rows, not per row; pairs
are made distinct with map-side combining; and names go back to rows by joins whose skewed side the
adaptive planner splits. No task gathers a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangraph.llm.common import LOWER, UPPER, scratch, texts

BLOCK_BYTES = 4096

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_CUT = (
    "batch long, local int, block binary, row_id long, doc_id long, text_sha256 string, "
    "n_blocks long, pos long"
)
# A name holds the partition that gave it above this many bits of rank.
_RANK_BITS = 40


def _cut_blocks(block_bytes: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            batch = int(rows.row_id.iloc[0])
            local: dict[bytes, int] = {}
            uses = []
            for row_id, doc_id, text in zip(rows.row_id, rows.doc_id, rows.text, strict=True):
                text = bytes(text).translate(_FOLD)
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                digest = hashlib.sha256(text).hexdigest()
                starts = range(0, max(1, len(text)), block_bytes)
                for pos, start in enumerate(starts):
                    name = local.setdefault(text[start : start + block_bytes], len(local))
                    first = (doc_id, digest) if pos == 0 else (None, None)
                    uses.append((batch, name, None, row_id, *first, len(starts), pos))
            rest = (None,) * 5
            blocks = [(batch, name, block, *rest) for block, name in local.items()]
            names = [field.split()[0] for field in _CUT.split(", ")]
            out = pd.DataFrame(blocks + uses, columns=names)
            whole = ["row_id", "doc_id", "n_blocks", "pos"]
            yield out.astype(dict.fromkeys(whole, "Int64"))

    return cut


def _name_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rank of each distinct block of a sorted partition."""
    base = TaskContext.get().partitionId() << _RANK_BITS
    last, rank = None, -1
    for rows in batches:
        names = []
        for block in rows.block:
            if block != last:
                last, rank = block, rank + 1
            names.append(base | rank)
        yield pd.DataFrame({"batch": rows.batch, "local": rows.local, "name": names})


def text_names(docs: DataFrame, work, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row_id, doc_id, text_sha256, level, name``; equal lower-cased texts share (level, name)."""
    cut = work.write(texts(docs).mapInPandas(_cut_blocks(block_bytes), _CUT), "cut")
    blocks = cut.where("block is not null").select("batch", "local", "block")
    named = blocks.repartition("block").sortWithinPartitions("block")
    names = work.write(named.mapInPandas(_name_sorted, "batch long, local int, name long"), "names")
    uses = cut.where("row_id is not null").drop("block").join(names, ["batch", "local"])
    uses = work.write(uses.select("row_id", "doc_id", "text_sha256", "n_blocks", "pos", "name"), "uses")

    current = uses.select("row_id", F.col("n_blocks").alias("n"), "pos", "name")
    most = current.agg(F.max("n")).first()[0] or 1
    done = [current.where("n = 1").select("row_id", F.lit(0).alias("level"), "name")]
    level = 0
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        halves = current.where("n > 1").groupBy("row_id", "n", F.shiftright("pos", 1).alias("pos"))
        even = F.col("pos") % 2 == 0
        pairs = halves.agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = work.write(pairs, f"pairs{level}")
        ordered = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
        names = work.write(ordered.withColumn("name", F.monotonically_increasing_id()), f"names{level}")
        half = F.shiftright(F.col("n") + 1, 1).alias("n")
        current = pairs.join(names, ["a", "b"]).select("row_id", half, "pos", "name")
        done.append(current.where("n = 1").select("row_id", F.lit(level).alias("level"), "name"))
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    heads = uses.where("pos = 0").select("row_id", "doc_id", "text_sha256")
    return work.write(heads.join(found, "row_id"), "named")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``row_id, doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest doc_id
    stays; a null doc_id is below all others, and of rows repeated with the same doc_id the last one
    stays. A null text is empty; all empty texts are one group. An empty table gives an empty result.
    """
    work = scratch(docs.sparkSession)
    named = text_names(docs, work, block_bytes)
    groups = named.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "row_id")).alias("top"), F.count("*").alias("group_size")
    )
    groups = work.write(groups, "groups")
    return named.join(groups, ["level", "name"]).select(
        "row_id",
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("top.row_id")).alias("kept"),
        "text_sha256",
    )
