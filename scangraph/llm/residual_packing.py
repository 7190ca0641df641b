"""Packing of token pieces into sequences by hierarchical best fit.

Every task packs its own pieces by best fit, longest first, and hands out the sequences that are nearly
full. The emptiest of the others go up a tree as items: a few tasks' sequences meet in one task of the next
round and are packed again, until one task is left. What goes up is bounded per task, so no task of any
round sees more than a fixed number of sequences; what doesn't go up is handed out as it is, and no piece
is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangraph.llm.byte_bpe import byte_bpe
from scangraph.llm.common import scratch, texts

SEQUENCE = 2048
END_ID = 0

#: Pieces that one task packs, sequences that it passes on, and tasks that meet in the next round.
TASK_PIECES, CARRIED, FAN_IN = 200_000, 512, 8

_PIECE = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"
_BIN = f"{_PIECE}, sequence_id long, offset long, fill long, done boolean"
# sequence_id: round, task, number within the task.
_ROUND_BIT, _TASK_BIT, _TASK_MASK = 56, 24, (1 << 32) - 1


def _cut_pieces(path: str | None, capacity: int, keep_ids: bool):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(path)
        names = [field.split()[0] for field in _PIECE.split(", ")] + ["ids"] * keep_ids
        for rows in batches:
            out = []
            for row_id, doc_id, found in zip(rows.row_id, rows.doc_id, bpe.ids_of(rows.text), strict=True):
                ids = np.frombuffer(found, bpe.dtype).astype("<u4")
                ids = np.append(ids, np.uint32(END_ID))
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                # Only the first piece may be shorter than a sequence.
                ends = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                start = 0
                for piece, end in enumerate(ends):
                    own = ids[start:end].tobytes()
                    row = (row_id, doc_id, piece, start, end - start, zlib.crc32(own))
                    out.append((*row, own) if keep_ids else row)
                    start = end
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return cut


def token_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE, keep_ids: bool = False
) -> DataFrame:
    """``row_id, doc_id, piece, start, length, ids_crc32`` (and ``ids``, 32 bits each, if wanted).

    Every text is encoded whole and ended by id 0; a null text is empty, so each row has a piece. Only
    rows longer than ``capacity`` are cut, into full pieces behind a first one that may be shorter.
    """
    schema = _PIECE + ", ids binary" * keep_ids
    return texts(docs).mapInPandas(_cut_pieces(tokenizer, capacity, keep_ids), schema)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item in the given order, and the fill of each bin.

    An item goes to the bin with the least room that holds it. Bit ``r`` of a mask tells that some bin has
    room ``r``, so that bin is found without a search.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, offsets, fills = 0, [], [], []
    for size in sizes:
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, own = capacity, len(fills)
            fills.append(0)
        bins.append(own)
        offsets.append(capacity - room)
        fills[own] += size
        if room > size:
            by_room[room - size].append(own)
            mask |= 1 << (room - size)
    return bins, offsets, fills


def _repack(rows: pd.DataFrame, capacity: int, base: int, carried: int) -> pd.DataFrame:
    """Pack the bins of ``rows`` (one row per piece, ``fill`` the size of its bin) as items."""
    items = rows.drop_duplicates("sequence_id")[["sequence_id", "fill"]]
    items = items.sort_values(["fill", "sequence_id"], ascending=[False, True], ignore_index=True)
    bins, offsets, fills = best_fit(items.fill.tolist(), capacity)
    placed = pd.DataFrame({"bin": bins, "at": offsets}, index=items.sequence_id.to_numpy())
    placed = placed.loc[rows.sequence_id.to_numpy()]
    own = placed["bin"].to_numpy(dtype="int64")
    fill = np.asarray(fills, dtype="int64")
    # The emptiest bins go on; nearly full ones and those beyond the bound are done.
    done = np.ones(len(fill), dtype=bool)
    emptiest = np.argsort(fill, kind="stable")[:carried]
    done[emptiest[fill[emptiest] < capacity - capacity // 64]] = False
    return rows.assign(
        sequence_id=base | own,
        offset=rows.offset.to_numpy() + placed["at"].to_numpy(),
        fill=fill[own],
        done=done[own],
    )


def _pack_task(capacity: int, carried: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [rows for rows in batches if len(rows)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        rows = rows.assign(sequence_id=np.arange(len(rows)), offset=0, fill=rows.length, done=False)
        yield _repack(rows, capacity, TaskContext.get().partitionId() << _TASK_BIT, carried)

    return pack


def _pack_group(capacity: int, level: int, carried: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        base = level << _ROUND_BIT | int(key[0]) << _TASK_BIT
        return _repack(rows.drop(columns="task"), capacity, base, carried)

    return pack


def pack_pieces(
    pieces: DataFrame,
    capacity: int = SEQUENCE,
    task_pieces: int = TASK_PIECES,
    carried: int = CARRIED,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; sequences have no gaps and at most ``capacity``.

    Every piece is placed, pieces of ``capacity`` alone. Equal pieces are told apart by ``row_id``.
    """
    work = scratch(pieces.sparkSession)
    pieces = work.write(pieces, "pieces")
    tasks = max(1, -(-pieces.count() // task_pieces))
    spread = pieces.repartition(tasks, "row_id", "piece")
    level, rounds = 0, [work.write(spread.mapInPandas(_pack_task(capacity, carried), _BIN), "round0")]
    task = F.shiftright("sequence_id", _TASK_BIT).bitwiseAND(F.lit(_TASK_MASK))
    tasks = (rounds[0].agg(F.max(task)).first()[0] or 0) + 1
    while True:
        level, tasks = level + 1, -(-tasks // fan_in)
        groups = rounds[-1].where("not done").withColumn("task", task % F.lit(tasks)).groupBy("task")
        packed = groups.applyInPandas(_pack_group(capacity, level, carried if tasks > 1 else 0), _BIN)
        rounds.append(work.write(packed, f"round{level}"))
        if tasks == 1:
            break
    found = rounds[0].where("done")
    for later in rounds[1:]:
        found = found.union(later.where("done"))
    return found.drop("fill", "done")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of ``docs``.

    Null and empty texts are one piece of one token; an empty table has no sequences. Repeated rows and rows without
    doc_id are packed each. Of equal pieces any may come first: which sequence one is in is not fixed, that all are
    placed is. Texts of any length are cut into pieces of ``capacity``.
    """
    packed = pack_pieces(token_pieces(docs, tokenizer, capacity), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed_sequences(pieces_with_ids: DataFrame, packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` (32 bits each): the pieces of each sequence joined in the order of offsets."""
    ids = pieces_with_ids.select("row_id", "piece", "ids")
    placed = packed.join(ids, ["row_id", "piece"]).groupBy("sequence_id")
    joined = placed.agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    start = F.lit(b"")
    whole = F.aggregate("parts", start, lambda done, part: F.concat(done, part["ids"]))
    return joined.select("sequence_id", whole.alias("ids"))
