"""Token ids as Arrow stream files of equal-length sequences.

A file is one Arrow IPC stream. Its rows are sequences: ``tokens`` and ``mask`` are fixed-size lists of the
same length (the mask is true for tokens, false for the padding of a file's last row), so a memory map of
the file gives any sequence without a copy; ``documents`` lists the documents that begin in the row.

Texts are range-partitioned by document id, encoded and handed to Spark's own writer as one value per
file, so files are committed by Spark, on any store, and a lost executor is only a task run again.
(That writer ends a value with a line feed, which lies behind the stream's end mark.)
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scangraph.llm.byte_bpe import byte_bpe
from scangraph.llm.common import scratch, texts

SEQUENCE = 2048
ROWS_PER_BATCH = 256
FILE_TOKENS = 8_000_000
END_ID = 0


def _schema(length: int, dtype: str, part: int, number: int) -> pa.Schema:
    token = pa.uint16() if dtype == "<u2" else pa.uint32()
    begun = {"doc_id": pa.int64(), "row_id": pa.int64(), "offset": pa.int32(), "n_tokens": pa.int64()}
    fields = {
        "tokens": pa.list_(token, length),
        "mask": pa.list_(pa.bool_(), length),
        "documents": pa.list_(pa.struct(begun)),
    }
    return pa.schema(fields, metadata={"part": str(part), "number": str(number)})


def pack_stream(documents: list[tuple], length: int, dtype: str, part: int, number: int) -> bytes:
    """The stream of ``(doc_id, row_id, ids as bytes)`` items, one after the other without gaps."""
    tokens = np.frombuffer(b"".join(ids for *_, ids in documents), dtype)
    rows = -(-len(tokens) // length)
    padded = np.zeros(rows * length, dtype)
    padded[: len(tokens)] = tokens
    mask = np.arange(rows * length) < len(tokens)
    begun: list[list[dict]] = [[] for _ in range(rows)]
    at = 0
    for doc_id, row_id, ids in documents:
        n = len(ids) // padded.itemsize
        begun[at // length].append(
            {"doc_id": doc_id, "row_id": row_id, "offset": at % length, "n_tokens": n}
        )
        at += n
    schema = _schema(length, dtype, part, number)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        for row in range(0, rows, ROWS_PER_BATCH):
            end = min(rows, row + ROWS_PER_BATCH)
            cells = slice(row * length, end * length)
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(padded[cells]), length),
                pa.FixedSizeListArray.from_arrays(pa.array(mask[cells]), length),
                pa.array(begun[row:end], schema.field("documents").type),
            ]
            writer.write_batch(pa.record_batch(columns, schema=schema))
    return sink.getvalue().to_pybytes()


def open_sequences(source) -> pa.Table:
    """All sequences of a file (a path, which is memory-mapped, or its bytes), without copying them."""
    file = pa.BufferReader(source) if isinstance(source, bytes) else pa.memory_map(str(source))
    return pa.ipc.open_stream(file).read_all()


def sequence(table: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and mask of sequence ``i``; the tokens are a view of the file's memory."""
    row = table.slice(i, 1)
    tokens, mask = (row.column(c).chunk(0).flatten() for c in ("tokens", "mask"))
    return tokens.to_numpy(), mask.to_numpy(zero_copy_only=False)


def _write_part(path: str | None, length: int, file_tokens: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, part = byte_bpe(path), TaskContext.get().partitionId()
        end = np.array([END_ID], bpe.dtype).tobytes()
        held, size, number = [], 0, 0
        for rows in batches:
            for row_id, doc_id, own in zip(rows.row_id, rows.doc_id, bpe.ids_of(rows.text), strict=True):
                ids = own + end
                held.append((None if pd.isna(doc_id) else int(doc_id), int(row_id), ids))
                size += len(ids) // len(end)
                if size >= file_tokens:
                    yield pd.DataFrame({"stream": [pack_stream(held, length, bpe.dtype, part, number)]})
                    held, size, number = [], 0, number + 1
        if held:
            yield pd.DataFrame({"stream": [pack_stream(held, length, bpe.dtype, part, number)]})

    return write


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    length: int = SEQUENCE,
    file_tokens: int = FILE_TOKENS,
) -> None:
    """Encode every whole text, end each with id 0, and write the files in ascending order of doc_id.

    Null texts are empty: just the end id. Rows without doc_id come first; repeated rows are all written,
    in the order of the table. A file ends with the document that brings it to ``file_tokens``.
    """
    ordered = texts(docs).repartitionByRange("doc_id", "row_id").sortWithinPartitions("doc_id", "row_id")
    streams = ordered.mapInPandas(_write_part(tokenizer, length, file_tokens), "stream binary")
    values = streams.select(F.col("stream").cast("string").alias("value"))
    values.write.option("maxRecordsPerFile", 1).text(path)


_READ = "part int, number int, place int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        for content in files.content:
            table = open_sequences(bytes(content))
            tokens = np.concatenate([c.flatten().to_numpy() for c in table.column("tokens").chunks])
            about = table.schema.metadata
            part, number = int(about[b"part"]), int(about[b"number"])
            length = table.schema.field("tokens").type.list_size
            out, at = [], 0
            for row, begun in enumerate(table.column("documents").to_pylist()):
                for place in begun:
                    start, n = row * length + place["offset"], place["n_tokens"]
                    crc = zlib.crc32(tokens[start : start + n].astype("<u4").tobytes())
                    out.append((part, number, at, place["doc_id"], start, n, crc))
                    at += 1
            names = [field.split()[0] for field in _READ.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it. Only one total per file is summed up in order.
    """
    # Written once, so that files are decoded once: for the totals and for the rows.
    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_read_files, _READ)
    found = scratch(spark).write(found, "found")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    totals = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", "number", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return found.join(bases, ["part", "number"]).select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
