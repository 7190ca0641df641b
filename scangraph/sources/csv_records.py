"""CSV whose values may hold line breaks, read by many tasks.

A record may span lines, so a reader of whole records has to begin at a file's first byte. Lines can be read from
anywhere, though: ``spark.read.text`` splits the file. A line begins inside a quoted value if the number of
quotes before it is odd. Quotes are counted within each split of the file in a first scan and summed up over the
splits, which are one short row each. In a second scan every task knows how its splits begin and puts their records
together as it reads them, so lines are not shuffled: only the parts of a record that goes over the end of a split are.

Quotes within values must be doubled, and values with quotes be quoted, as writers of CSV do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CORRUPT = "_malformed_record"


def quoted_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, block, value, odd``: every line without its line feed, its split, and whether it has an odd number of
    quotes. A split is read by one task from its first line to its last."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        (quotes % 2).cast("int").alias("odd"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The lines of a batch by split, in order."""
    if not batch.num_rows:
        return
    file, block = batch.column("file"), batch.column("block")
    other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
    cuts = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cuts, cuts[1:]):
        yield (file[begin].as_py(), block[begin].as_py()), batch.slice(begin, end - begin)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, block, odd, all0, all1`` of every split: the parity of its quotes, and how many records begin in it if it
    begins outside of quotes or inside."""
    found: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for split, lines in _runs(batch):
            own = found.setdefault(split, [0, 0, 0])
            odd = lines.column("odd").to_numpy()
            flips = (own[0] + np.cumsum(odd) - odd) % 2
            own[0] = int(own[0] + odd.sum()) % 2
            own[2] += int(flips.sum())
            own[1] += int(len(flips) - flips.sum())
    rows = [dict(file=file, block=block, odd=o, all0=a, all1=b) for (file, block), (o, a, b) in found.items()]
    kinds = [("file", pa.string()), ("block", pa.int64()), ("odd", pa.int64()), ("all0", pa.int64()), ("all1", pa.int64())]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


_RECORDS = pa.schema([("file", pa.string()), ("number", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("record", pa.string())])


class _Split:
    """The records of a split, from its lines in order. ``start`` tells whether it begins inside of quotes."""

    def __init__(self, split: tuple[str, int], start: int, first: int):
        self.file, self.block = split
        self.flips, self.number = start, first
        #: Lines of a record that goes on, and whether it began in this split.
        self.open: list[str] = []
        self.own = not start

    def _rows(self, numbers: np.ndarray, whole: bool, records: pa.Array) -> pa.RecordBatch:
        n = len(records)
        fixed = (pa.repeat(pa.scalar(v, kind), n) for v, kind in ((self.file, pa.string()), (self.block, pa.int64()), (whole, pa.bool_())))
        file, block, told = fixed
        return pa.RecordBatch.from_arrays([file, pa.array(numbers, pa.int64()), block, told, records], schema=_RECORDS)

    def close(self, whole: bool = False) -> Iterator[pa.RecordBatch]:
        """What is open: a part of a record, unless all of it was here."""
        if self.open:
            yield self._rows(np.array([self.number]), whole and self.own, pa.array(["\n".join(self.open)], pa.string()))
        self.open, self.own = [], True

    def add(self, lines: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        value, odd = lines.column("value").cast(pa.string()), lines.column("odd").to_numpy()
        after = self.flips + np.cumsum(odd)
        begins = np.flatnonzero((after - odd) % 2 == 0)
        self.flips = int(after[-1]) % 2
        if not len(begins):
            self.open += value.to_pylist()
            if not self.flips:
                yield from self.close(True)
            return
        if begins[0]:
            self.open += value[: begins[0]].to_pylist()
        yield from self.close(True)
        # Every record ends where the next begins; the last one may go on.
        done = len(value) if not self.flips else int(begins[-1])
        ends = np.append(begins if not self.flips else begins[:-1], done).astype(np.int32)
        if len(ends) > 1:
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), value), "\n")
            yield self._rows(self.number + 1 + np.arange(len(joined)), True, joined)
        self.number += len(begins)
        if self.flips:
            self.open = value[done:].to_pylist()


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, number, block, whole, record``: the records of every split, and the parts of those that cross its ends."""
    at, split = None, None
    for batch in batches:
        for own, lines in _runs(batch):
            if own != at:
                if split:
                    yield from split.close()
                at, split = own, _Split(own, lines.column("start")[0].as_py(), lines.column("first")[0].as_py())
            yield from split.add(lines)
    if split:
        yield from split.close()


def csv_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, number, record`` of every record; ``number`` counts the records of a file from 1, blank lines too."""
    lines = quoted_lines(spark, paths)
    # One row per split. A line belongs to the split that it begins in.
    ends = lines.select("file", "block", "odd").mapInArrow(_counted, "file string, block long, odd long, all0 long, all1 long")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = ends.withColumn("start", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    own = F.when(F.col("start") == 0, F.col("all0")).otherwise(F.col("all1"))
    splits = splits.withColumn("own", own).withColumn("first", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
    splits = splits.select("file", "block", "start", "first", ((F.col("start") + F.col("odd")) % 2).alias("end"))

    kinds = "file string, number long, block long, whole boolean, record string"
    # Splits must be those that were counted: with others, as after a change of the session's settings, nothing would fit.
    lost = F.raise_error(F.concat(F.lit("uncounted split of "), "file")).cast("long")
    placed = lines.join(F.broadcast(splits), ["file", "block"], "left").withColumn("start", F.coalesce("start", lost))
    columns = ["file", "block", "value", "odd", "start", "first"]
    alone = placed.select(*columns).mapInArrow(_assembled, kinds).where("whole").select("file", "number", "record")
    crossing = lines.join(F.broadcast(splits.where("start = 1 or end = 1")), ["file", "block"])
    parts = crossing.select(*columns).mapInArrow(_assembled, kinds).where("not whole")
    ordered = F.sort_array(F.collect_list(F.struct("block", "record")))
    joined = F.array_join(F.transform(ordered, lambda part: part["record"]), "\n")
    spanning = parts.groupBy("file", "number").agg(joined.alias("record"))
    ended = F.regexp_replace("record", "\r$", "")
    return alone.unionByName(spanning).withColumn("record", ended)


def read_csv_records(
    spark: SparkSession, paths: str | list[str], columns: list[str], header: bool, strict: bool
) -> DataFrame:
    """The records as string ``columns``; the first one of each file is left out if it is a ``header``.

    With ``strict``, records with fewer or more values are malformed and dropped; else missing values are null and
    more values are left out. Quotes are doubled; an empty value is null, and blank lines are no records.
    """
    records = csv_records(spark, paths)
    if header:
        records = records.where(F.col("number") > 1)
    records = records.where(F.col("record") != "")
    schema = ", ".join(f"`{c}` string" for c in [*columns, *([_CORRUPT] if strict else [])])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "multiLine": "true"}
    row = records.select(F.from_csv("record", schema, options).alias("row"))
    if strict:
        row = row.where(F.col(f"row.{_CORRUPT}").isNull())
    return row.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
