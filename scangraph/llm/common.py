"""What the operators share: row numbers, scratch tables and tokenizer files."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scangraph.storage import Workspace

#: A-Z only; every other character keeps its case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tells the column of a row's number in tables that ``stored`` has written, whatever the column is called.
_ROW_MARK = "scangraph_row_number"

#: Called with each new workspace, so that a pipeline can delete it once its stage is written.
_listeners: list[Callable[[Workspace], None]] = []


class Scratch(Workspace):
    """A workspace whose tables are compressed more tightly: they mostly hold text once more."""

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))


def scratch(spark: SparkSession) -> Scratch:
    work = Scratch.fresh(spark)
    for listener in _listeners:
        listener(work)
    return work


def on_scratch(listener: Callable[[Workspace], None]) -> Callable[[], None]:
    """Register ``listener`` for new workspaces; the returned function takes it off again."""
    _listeners.append(listener)
    return lambda: _listeners.remove(listener)


def row_column(docs: DataFrame) -> str | None:
    """The column with the row numbers of ``stored``. A caller's own column of the same name is not one."""
    return next((f.name for f in docs.schema.fields if f.metadata.get(_ROW_MARK)), None)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id, doc_id, text`` of every row: null text is empty, text is UTF-8 bytes.

    Other columns are left behind, so none of them can clash with an operator's own. The row number
    tells repeated rows apart. Another scan may number rows otherwise, as splits follow the cores there are:
    numbers that are joined on must come from a table that ``stored`` has written.
    """
    name = row_column(docs)
    number = F.monotonically_increasing_id() if name is None else F.col(f"`{name}`")
    return docs.select(
        number.alias("row_id"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )


def stored(docs: DataFrame, work: Scratch) -> DataFrame:
    """``docs`` with row numbers, written once, so that every later scan reads the same ones."""
    if row_column(docs) is not None:
        return docs
    name = "_row"
    while name.lower() in {c.lower() for c in docs.columns}:  # never an own column of the documents
        name += "_"
    number = F.monotonically_increasing_id().alias(name, metadata={_ROW_MARK: True})
    return work.write(docs.select("*", number), "numbered")


def keep_rows(docs: DataFrame, row_ids: DataFrame) -> DataFrame:
    """The rows of ``docs``, which ``stored`` gave, whose number is in ``row_ids`` (one column), without the number.

    Rows with nulls, equal rows and columns of any name are kept as they are; numbers that no row has, and repeated
    ones, change nothing, and an empty table gives an empty result.
    """
    name = row_column(docs)
    if name is None:
        raise ValueError("rows are told by the numbers that stored() writes")
    kept = docs.join(row_ids.toDF(name), name, "left_semi")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns if c != name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; ``PUBLIC_TOKENIZERS`` names another folder."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
