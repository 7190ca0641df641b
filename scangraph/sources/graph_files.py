"""Graphs on disk: Parquet tables, and CSV in the header dialect of graph-database bulk importers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scangraph.sources.csv_records import read_csv_records
from scangraph.sources.snapshots import current_folder, fresh_folder, read_pointer, replace_pointer
from scangraph.storage import content_fingerprint, file_states, fingerprint, list_names, path_exists, write_text

# The header dialect.
_HEADERS = {"id": ":ID", "src": ":START_ID", "dst": ":END_ID", "scan_date": "scan_date:date", "scan_dates": "scan_date:date[]"}
_HEADER_TYPES = {
    "string[]": ["server_name_indicators", "locations", "scan_src"],
    "boolean": ["basicConstraints", "isCa", "valid"],
    "int": ["inDegree", "outDegree", "numAltNames"],
}
_KEYS = {":ID": "id", ":START_ID": "src", ":END_ID": "dst"}


@dataclass(frozen=True)
class Graph:
    """Vertex tables by kind and relation tables by name.

    ``details`` holds rows that belong to an edge but do not fit its list columns; it is not part of
    the edges.
    """

    vertices: dict[str, DataFrame]
    relations: dict[str, DataFrame]
    details: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        for tables in (self.vertices, self.relations):
            if name in tables:
                return tables[name]
        raise KeyError(f"the graph has no table {name}")


def header_field(column: str) -> str:
    """Header of a column in the import dialect."""
    if column in _HEADERS:
        return _HEADERS[column]
    for kind, columns in _HEADER_TYPES.items():
        if column in columns:
            return f"{column}:{kind}"
    return column


def _to_text(df: DataFrame, column: str) -> Column:
    return join_list(F.col(column)).alias(column) if header_field(column).endswith("[]") else F.col(column)


def join_list(values: Column) -> Column:
    """A list as one cell, its values separated by ``;``.

    Importers split at every ``;``, so one inside a value is written ``\\s``, a ``\\`` is written ``\\b``, and
    an empty value ``\\e``. URLs and dates have none of these and stay as they are; nulls are left out.
    """

    def written(value: Column) -> Column:
        marked = F.replace(F.replace(value, F.lit("\\"), F.lit("\\b")), F.lit(";"), F.lit("\\s"))
        return F.when(value == "", "\\e").otherwise(marked)

    return F.concat_ws(";", F.transform(values.cast("array<string>"), written))


def split_list(cell: Column) -> Column:
    """The values of a cell of ``join_list``; an empty cell has none."""

    def read(value: Column) -> Column:
        plain = F.replace(F.replace(value, F.lit("\\s"), F.lit(";")), F.lit("\\b"), F.lit("\\"))
        return F.when(value == "\\e", "").otherwise(plain)

    present = F.coalesce(cell, F.lit("")) != ""
    return F.when(present, F.transform(F.split(cell, ";"), read)).otherwise(F.array().cast("array<string>"))


def write_graph_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a headerless part directory and its header file ``<path>-header.csv``.

    Bulk importers take a header file followed by any number of part files, so nothing is merged.
    """
    # The header comes first: data that are complete always have one.
    header = ",".join(header_field(c) for c in df.columns if c != partition_by)
    write_text(df.sparkSession, header_path(path), header + "\n")
    writer = df.select(*[_to_text(df, c) for c in df.columns]).write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.csv(path, escape='"', header=False)


def header_path(path: str) -> str:
    return f"{path}-header.csv"


def _typed(field: str) -> Column:
    """Column of a header field with its type restored."""
    raw = F.col(f"`{field}`")
    if field in _KEYS:
        return raw.try_cast("long").alias(_KEYS[field])
    name, _, kind = field.partition(":")
    if kind == "date[]":
        return split_list(raw).cast("array<date>").alias("scan_dates" if name == "scan_date" else name)
    if kind == "string[]":
        return split_list(raw).alias(name)
    if kind in ("date", "boolean"):
        return raw.try_cast(kind).alias(name)
    if kind == "int":
        return raw.try_cast("long").alias(name)
    return raw.alias(name)


def read_graph_csv(spark: SparkSession, path: str, multi_line: bool = False, header: str | None = None) -> DataFrame:
    """Read one table in the header dialect: a file with header line, or a part directory with a header file
    (``header``, or the one beside it).

    Values may hold line breaks where ``multi_line`` is set; files are split either way.
    """
    apart = header or (header_path(path) if path_exists(spark, header_path(path)) else None)
    if apart:
        fields = spark.read.text(apart).first()[0].split(",")
    else:
        fields = spark.read.csv(path, header=True, escape='"').columns
    if multi_line:
        df = read_csv_records(spark, path, fields, header=apart is None, strict=False)
    else:
        schema = ", ".join(f"`{f}` string" for f in fields)
        df = spark.read.schema(schema).csv(path, escape='"', header=apart is None)
    return df.select(*[_typed(f) for f in df.columns])


def read_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read one graph table: Parquet directory, CSV parts, ``.csv`` or ``.csv.zst``."""
    if path.endswith((".csv", ".csv.zst")) or path_exists(spark, header_path(path)):
        return read_graph_csv(spark, path, multi_line)
    return spark.read.parquet(path)


def read_graph(spark: SparkSession, directory: str, bidirectional: bool = False) -> Graph:
    """Read every ``<name>.vertex`` and ``<name>.relation`` table of a graph: the current one of ``write_graph``, or
    those that lie in ``directory`` itself.

    With ``bidirectional``, the two relations that only repeat another one backwards are left out.
    """
    tables: dict[str, dict[str, DataFrame]] = {"vertex": {}, "relation": {}, "detail": {}}
    folder = current_folder(spark, directory)
    for entry in list_names(spark, folder):
        name, _, rest = entry.partition(".")
        kind = rest.partition(".")[0]
        if kind not in tables or entry.endswith("-header.csv"):
            continue
        if bidirectional and name in ("deployed_on", "parent_domain"):
            continue
        # Only the names in certificates may hold line breaks.
        tables[kind][name] = read_table(spark, f"{folder}/{entry}", (name, kind) == ("cert", "vertex"))
    return Graph(tables["vertex"], tables["relation"], tables["detail"])


def graph_state(spark: SparkSession, directory: str) -> str:
    """Digest of the graph in ``directory``: of what it was made from, or of the state of its files."""
    facts = read_pointer(spark, directory)
    if facts is not None:
        return facts["state"]
    return fingerprint(*[(name, file_states(spark, f"{directory}/{name}")) for name in list_names(spark, directory)])


def write_graph(
    graph: Graph, directory: str, output_type: str = "parquet", overwrite: bool = False, made_from: str | None = None
) -> bool:
    """Write all tables as the current graph of ``directory``; False if it is there already, unless ``overwrite``.

    ``made_from`` is a digest of the graph's inputs. Without it, the rows are compared: one scan of each table.
    Parquet output is range-partitioned and sorted by id, so lookups by id prune files.
    """
    if output_type not in ("csv", "parquet"):
        raise ValueError(f"unknown output type {output_type}")
    keyed = [(f"{n}.vertex", df, ["id"]) for n, df in graph.vertices.items()]
    keyed += [(f"{n}.relation", df, ["src", "dst"]) for n, df in graph.relations.items()]
    keyed += [(f"{n}.detail", df, ["src", "dst"]) for n, df in graph.details.items() if not df.isEmpty()]
    spark = keyed[0][1].sparkSession
    contents = [made_from] if made_from else [(name, content_fingerprint(df)) for name, df, _ in keyed]
    state = fingerprint(output_type, *contents)
    facts = read_pointer(spark, directory)
    if facts is not None and facts["state"] == state and not overwrite:
        return False
    folder = fresh_folder()
    for name, df, keys in keyed:
        path = f"{directory}/{folder}/{name}"
        if output_type == "csv":
            write_graph_csv(df, path)
        else:
            df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
    replace_pointer(spark, directory, {"folder": folder, "state": state, "output_type": output_type}, {folder})
    return True


def write_typed_edges(edges: DataFrame, path: str) -> None:
    """Write distinct ``src, dst, type`` rows of several relations as one table, clustered by edge."""
    edges.distinct().repartitionByRange("src", "dst").write.mode("overwrite").parquet(path)
