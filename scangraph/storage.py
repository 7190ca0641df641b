"""Intermediate tables in the shared folder of the cluster, and small file-system checks.

Iterative jobs cut their lineage by writing a table and reading it back. The tables live below
``spark.checkpoint.dir``, which every executor can reach, so a lost executor costs no result.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's setting, or a private one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        folder = tempfile.mkdtemp(prefix="scangraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_dirs[app] = folder
    return _local_dirs[app]


class Workspace:
    """A folder of intermediate tables that belongs to one run.

    With ``resume``, tables that an earlier run of the same inputs completed here are read, not rewritten.
    """

    def __init__(self, spark: SparkSession, root: str, resume: bool = False):
        self.spark = spark
        self.root = root.rstrip("/")
        self.resume = resume
        self._tables: list[str] = []

    @classmethod
    def fresh(cls, spark: SparkSession) -> Workspace:
        return cls(spark, f"{checkpoint_dir(spark)}/scangraph/{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet and return it read back, with its lineage cut."""
        if not (self.resume and is_complete(self.spark, self.path(name))):
            writer = df.write.mode("overwrite")
            if partition_by:
                writer = writer.partitionBy(partition_by)
            writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def write_bucketed(
        self,
        df: DataFrame,
        name: str,
        buckets: int,
        keys: list[str],
        ordered: bool = True,
        partition_by: str | None = None,
    ) -> DataFrame:
        """Write ``df`` bucketed and, for tables that are read often, sorted by ``keys``.

        Later joins on the keys need no exchange.
        """
        table = f"scangraph_{uuid.uuid4().hex}"
        self.delete(name)
        writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys)
        if ordered:
            writer = writer.sortBy(*keys)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.option("path", self.path(name)).saveAsTable(table)
        self._tables.append(table)
        return self.spark.table(table)

    def read(self, name: str) -> DataFrame:
        """A table that ``write`` completed before."""
        return self.spark.read.parquet(self.path(name))

    def read_bucketed(
        self, name: str, buckets: int, keys: list[str], ordered: bool = True, partition_by: tuple[str, str] | None = None
    ) -> DataFrame:
        """A table that ``write_bucketed`` completed before, maybe in another session, with its buckets known again.

        ``partition_by`` has the type of the partition column as well, which files don't tell.
        """
        table, columns = f"scangraph_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in keys)
        types = dict(self.read(name).dtypes) | dict([partition_by] if partition_by else [])
        described = ", ".join(f"`{column}` {kind}" for column, kind in types.items())
        place = self.path(name).replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {table} ({described}) USING parquet "
            + (f"PARTITIONED BY (`{partition_by[0]}`) " if partition_by else "")
            + f"CLUSTERED BY ({columns}) {f'SORTED BY ({columns}) ' if ordered else ''}INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        if partition_by:
            self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        self._tables.append(table)
        return self.spark.table(table)

    def forget_tables(self) -> None:
        """Drop the catalogue entries of bucketed tables; their files go with ``delete``."""
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()

    def delete(self, name: str) -> None:
        delete_path(self.spark, self.path(name))

    def close(self) -> None:
        """Delete all tables, once no result is read from them any more."""
        self.forget_tables()
        delete_path(self.spark, self.root)


@contextmanager
def buckets_trusted(spark: SparkSession) -> Iterator[None]:
    """Let joins of bucketed tables rely on how these were written.

    The order inside a bucket that is one file is kept (Spark checks the files), and a join on the
    bucket columns and more is done bucket by bucket. Without these settings every bucket would be
    sorted at every read, and shuffled again for the additional columns.
    """
    settings = {
        "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _hadoop_path(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _hadoop_path(spark, path)
    return fs.exists(hadoop_path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a table was fully written to ``path``."""
    return path_exists(spark, f"{path}/_SUCCESS")


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Sorted entry names of a folder, hidden and marker files left out."""
    hadoop_path, fs = _hadoop_path(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(hadoop_path)]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, length and time of change of a file, or of the files in a folder, sorted."""
    hadoop_path, fs = _hadoop_path(spark, path)
    found = fs.globStatus(hadoop_path) or []
    parts = [part for status in found for part in (fs.listStatus(status.getPath()) if status.isDirectory() else [status])]
    return sorted((p.getPath().getName(), p.getLen(), p.getModificationTime()) for p in parts)


def file_uri(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Full name of a file or folder, with one slash behind ``file:``, and whether it is a folder."""
    hadoop_path, fs = _hadoop_path(spark, path)
    status = fs.getFileStatus(hadoop_path)
    return re.sub("^file:/+", "file:/", status.getPath().toUri().toString()), status.isDirectory()


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _hadoop_path(spark, path)
    fs.delete(hadoop_path, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file, or None where there is none."""
    hadoop_path, fs = _hadoop_path(spark, path)
    if not fs.exists(hadoop_path):
        return None
    stream = fs.open(hadoop_path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def partition_folder(spark: SparkSession, root: str, values: dict[str, str]) -> str:
    """Folder in which Spark's writers put the rows of a partition; they escape some characters."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return "/".join([root, *[f"{escape(k)}={escape(v)}" for k, v in values.items()]])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    hadoop_path, fs = _hadoop_path(spark, path)
    stream = fs.create(hadoop_path, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Give a small file another content at once: readers see the old one or the new one, whole.

    File systems rename over a file in one step; object stores, which can't, show a file once it is whole.
    """
    jvm = spark.sparkContext._jvm
    beside = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    write_text(spark, beside, text)
    source, target = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    except Py4JJavaError as error:  # a file system without rename over a file
        if "UnsupportedFileSystem" not in str(error.java_exception):
            raise
        write_text(spark, path, text)
        delete_path(spark, beside)
    else:
        context.rename(source, target, options)


def content_fingerprint(df: DataFrame, *columns: str) -> str:
    """Digest of the rows of ``df``, whatever their order: their number, and sum and xor of their hashes.

    One scan that combines on the map side.
    """
    own = F.xxhash64(*(columns or [F.col(f"`{c}`") for c in df.columns]))
    row = df.agg(F.count("*"), F.sum(own.cast("decimal(20,0)")), F.bit_xor(own)).first()
    return fingerprint(*(columns or df.dtypes), *row)


def fingerprint(*parts: object) -> str:
    """Short digest of inputs and parameters, used in names of results that may be reused."""
    return hashlib.sha256("\x1f".join(map(str, parts)).encode("utf-8")).hexdigest()[:16]
