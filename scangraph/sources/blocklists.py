"""Blocklists of addresses, domain names or certificate fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scangraph.functions.suffixes import union_all
from scangraph.storage import file_uri

# Kind of list -> (column it is matched with, vertex table).
KINDS = {"ip": ("ip", "ip"), "dn": ("domain_name", "domain"), "sha1": ("sha1", "cert")}
# Fixed value: only lists with this in their name have a header line.
_HEADED = "feodo"


@dataclass(frozen=True)
class Blocklist:
    """A list file. Its kind is given, or read off the file name; the last kind that fits wins."""

    location: str
    kind: str | None = None

    @property
    def file_name(self) -> str:
        return self.location.rstrip("/").rsplit("/", 1)[-1]

    @property
    def name(self) -> str:
        return self.file_name.replace(".", "_")

    def _kind(self) -> str:
        fitting = [self.kind] if self.kind else [k for k in KINDS if k in self.file_name]
        if not fitting or fitting[-1] not in KINDS:
            raise ValueError(f"{self.location}: the kind must be one of {', '.join(KINDS)}")
        return fitting[-1]

    @property
    def column(self) -> str:
        return KINDS[self._kind()][0]

    @property
    def vertex_table(self) -> str:
        return KINDS[self._kind()][1]

    @property
    def is_csv(self) -> bool:
        return "csv" in self.file_name

    @property
    def has_header(self) -> bool:
        return self.is_csv and _HEADED in self.file_name

    def read(self, spark: SparkSession) -> DataFrame:
        """Distinct indicators: the second column of a CSV, or one per line."""
        if self.is_csv:
            df = spark.read.csv(self.location, header=self.has_header, comment="#", quote='"', escape='"')
            return df.select(F.col(f"`{df.columns[1]}`").alias(self.column)).distinct()
        return spark.read.schema(f"{self.column} STRING").csv(self.location, header=False).distinct()


def _file_uri() -> Column:
    """Where a row was read from, written as ``storage.file_uri`` writes it."""
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")


def list_members(spark: SparkSession, lists: list[Blocklist]) -> DataFrame:
    """``indicator, codes`` of lists of one kind together; a code is the place of a list in ``lists``.

    Files of one format are one scan, however many lists there are; a row's list is known by its file, or by the
    folder of its file. Empty indicators are left out, and an indicator has one row with all its lists, at most as
    many as there are lists.
    """
    where = [(*file_uri(spark, b.location), code) for code, b in enumerate(lists)]
    scans = []
    for is_csv, has_header in sorted({(b.is_csv, b.has_header) for b in lists}):
        for is_folder in (False, True):
            own = [w for w, b in zip(where, lists, strict=True) if (b.is_csv, b.has_header, w[1]) == (is_csv, has_header, is_folder)]
            if not own:
                continue
            paths = [lists[code].location for _, _, code in own]
            if is_csv:
                reader = spark.read.schema("first STRING, indicator STRING").options(comment="#", quote='"', escape='"')
                rows = reader.option("columnPruning", True).csv(paths, header=has_header)
            else:
                rows = spark.read.schema("indicator STRING").csv(paths, header=False)
            at = F.regexp_replace(_file_uri(), "/[^/]*$", "") if is_folder else _file_uri()
            # One row per list: bounded by the number of lists that a run takes.
            codes = spark.createDataFrame([(uri, code) for uri, _, code in own], "at STRING, code INT")
            scans.append(rows.select("indicator", at.alias("at")).join(F.broadcast(codes), "at"))
    if not scans:
        return spark.createDataFrame([], "indicator STRING, codes ARRAY<INT>")
    found = union_all([scan.select("indicator", "code") for scan in scans]).where(F.col("indicator").isNotNull())
    return found.groupBy("indicator").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def listed_vertices(spark: SparkSession, lists: list[Blocklist], vertices: dict[str, DataFrame]) -> DataFrame:
    """``experiment, id`` of every vertex that is listed, for all lists by one join per kind of vertex."""
    found = [spark.createDataFrame([], "experiment STRING, id LONG")]
    for kind in sorted({b.vertex_table for b in lists}):
        own = [b for b in lists if b.vertex_table == kind]
        column = own[0].column
        members = list_members(spark, own).select(F.col("indicator").alias(column), "codes")
        coded = vertices[kind].select("id", column).join(members, column).select("id", F.explode("codes").alias("code"))
        names = spark.createDataFrame([(code, b.name) for code, b in enumerate(own)], "code INT, experiment STRING")
        found.append(coded.join(F.broadcast(names), "code").select("experiment", "id"))
    return union_all(found[1:] or found).distinct()
