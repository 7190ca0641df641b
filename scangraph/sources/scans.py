"""Scan files: TLS endpoint scans, redirects, certificates and resolved names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scangraph.functions.suffixes import union_all
from scangraph.plans.build import Scans
from scangraph.sources.certificates import decode_certificates
from scangraph.sources.csv_records import read_csv_records
from scangraph.storage import (
    delete_path,
    file_states,
    fingerprint,
    partition_folder,
    path_exists,
    read_text,
    write_text,
)

# The column contracts of the scanner's files.
HOSTS_SCHEMA = (
    "id INT, ip STRING, port INT, server_name STRING, synStart INT, synEnd INT, scanEnd INT, protocol INT, "
    "cipher STRING, resultString STRING, error_data STRING, cert_id INT, cert_hash STRING, "
    "pub_key_hash STRING, cert_valid INT, tls_alerts_send STRING, peer_certificates STRING, "
    "tls_alerts_received STRING, client_hello STRING"
)
HOSTS_COLUMNS = ["id", "ip", "server_name", "error_data", "cert_hash", "cert_valid"]
CERTS_PARSED_SCHEMA = (
    "id INT, sha1 STRING, sha256 STRING, valid BOOLEAN, verifyError STRING, subject STRING, issuer STRING, "
    "notBefore STRING, notAfter STRING, basicConstraints BOOLEAN, isCa BOOLEAN, sha256PubKey STRING, "
    "numAltNames INT, altNames STRING"
)
CERTS_COLUMNS = [
    "id", "sha1", "sha256", "subject", "issuer", "notBefore", "notAfter", "basicConstraints", "isCa",
    "numAltNames", "altNames",
]
DNS_SCHEMA = "ip STRING, domain STRING"

# Those that Spark reads itself come first; ``.xz`` is found only to be refused with a reason.
_SUFFIXES = ("", ".zst", ".gz", ".bz2", ".xz")


def find_file(spark: SparkSession, path: str) -> str:
    """The plain file or its first compressed variant."""
    for suffix in _SUFFIXES:
        if path_exists(spark, path + suffix):
            return path + suffix
    raise FileNotFoundError(f"no file {path} with any of the suffixes {_SUFFIXES[1:]}")


def load_csv(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    columns: list[str] | None = None,
    header: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Read scanner CSV with doubled quotes; malformed rows are dropped.

    With a schema, a row is malformed when a value of the kept ``columns`` does not have its type. The
    reader checks only what a query selects, so types are checked here, and the rows are the same for
    every query. Without a schema the header names the columns and all are strings. A file whose values may hold line
    breaks (``multi_line``) is read by many tasks, too.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    if path.endswith(".xz"):
        raise ValueError(f"{path}: Spark has no xz codec; recompress the file as zst or gz")
    fields = dict(f.split() for f in schema.split(", ")) if schema else {}
    if header:
        named = spark.read.csv(path, header=True, quote='"', escape='"').columns
        if schema and [n.lower() for n in named] != [f.lower() for f in fields]:
            raise ValueError(f"{path}: its header names {', '.join(named)}")
    elif schema is None:
        raise ValueError("a file without header needs a schema")
    # A subset may be read without the others; else every row must have all columns.
    if multi_line:
        raw = read_csv_records(spark, path, list(fields) or named, header, strict=not columns)
    else:
        text = ", ".join(f"`{c}` STRING" for c in list(fields) or named)
        options = {"quote": '"', "escape": '"', "mode": "DROPMALFORMED", "columnPruning": bool(columns)}
        raw = spark.read.options(**options).schema(text).csv(path, header=header)
    if schema is None:
        return raw
    typed = {name: fields[name] for name in columns or fields if fields[name] != "STRING"}
    for name, kind in typed.items():
        raw = raw.where(F.col(name).isNull() | F.col(name).try_cast(kind).isNotNull())
    return raw.select(*[F.col(c).try_cast(fields[c]).alias(c) for c in columns or fields])


def load_http(spark: SparkSession, path: str) -> DataFrame:
    """``id, location`` of the redirect file, whose other headers vary."""
    df = load_csv(spark, path)
    return df.select(F.col("id").try_cast("int").alias("id"), F.col("Location").alias("location"))


def load_cert_chain(spark: SparkSession, path: str) -> DataFrame:
    """Chain file with ``host_id`` as ``id`` and numbers typed."""
    df = load_csv(spark, path)
    if "host_id" in df.columns:
        df = df.drop("id").withColumnRenamed("host_id", "id")
    return df.withColumns({c: F.col(c).try_cast("int") for c in ("id", "chain_complete")})


def load_parsed_certs(spark: SparkSession, path: str) -> DataFrame:
    """Certificates that were decoded before: headerless CSV in the fixed order, or Parquet."""
    if ".csv" in path:
        return load_csv(spark, path, CERTS_PARSED_SCHEMA, CERTS_COLUMNS, header=False)
    return spark.read.parquet(path).select(*CERTS_COLUMNS)


@dataclass(frozen=True)
class TlsScan:
    """A dated directory with ``hosts.csv``, ``http.csv`` and ``certs.csv``.

    ``parsed_certs`` names a table of certificates that were decoded before, in place of the last.
    """

    scan_date: str
    location: str
    parsed_certs: str | None = None

    def __post_init__(self) -> None:
        date.fromisoformat(self.scan_date)

    @property
    def name(self) -> str:
        return self.location.rstrip("/").rsplit("/", 1)[-1]

    def hosts(self, spark: SparkSession) -> DataFrame:
        return load_csv(spark, find_file(spark, f"{self.location}/hosts.csv"), HOSTS_SCHEMA, HOSTS_COLUMNS)

    def http(self, spark: SparkSession) -> DataFrame:
        return load_http(spark, find_file(spark, f"{self.location}/http.csv"))

    def certs(self, spark: SparkSession) -> DataFrame:
        """Decoded certificates. The file is one split, so its rows are spread before decoding."""
        if self.parsed_certs:
            return load_parsed_certs(spark, self.parsed_certs)
        raw = load_csv(spark, find_file(spark, f"{self.location}/certs.csv"))
        return decode_certificates(raw.select("id", "cert").hint("rebalance")).select(*CERTS_COLUMNS)


@dataclass(frozen=True)
class DnsScan:
    """A dated, headerless file of ``ip,domain`` pairs."""

    scan_src: str
    scan_date: str
    location: str

    def __post_init__(self) -> None:
        date.fromisoformat(self.scan_date)

    @property
    def name(self) -> str:
        return self.location.rstrip("/").rsplit("/", 1)[-1]

    def pairs(self, spark: SparkSession) -> DataFrame:
        return load_csv(spark, self.location, DNS_SCHEMA, header=False, multi_line=False)


def _ingest(
    spark: SparkSession,
    scans: list,
    read: Callable[[SparkSession, object], DataFrame],
    root: str,
    keys: list[str],
    overwrite: bool,
) -> None:
    """Write all scans that are not complete yet in one job, each below its own partition folders."""
    if len({tuple(_scan_keys(scan, keys).values()) for scan in scans}) < len(scans):
        raise ValueError(f"two scans below {root} have the same {', '.join(keys)}")
    # A marker outside the data tells which state of the source files was written completely.
    states = {_marker(root, scan, keys): (scan, fingerprint(*file_states(spark, scan.location))) for scan in scans}
    pending = {m: found for m, found in states.items() if overwrite or read_text(spark, m) != found[1]}
    if not pending:
        return
    for marker, (scan, _) in pending.items():
        # Rows of an earlier state go, also where the scan has none any more.
        delete_path(spark, marker)
        delete_path(spark, partition_folder(spark, root, _scan_keys(scan, keys)))
    rows = union_all([_with_keys(read(spark, scan), scan, keys) for scan, _ in pending.values()])
    # Rows are spread without regard to their scan: one large scan is written by many tasks.
    writer = rows.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*keys).parquet(root)
    for marker, (_, state) in pending.items():
        write_text(spark, marker, state)


def _marker(root: str, scan: TlsScan | DnsScan, keys: list[str]) -> str:
    return f"{root}/_done/{fingerprint(*_scan_keys(scan, keys).values())}"


def _scan_keys(scan: TlsScan | DnsScan, keys: list[str]) -> dict[str, str]:
    return {k: scan.name if k == "source" else getattr(scan, k) for k in keys}


def _is_scan(scan: TlsScan | DnsScan, keys: list[str]) -> Column:
    """Condition on the partition columns, so that other scans' files are not even listed for tasks."""
    matches = F.lit(True)
    for key, value in _scan_keys(scan, keys).items():
        matches = matches & (F.col(key) == F.lit(value).cast("date" if key == "scan_date" else "string"))
    return matches


def _with_keys(df: DataFrame, scan: TlsScan | DnsScan, keys: list[str]) -> DataFrame:
    values = _scan_keys(scan, keys)
    kinds = {k: "date" if k == "scan_date" else "string" for k in keys}
    return df.select("*", *[F.lit(values[k]).cast(kinds[k]).alias(k) for k in keys])


TLS_KEYS = ["scan_date", "source"]
DNS_KEYS = ["scan_src", "scan_date", "source"]


def ingest_scans(
    spark: SparkSession,
    tls_scans: list[TlsScan],
    dns_scans: list[DnsScan],
    cache_dir: str,
    overwrite: bool = False,
) -> Scans:
    """Turn scan files into Parquet below ``cache_dir``, partitioned by date and source, once.

    Compressed CSV cannot be split, so this is the only place that reads it; everything later works on
    splittable Parquet. The date is part of every path, for DNS files too.
    """
    _ingest(spark, tls_scans, lambda s, scan: scan.hosts(s), f"{cache_dir}/hosts", TLS_KEYS, overwrite)
    _ingest(spark, tls_scans, lambda s, scan: scan.http(s), f"{cache_dir}/http", TLS_KEYS, overwrite)
    _ingest(spark, tls_scans, lambda s, scan: scan.certs(s), f"{cache_dir}/certs", TLS_KEYS, overwrite)
    _ingest(spark, dns_scans, lambda s, scan: scan.pairs(s), f"{cache_dir}/dns", DNS_KEYS, overwrite)
    return read_ingested(spark, cache_dir, tls_scans, dns_scans)


def read_ingested(spark: SparkSession, cache_dir: str, tls_scans: list[TlsScan], dns_scans: list[DnsScan]) -> Scans:
    """Read the given scans from the tables of ``ingest_scans``; other scans there are not touched.

    Partition columns are typed here, not inferred.
    """

    def table(name: str, columns: str) -> DataFrame:
        scans, keys = (dns_scans, DNS_KEYS) if name == "dns" else (tls_scans, TLS_KEYS)
        if not scans:
            return spark.createDataFrame([], columns)
        wanted = F.lit(False)
        for scan in scans:
            wanted = wanted | _is_scan(scan, keys)
        return spark.read.schema(columns).parquet(f"{cache_dir}/{name}").where(wanted)

    keys = "scan_date DATE, source STRING"
    hosts = "id INT, ip STRING, server_name STRING, error_data STRING, cert_hash STRING, cert_valid INT"
    certs = (
        "id INT, sha1 STRING, sha256 STRING, subject STRING, issuer STRING, notBefore STRING, notAfter STRING, "
        "basicConstraints BOOLEAN, isCa BOOLEAN, numAltNames INT, altNames STRING"
    )
    return Scans(
        hosts=table("hosts", f"{hosts}, {keys}"),
        http=table("http", f"id INT, location STRING, {keys}"),
        certs=table("certs", f"{certs}, {keys}"),
        dns=table("dns", f"{DNS_SCHEMA}, scan_src STRING, {keys}"),
    )


def scan_tables(spark: SparkSession, tls_scans: list[TlsScan], dns_scans: list[DnsScan]) -> Scans:
    """The same tables straight from the files, without a cache."""

    def tables(scans: list, read: Callable, keys: list[str]) -> DataFrame:
        return union_all([_with_keys(read(scan), scan, keys) for scan in scans])

    return Scans(
        hosts=tables(tls_scans, lambda s: s.hosts(spark), TLS_KEYS),
        http=tables(tls_scans, lambda s: s.http(spark), TLS_KEYS),
        certs=tables(tls_scans, lambda s: s.certs(spark), TLS_KEYS),
        dns=tables(dns_scans, lambda s: s.pairs(spark), DNS_KEYS),
    )
