"""Web archive with every payload stored once, under its digest.

An archive is two tables: ``headers`` has the exact bytes of each record up to its payload (WARC and HTTP
header) and the digest of the payload; ``payloads`` has each distinct payload once. Joining them on the
digest gives the original records back, and the digest is recomputed from the stored bytes on the way.
All of it is Spark expressions; a payload shared by very many records is one row per map task in the
grouping. Payloads are stored in buckets of their digest, so that long ones are not shuffled again for the WARC files: each
has one response to meet there, and revisits need none. Short ones have any number of responses; they are shuffled, and
split by the adaptive skew join.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scangraph.functions.suffixes import union_all
from scangraph.llm.common import scratch
from scangraph.storage import Workspace, list_names

#: Payloads of at least so many bytes are stored in one record and referred to by the others.
REVISIT_BYTES = 1000

CRLF = "\r\n"
END = b"\r\n\r\n"
#: Records of a WARC file at most, and bytes of records that a reader hands on together.
FILE_RECORDS, BATCH_BYTES = 50_000, 1 << 24
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    headers: DataFrame
    payloads: DataFrame


def _record_id(page_id: Column, row_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row_id, F.lit(">"))


def _header(date: str) -> Column:
    """Everything of a record before its payload."""
    is_response = F.col("record_type") == "response"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes"),
        F.lit(CRLF * 2),
    )
    length = F.length(http) + F.when(is_response, F.col("payload_bytes")).otherwise(0)
    # A line break inside a URL would end the field.
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("row_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(~is_response, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("top.page_id"), F.col("top.row_id")))),
        F.when(~is_response, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length),
    )
    return F.concat(lines, F.lit(CRLF * 2), http).cast("binary")


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Write one record per row of ``pages`` (``page_id, url, html``) below ``path``.

    A null html is an empty payload, a null url has no target field. Of records with equal payloads of at
    least ``REVISIT_BYTES`` the one with the largest page_id (of repeated ids, the last row; null is below
    all) is the response and the others are revisits of it. An empty table makes an empty archive.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    described = rows.select(
        "row_id",
        "page_id",
        "url",
        "digest",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    described.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/described")
    described = spark.read.schema(described.schema).parquet(f"{path}/described")
    shared = described.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest")
    shared.agg(F.max(F.struct("page_id", "row_id")).alias("top")).write.mode("overwrite").parquet(f"{path}/tops")
    tops = spark.read.parquet(f"{path}/tops")
    typed = described.join(tops, "digest", "left").withColumn(
        "record_type",
        F.when(F.col("top").isNull() | (F.col("top.row_id") == F.col("row_id")), "response").otherwise("revisit"),
    )
    headers = typed.select(_header(date).alias("header"), "digest")
    headers.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")
    # A second digest tells whether payloads that share the first one are the same.
    other = F.sha2("payload", 512)
    once = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(other).alias("low"), F.max(other).alias("high"))
    clash = F.raise_error(F.concat(F.lit("different payloads with digest "), "digest")).cast("binary")
    once = once.select("digest", F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(clash).alias("payload"))
    # The grouping has placed rows by digest already: with as many buckets as it has partitions, a bucket is one file.
    table = f"scangraph_{uuid.uuid4().hex}"
    writer = once.write.mode("overwrite").bucketBy(_buckets(spark), "digest").option("compression", "zstd")
    try:
        writer.option("path", f"{path}/payloads").saveAsTable(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # the files stay
    return open_archive(spark, path)


def _buckets(spark: SparkSession) -> int:
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), most)


def open_archive(spark: SparkSession, path: str) -> Archive:
    headers = spark.read.schema("header binary, digest string").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    return Archive(headers, payloads)


def _verified(payloads: DataFrame) -> DataFrame:
    payload = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("binary")
    )
    return payloads.withColumn("payload", payload)


def _is_response() -> Column:
    return F.regexp_extract(F.col("header").cast("string"), r"\r\nWARC-Type: (\w+)", 1) == "response"


def records(archive: Archive) -> DataFrame:
    """``record, payload`` of every record: its exact bytes, and the full payload also of revisits.

    Fails on a payload that no longer has its digest.
    """
    whole = archive.headers.join(_verified(archive.payloads), "digest")
    # A response's header is followed by its payload.
    end = F.lit((CRLF * 2).encode())
    record = F.concat("header", F.when(_is_response(), F.col("payload")).otherwise(F.lit(b"")), end)
    return whole.select(record.alias("record"), "payload")


def read_pages(archive: Archive) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from the reconstructed records.

    Digest and length are those of the payload bytes; the other columns are read from the header. Odd rows are as in
    ``write_archive``.
    """
    # The header is text before the first empty line; the payload behind it may be any bytes.
    head = F.substring_index(F.col("record").cast("string"), CRLF * 2, 1)
    rows = records(archive).select(head.alias("head"), "payload")

    def field(pattern: str) -> Column:
        return F.regexp_extract("head", pattern, 1)

    return rows.select(
        field(r"\r\nWARC-Record-ID: <urn:page:(-?\d*):").try_cast("long").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        field(r"\r\nWARC-Type: (\w+)").alias("record_type"),
        field(r"\r\nWARC-Refers-To: <urn:page:(-?\d*):").try_cast("long").alias("refers_to"),
    )


def export_warc(archive: Archive, path: str, compression: str = "none") -> None:
    """Write the records as WARC files (``gzip`` compresses each file as a whole)."""
    size = F.substring_index(F.col("header").cast("string"), "Content-Length: ", -1)
    long = F.trim(F.replace(size, F.lit(CRLF))).cast("long") >= REVISIT_BYTES
    end = F.lit((CRLF * 2).encode())
    responses, payloads = archive.headers.where(_is_response()), _verified(archive.payloads)
    parts = [archive.headers.where(~_is_response()).select(F.concat("header", end).alias("record"))]
    for own, stored in ((long, F.length("payload") >= REVISIT_BYTES), (~long, F.length("payload") < REVISIT_BYTES)):
        met = responses.where(own).join(payloads.where(stored), "digest")
        parts.append(met.select(F.concat("header", "payload", end).alias("record")))
    # Spark's text writer ends each value with the line feed that a record ends with.
    value = F.col("record").substr(F.lit(1), F.length("record") - 1).cast("string")
    text = union_all(parts).select(value.alias("value"))
    writer = text.write.mode("overwrite").option("maxRecordsPerFile", FILE_RECORDS)
    writer.option("compression", compression).text(path)


def _split_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["record_type", "record_id", "refers_to", "payload_digest", "record", "payload"]
    for files in batches:
        for content in files.content:
            content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)
            found, at, held = [], 0, 0
            while at < len(content):
                end = content.index(END, at)
                named = _fields(content[at:end])
                size = int(named["content-length"])
                if len(content) < end + size + 8 or content[end + size + 4 : end + size + 8] != END:
                    raise ValueError(f"record {named.get('warc-record-id')} is not {size} bytes long")
                record = content[at : end + size + 8]
                payload = None
                if named["warc-type"] == "response":
                    # The block is an HTTP header and as many bytes as that says.
                    begin = content.index(END, end + 4) + 4
                    payload = content[begin : end + size + 4]
                    if int(_fields(content[end + 4 : begin - 4])["content-length"]) != len(payload):
                        raise ValueError(f"the payload of {named.get('warc-record-id')} is cut off")
                names = ("warc-type", "warc-record-id", "warc-refers-to", "warc-payload-digest")
                found.append((*(named.get(n) for n in names), record, payload))
                at, held = end + size + 8, held + size
                if held > BATCH_BYTES:
                    yield pd.DataFrame(found, columns=columns)
                    found, held = [], 0
            if found:
                yield pd.DataFrame(found, columns=columns)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(CRLF)[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``record_type, record_id, refers_to, payload_digest, record, payload`` of WARC files, plain or compressed whole.

    Records are cut by their Content-Length; one that is cut off, or whose payload is, is an error. The payload of a
    revisit is null. A file is one Spark row of up to 2 GB.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = "record_type string, record_id string, refers_to string, payload_digest string, record binary, payload binary"
    return files.mapInPandas(_split_files, kinds)


def read_warc_pages(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``read_pages`` from WARC files alone.

    Length and digest are those of the payload bytes read; a revisit has those of the response that its
    WARC-Refers-To names, which must be there. A payload that does not have the digest of its record is an error.
    """
    page = F.regexp_extract("record_id", r"^<urn:page:(-?\d*):", 1).try_cast("long")
    told = F.concat(F.lit("sha1:"), F.sha1("payload"))
    wrong = F.raise_error(F.concat(F.lit("damaged payload of "), "record_id")).cast("string")
    checked = F.when(F.col("payload").isNull() | (F.col("payload_digest") == told), F.sha1("payload")).otherwise(wrong)
    read = read_warc(spark, path).select(
        "record_id", "record_type", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest")
    )
    # Written once: records without their payloads, so that files are read and cut once.
    read = scratch(spark).write(read, "read")
    responses = read.where("record_type = 'response'")
    plain = responses.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    about = responses.select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest")
    revisits = read.where("record_type <> 'response'").select(page.alias("page_id"), "refers_to").join(about, "refers_to", "left")
    lost = F.raise_error(F.concat(F.lit("no response "), "refers_to")).cast("string")
    target = F.regexp_extract("refers_to", r"^<urn:page:(-?\d*):", 1).try_cast("long").alias("refers_to")
    digest = F.coalesce("payload_digest", lost).alias("payload_digest")
    return plain.unionByName(revisits.select("page_id", "payload_bytes", digest, F.lit("revisit").alias("record_type"), target))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a scratch archive, its records as WARC files, and read the files back.

    Null and empty html are empty payloads, null urls have no target field, repeated rows and rows without page_id
    have a record each, and an empty table gives an empty result; ties between equal payloads are as in
    ``write_archive``. Other columns are left behind.
    """
    spark = pages.sparkSession
    work = scratch(spark)
    archive = write_archive(pages, work.path("archive"))
    tables = Workspace(spark, work.path("archive"))
    try:
        if list_names(spark, tables.path("payloads")):  # an empty table has no files in its buckets
            payloads = tables.read_bucketed("payloads", _buckets(spark), ["digest"], ordered=False)
            archive = Archive(archive.headers, payloads)
        export_warc(archive, work.path("warc"), "gzip")
    finally:
        tables.forget_tables()
    return read_warc_pages(spark, work.path("warc"))
