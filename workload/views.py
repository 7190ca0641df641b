"""Scan tables derived from the given tables.

Every event is one endpoint scan, every page one host name, one certificate and its DNS answers. All
rows of both tables are used.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scangraph.operators.relations import NO_POSSESSION
from scangraph.plans.build import Scans
from scangraph.sources.scans import HOSTS_SCHEMA
from scangraph.storage import Workspace


_tables: dict[tuple[str, str], DataFrame] = {}
_page_counts: dict[tuple[str, str], int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read once per session."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _tables:
        _tables[key] = spark.read.parquet(key[1])
    return _tables[key]


def page_count(spark: SparkSession, sf_dir: str) -> int:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _page_counts:
        _page_counts[key] = table(spark, sf_dir, "pages").count()
    return _page_counts[key]


def _text(value: Column | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def _dotted(*groups: Column | int) -> Column:
    return F.concat_ws(".", *[_text(g) for g in groups])


def _spread(number: Column) -> tuple[Column, Column]:
    """Two address groups of a number."""
    return F.floor(number / 256) % 256, number % 256


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/?#:]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"))


def _fingerprint(number: Column, sha: str) -> Column:
    text = F.concat(F.lit("cert"), _text(number))
    return F.sha1(text) if sha == "sha1" else F.sha2(text, 256)


def scan_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_hosts(spark, sf_dir)
    n = page_count(spark, sf_dir)
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    error = F.when((kind == "error") & (e % 2 == 0), f"x: {NO_POSSESSION}").when(kind == "error", "timeout")
    valid = F.when(kind == "error", 0).when(kind != "view", 1)
    events = table(spark, sf_dir, "events").withColumn("page_id", e % n)
    return events.join(pages, "page_id").select(
        e.alias("id"),
        _dotted(198, *_spread(u), e % 16).alias("ip"),
        F.when(e % 3 == 0, F.concat("host", F.lit("."))).otherwise(F.col("host")).alias("server_name"),
        error.alias("error_data"),
        F.when(kind != "signup", _fingerprint(u % n, "sha256")).alias("cert_hash"),
        valid.alias("cert_valid"),
        F.col("ts").cast("date").alias("scan_date"),
    )


def scan_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_hosts(spark, sf_dir)
    n = page_count(spark, sf_dir)
    e = F.col("event_id")
    return (
        table(spark, sf_dir, "events")
        .withColumn("page_id", (e * 7) % n)
        .join(pages, "page_id")
        .select(
            e.alias("id"),
            F.col("ts").cast("date").alias("scan_date"),
            F.when(e % 4 == 0, "/relative").otherwise(F.col("url")).alias("location"),
        )
    )


def scan_certs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_hosts(spark, sf_dir)
    n = page_count(spark, sf_dir)
    p = F.col("page_id")
    issuers = pages.select(p.alias("issuer_id"), F.col("host").alias("issuer_host"))
    with_ip = F.to_json(F.array("host", _dotted(192, 0, *_spread(p))))
    with_wildcard = F.to_json(F.array("host", F.concat(F.lit("*."), "issuer_host")))
    names = F.when(p % 13 == 0, "null").when(p % 5 == 0, with_ip).otherwise(with_wildcard)
    return (
        pages.withColumn("issuer_id", (p * 3) % n)
        .join(issuers, "issuer_id")
        .select(
            _fingerprint(p, "sha1").alias("sha1"),
            _fingerprint(p, "sha256").alias("sha256"),
            F.concat(F.lit("CN="), "host").alias("subject"),
            F.concat(F.lit("CN="), "issuer_host").alias("issuer"),
            F.lit("2024-01-01T00:00:00Z").alias("notBefore"),
            F.concat(F.lit("2025-01-01T00:00:0"), _text(p % 10), F.lit("Z")).alias("notAfter"),
            (p % 3 > 0).alias("basicConstraints"),
            (p % 3 == 1).alias("isCa"),
            F.when(p % 13 == 0, 0).otherwise(2).alias("numAltNames"),
            F.when(p % 11 > 0, names).alias("altNames"),
        )
    )


def scan_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_hosts(spark, sf_dir)
    p = F.col("page_id")
    v4 = pages.select(
        _dotted(198, *_spread(p), p % 16).alias("ip"),
        F.concat("host", F.lit(".")).alias("domain"),
        F.lit("web-A").alias("scan_src"),
        F.lit("2024-01-01").cast("date").alias("scan_date"),
    )
    v6 = pages.select(
        F.concat(F.lit("2001:db8::"), _text(p % 10000)).alias("ip"),
        F.col("host").alias("domain"),
        F.lit("web-AAAA").alias("scan_src"),
        F.lit("2024-01-02").cast("date").alias("scan_date"),
    )
    return v4.union(v6)


def scans(spark: SparkSession, sf_dir: str) -> Scans:
    return Scans(
        hosts=scan_hosts(spark, sf_dir),
        http=scan_http(spark, sf_dir),
        certs=scan_certs(spark, sf_dir),
        dns=scan_dns(spark, sf_dir),
    )


def stored_scans(spark: SparkSession, sf_dir: str, work: Workspace) -> Scans:
    """``scans`` as tables, as ingested scans are: a graph reads them several times, but they are derived once."""
    derived = scans(spark, sf_dir)
    return Scans(**{f.name: work.write(getattr(derived, f.name), f.name) for f in fields(Scans)})


def blocklists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Indicators by the vertex column they are matched with: those of all events of a type."""
    events = table(spark, sf_dir, "events")
    pages = page_hosts(spark, sf_dir)
    n = page_count(spark, sf_dir)
    sent = events.where(F.col("event_type") == "purchase")
    named = events.where(F.col("event_type") == "signup").withColumn("page_id", F.col("event_id") % n)
    failed = scan_hosts(spark, sf_dir).where(F.col("error_data").contains(NO_POSSESSION))
    return {
        "ip": failed.select("ip").distinct(),
        "domain_name": named.join(pages, "page_id").select(F.col("host").alias("domain_name")).distinct(),
        "sha1": sent.select(_fingerprint(F.col("user_id") % n, "sha1").alias("sha1")).distinct(),
    }


def list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, indicator``: every event lists one vertex, in a list of its type and day of the week."""
    pages = page_hosts(spark, sf_dir)
    n = page_count(spark, sf_dir)
    kind, day = F.col("event_type"), F.weekday("ts").cast("string")
    events = table(spark, sf_dir, "events").withColumn("page_id", F.col("event_id") % n).join(pages, "page_id")
    address = _dotted(198, *_spread(F.col("user_id")), F.col("event_id") % 16)
    indicator = (
        F.when(kind.isin("view", "click"), address)
        .when(kind == "purchase", _fingerprint(F.col("user_id") % n, "sha1"))
        .otherwise(F.col("host"))
    )
    name = F.concat(kind, day, F.element_at(F.create_map(*[F.lit(v) for pair in _LIST_NAMES.items() for v in pair]), kind))
    return events.select(name.alias("name"), indicator.alias("indicator"))


# File names of the lists of each event type: one indicator a line, CSV without header, and CSV with one.
_LIST_NAMES = {
    "view": ".ip",
    "click": "-feodo.ip.csv",
    "purchase": ".sha1.csv",
    "signup": ".dn",
    "error": ".dn.csv",
}


def write_lists(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write ``list_rows`` as list files below ``folder``, with comments, header lines, repeated rows and an empty list."""
    rows = list_rows(spark, sf_dir)
    headed = F.col("name").contains("feodo")
    csv = F.col("name").endswith(".csv") & ~headed
    listed = rows.withColumn("list", F.col("name"))
    # The first of three columns of a CSV line may itself hold a comma.
    quoted = F.format_string('"seen, %s",%s,x', F.col("name"), F.col("indicator"))
    lines = F.when(csv, F.array(F.concat(F.lit("# "), F.col("indicator")), quoted)).otherwise(F.array("indicator"))
    text = listed.where(~headed).select("list", F.explode(lines).alias("value"))
    text.write.mode("append").partitionBy("list").text(folder)
    columns = [F.lit("2024, first").alias("first_seen"), F.col("indicator").alias("listed"), F.lit("443").alias("port")]
    listed.where(headed).select("list", *columns).write.mode("append").partitionBy("list").option("header", True).csv(folder)
    rows.limit(0).select("indicator").write.mode("overwrite").text(f"{folder}/none.dn")


def write_hosts_csv(spark: SparkSession, sf_dir: str, path: str) -> None:
    """``scan_hosts`` as CSV of the scanner, with a document as the error of every row and with malformed rows.

    Rows with the same document are written one after another, which lets compression store it about once. Files are
    read whole, so they are kept short.
    """
    hosts, docs = scan_hosts(spark, sf_dir), table(spark, sf_dir, "documents")
    n = docs.count()
    texts = docs.select(F.col("doc_id").alias("about"), F.col("text").alias("error_data"))
    rows = hosts.drop("error_data").withColumn("about", F.col("id") % n).join(texts.hint("merge"), "about", "left")
    odd = {
        "id": F.when(F.col("id") % 23 == 7, F.concat(F.lit("no "), _text(F.col("id")))).otherwise(_text(F.col("id"))),
        "cert_valid": F.when(F.col("id") % 19 == 3, "yes").otherwise(_text(F.col("cert_valid"))),
    }
    columns = [c.split()[0] for c in HOSTS_SCHEMA.split(", ")]
    rows = rows.select(*[(odd.get(c) if c in odd else F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in columns])
    options = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options, compression="gzip", maxRecordsPerFile=20_000).csv(path, header=True)


def odd_sources(resolves: DataFrame) -> DataFrame:
    """Edges with sources that hold separators, escape signs and nothing, or none at all."""
    number = F.col("src") + F.col("dst")
    odd = F.array(
        F.concat(F.lit("list; of "), _text(number % 7), F.lit("\\s")),
        F.when(number % 3 == 0, "").otherwise("\\b\\"),
        F.concat_ws(";", "scan_src"),
    )
    none = F.array().cast("array<string>")
    return resolves.withColumn("scan_src", F.when(number % 5 == 0, none).when(number % 11 == 0, F.array(F.lit(""))).otherwise(odd))


def resolver_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per page: a name, two aliases in a row, both address kinds, and a cycle."""
    p = F.col("page_id")

    def answer(name: Column, kind: str, data: Column) -> Column:
        return F.struct(name.alias("name"), F.lit(kind).alias("type"), data.alias("data"))

    host = F.concat("host", F.lit("."))
    edge = F.concat(F.lit("edge"), _text(p % 7), F.lit(".cdn.example.net."))
    node = F.concat(F.lit("node"), _text(p % 5), F.lit(".cdn.example.net."))
    loop = F.concat(F.lit("loop"), _text(p), F.lit(".example.org."))
    answers = F.array(
        answer(host, "CNAME", edge),
        answer(edge, "CNAME", node),
        answer(node, "A", _dotted(198, *_spread(p), p % 16)),
        answer(node, "AAAA", F.concat(F.lit("2001:db8::"), _text(p % 10000))),
        answer(loop, "CNAME", host),
        answer(host, "CNAME", loop),
        answer(host, "TXT", F.lit("v=spf1")),
    )
    line = F.to_json(F.struct(host.alias("name"), F.struct(answers.alias("answers")).alias("data")))
    return page_hosts(spark, sf_dir).select(line.alias("line"))


def pem_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the payload of a PEM block."""
    body = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s+", "\n")
    pem = F.concat(F.lit("-----BEGIN CERTIFICATE-----\n"), body, F.lit("\n-----END CERTIFICATE-----\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), pem.alias("cert"))
