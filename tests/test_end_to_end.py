import hashlib
import gzip
import json
from collections import Counter

import pytest

from scangraph.__main__ import main
from scangraph.sources.experiment import read_scores
from scangraph.sources.graph_files import read_graph
from scangraph.sources.scans import CERTS_PARSED_SCHEMA, HOSTS_SCHEMA, DnsScan, TlsScan, ingest_scans, scan_tables
from scangraph.sources.snapshots import read_pointer

HOSTS_HEADER = ",".join(c.split()[0] for c in HOSTS_SCHEMA.split(", "))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def host(i, ip, name, error, cert, valid):
    return f"{i},{ip},443,{name},0,0,0,772,,,{error},9,{cert},,{valid},,,,"


@pytest.fixture
def inputs(spark, tmp_path):
    """Two TLS scans and two DNS files. Certificates come decoded, so that no key pair is needed."""
    for day, extra in (("2024-01-01", []), ("2024-01-08", [host(3, "10.0.0.3", "", "timeout", "", "")])):
        folder = tmp_path / day
        folder.mkdir()
        rows = [
            host(1, "10.0.0.1", "www.example.com.", "", digest("one"), 1),
            host(2, "10.0.0.2", "shop.example.org", "x: invalid signature by the server certificate", digest("two"), 0),
            *extra,
        ]
        (folder / "hosts.csv").write_text("\n".join([HOSTS_HEADER, *rows]) + "\n")
        (folder / "http.csv").write_text("id,Location\n1,https://shop.example.org/start\n2,/relative\n")
        (folder / "certs.csv").write_text("id,cert,system_cert_store\n")
    certs = [
        (1, "s1", digest("one"), None, None, "CN=one", "CN=ca", "t0", "t1", True, False, "k", 2, json.dumps(["*.example.com", "10.0.0.9"])),
        (2, "s2", digest("two"), None, None, "CN=two", "CN=ca", "t0", "t1", False, False, "k", 0, "null"),
        (3, "s3", "broken", None, None, "CN=three", "CN=ca", "t0", "t1", False, False, "k", 0, "null"),
    ]
    spark.createDataFrame(certs, CERTS_PARSED_SCHEMA).write.parquet(f"{tmp_path}/decoded")
    (tmp_path / "suffixes.dat").write_text("com\norg\nnet\n")
    (tmp_path / "a.ipdomain").write_text("10.0.0.1,www.example.com.\n10.0.0.4,cdn.example.net\nnonsense,cdn.example.net\n")
    (tmp_path / "aaaa.ipdomain").write_text("2001:db8::1,www.example.com\n")
    return tmp_path


def build(inputs, kind):
    main(
        ["build", "--cache-dir", f"{inputs}/cache-{kind}", "--out", f"{inputs}/exp-{kind}/tls_graph", "--output-type", kind]
        + ["--tls-scan", "2024-01-01", f"{inputs}/2024-01-01", "--tls-scan", "2024-01-08", f"{inputs}/2024-01-08"]
        + ["--suffix-list", f"{inputs}/suffixes.dat", "--url-lists", "true"]
        + ["--parsed-certs", "2024-01-01", f"{inputs}/decoded", "--parsed-certs", "2024-01-08", f"{inputs}/decoded"]
        + ["--dns-scan", "A", "2024-01-01", f"{inputs}/a.ipdomain", "--dns-scan", "AAAA", "2024-01-01", f"{inputs}/aaaa.ipdomain"]
    )


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_scans_to_scores(spark, inputs, kind):
    build(inputs, kind)
    graph = read_graph(spark, f"{inputs}/exp-{kind}/tls_graph")
    domains = {r.domain_name: r for r in graph["domain"].collect()}
    ips = {r.ip: r for r in graph["ip"].collect()}
    certs = {r.subject: r for r in graph["cert"].collect()}
    assert set(ips) == {"10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.4", "10.0.0.9", "2001:db8::1"}
    assert set(domains) == {
        "www.example.com", "example.com", "*.example.com", "shop.example.org", "example.org", "cdn.example.net", "example.net",
    }
    assert set(certs) == {"CN=one", "CN=two"}

    every = [*domains.values(), *ips.values(), *certs.values()]
    assert sorted(r.id for r in every) == list(range(len(every)))
    edges = {n: {(r.src, r.dst): r for r in df.collect()} for n, df in graph.relations.items()}
    assert edges["subdomain"].keys() == {(b, a) for a, b in edges["parent_domain"]}
    total = sum(map(len, edges.values()))
    assert sum(r.inDegree for r in every) == sum(r.outDegree for r in every) == total
    starts = Counter(src for relation in edges.values() for src, _ in relation)
    assert all(starts[r.id] == r.outDegree for r in every)

    one, www = certs["CN=one"].id, domains["www.example.com"].id
    returned = edges["returns"][ips["10.0.0.1"].id, one]
    assert [str(d) for d in returned.scan_dates] == ["2024-01-01", "2024-01-08"] and returned.valid is True
    assert edges["deployed_on"].keys() == {(one, ips["10.0.0.1"].id)}
    resolved = edges["resolves"][www, ips["10.0.0.1"].id]
    assert resolved.scan_src == ["A"] and resolved.valid is True
    assert edges["resolves"][www, ips["2001:db8::1"].id].valid is None
    assert {d for _, d in edges["contains"]} == {domains["*.example.com"].id, ips["10.0.0.9"].id}
    (redirect,) = edges["redirects"].values()
    assert (redirect.src, redirect.dst) == (www, domains["shop.example.org"].id)
    assert redirect.locations == ["https://shop.example.org/start"]

    lists = inputs / f"exp-{kind}" / "blocklists"
    lists.mkdir()
    (lists / "bad.ip").write_text("10.0.0.1\n")
    (lists / "bad.dn").write_text("unseen.example.com\n")
    (lists / "cert.sha1.csv").write_text("# c\nx,s2,y\n")
    arguments = ["propagate", "--input-dir", f"{inputs}/exp-{kind}", "--cache-dir", f"{inputs}/cache-{kind}", "--out", f"{inputs}/out-{kind}"]
    arguments += ["--output-type", kind]
    main(arguments)
    folder = lambda name: read_pointer(spark, f"{inputs}/out-{kind}")["lists"][name]["folder"]
    if kind == "csv":
        assert (inputs / "out-csv" / folder("bad_ip") / "ip-header.csv").read_text().startswith(":ID,ip,")
    scores = read_scores(spark, f"{inputs}/out-{kind}")
    assert dict(scores["bad_ip"]["ip"].dtypes)["score"] == "double"
    assert set(scores) == {"bad_ip", "cert_sha1_csv"}
    assert set(scores["cert_sha1_csv"]) == {"ip", "domain", "cert"}
    seeds = scores["bad_ip"]["ip"].where("fixed").collect()
    assert [(r.ip, r.score) for r in seeds] == [("10.0.0.1", 1.0)]
    # A list that is added later is scored, and so is one whose content or parameter changed.
    (lists / "late.ip").write_text("10.0.0.4\n")
    (lists / "bad.ip").write_text("10.0.0.2\n")
    before = folder("cert_sha1_csv")
    main(arguments)
    scores = read_scores(spark, f"{inputs}/out-{kind}")
    assert set(scores) == {"bad_ip", "cert_sha1_csv", "late_ip"}
    assert [r.ip for r in scores["bad_ip"]["ip"].where("fixed").collect()] == ["10.0.0.2"]
    assert folder("cert_sha1_csv") == before != folder("bad_ip")
    main([*arguments, "--epsilon", "0.2"])
    assert folder("cert_sha1_csv") != before
    if kind == "csv":
        return
    (lists / "bad.ip").write_text("10.0.0.1\n")
    main([*arguments, "--out", f"{inputs}/out-both", "--bidirectional", "true"])
    both = read_scores(spark, f"{inputs}/out-both")["bad_ip"]["ip"].collect()
    assert {r.ip for r in both} >= {"10.0.0.1", "2001:db8::1", "10.0.0.9"} and all(0 <= r.score <= 1 for r in both)


def test_a_new_scan_replaces_graph_and_scores(spark, inputs):
    build(inputs, "parquet")
    place = f"{inputs}/exp-parquet/tls_graph"
    lists = inputs / "exp-parquet" / "blocklists"
    lists.mkdir()
    (lists / "bad.ip").write_text("10.0.0.4\n10.0.0.7\n")
    arguments = ["propagate", "--input-dir", f"{inputs}/exp-parquet", "--cache-dir", f"{inputs}/cache", "--out", f"{inputs}/out"]
    main(arguments)
    seeds = lambda: {r.ip for r in read_scores(spark, f"{inputs}/out")["bad_ip"]["ip"].where("fixed").collect()}
    assert seeds() == {"10.0.0.4"}
    opened, before = read_graph(spark, place), read_pointer(spark, place)
    build(inputs, "parquet")  # the same inputs
    assert read_pointer(spark, place) == before
    (inputs / "a.ipdomain").write_text("10.0.0.1,www.example.com.\n10.0.0.4,cdn.example.net\n10.0.0.7,new.example.net\n")
    build(inputs, "parquet")
    ips = {r.ip: r.id for r in read_graph(spark, place)["ip"].collect()}
    assert "10.0.0.7" in ips and read_pointer(spark, place) != before
    assert "10.0.0.7" not in {r.ip for r in opened["ip"].collect()}  # a reader that was there before sees what it opened
    ends = read_graph(spark, place)["resolves"].collect()
    assert {r.dst for r in ends} <= set(ips.values())
    main(arguments)  # the list is the same, the graph isn't
    assert seeds() == {"10.0.0.4", "10.0.0.7"}


def test_two_scans_of_a_day_and_one_table_of_certificates(inputs):
    scans = ["--tls-scan", "2024-01-01", f"{inputs}/2024-01-01", "--tls-scan", "2024-01-01", f"{inputs}/2024-01-08"]
    with pytest.raises(SystemExit, match="day"):
        main(["build", "--cache-dir", "c", "--out", "o", "--suffix-list", "s", "--dns-scan", "A", "2024-01-01", "f", *scans]
             + ["--parsed-certs", "2024-01-01", f"{inputs}/decoded"])


def test_ingested_and_direct_tables_agree(spark, inputs):
    tls = [TlsScan(d, f"{inputs}/{d}", f"{inputs}/decoded") for d in ("2024-01-01", "2024-01-08")]
    dns = [DnsScan("A", "2024-01-01", f"{inputs}/a.ipdomain"), DnsScan("A", "2024-01-02", f"{inputs}/a.ipdomain")]
    stored, direct = ingest_scans(spark, tls, dns, f"{inputs}/cache"), scan_tables(spark, tls, dns)
    for name in ("hosts", "http", "certs", "dns"):
        a, b = getattr(stored, name), getattr(direct, name)
        assert Counter(map(str, a.select(b.columns).collect())) == Counter(map(str, b.collect())), name
    assert stored.dns.count() == 6  # one file, two dates
    done = inputs / "cache" / "dns" / "scan_src=A" / "scan_date=2024-01-01" / "source=a.ipdomain"
    before = sorted(p.name for p in done.iterdir())
    more = DnsScan("A", "2024-01-03", f"{inputs}/a.ipdomain")
    assert ingest_scans(spark, tls, [*dns, more], f"{inputs}/cache").dns.count() == 9
    assert sorted(p.name for p in done.iterdir()) == before  # complete scans are not written again
    assert ingest_scans(spark, tls, [more], f"{inputs}/cache").dns.count() == 3  # others are left alone
    with pytest.raises(ValueError, match="same"):
        ingest_scans(spark, tls, [more, more], f"{inputs}/cache")
    (inputs / "2024-01-01" / "http.csv").unlink()
    with pytest.raises(FileNotFoundError):
        tls[0].http(spark)


def test_flatten_dns(spark, tmp_path):
    answers = [{"name": "a.com.", "type": "CNAME", "data": "b.com."}, {"name": "b.com.", "type": "AAAA", "data": "::1"}]
    (tmp_path / "in.json").write_text(json.dumps({"name": "a.com.", "data": {"answers": answers}}) + "\n")
    main(["flatten-dns", "--output", f"{tmp_path}/out", f"{tmp_path}/in.json"])
    text = "".join(p.read_text() for p in (tmp_path / "out" / "type=AAAA").glob("part*"))
    assert sorted(text.split()) == ["::1,a.com", "::1,b.com"]


@pytest.mark.parametrize("name", ["names=A.ipdomain", "a#b%c.ipdomain", "a'b c.ipdomain"])
def test_scans_with_odd_names_are_found_again(spark, tmp_path, name):
    (tmp_path / name).write_text("10.0.0.1,a.example.com\n10.0.0.2,b.example.com\n")
    scan = DnsScan("A", "2024-01-01", f"{tmp_path}/{name}")
    for _ in range(2):
        assert ingest_scans(spark, [], [scan], f"{tmp_path}/cache").dns.count() == 2


def test_changed_and_emptied_scans_are_read_again(spark, tmp_path):
    file = tmp_path / "a.ipdomain"
    scan = DnsScan("A", "2024-01-01", str(file))
    for text, rows in (("10.0.0.1,a.com\n", 1), ("10.0.0.1,a.com\n10.0.0.2,bb.com\n", 2), ("", 0)):
        file.write_text(text)
        assert ingest_scans(spark, [], [scan], f"{tmp_path}/cache").dns.count() == rows


def test_one_large_file_is_written_by_several_tasks(spark, tmp_path):
    with gzip.open(tmp_path / "a.ipdomain.gz", "wt") as out:
        out.writelines(f"10.0.{i // 250 % 250}.{i % 250},host{i * 7919}.example.com\n" for i in range(200_000))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500k")
    try:
        scan = DnsScan("A", "2024-01-01", f"{tmp_path}/a.ipdomain.gz")
        assert ingest_scans(spark, [], [scan], f"{tmp_path}/cache").dns.count() == 200_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "cache" / "dns").rglob("part*.parquet"))) > 1
