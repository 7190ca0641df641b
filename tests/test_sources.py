import csv
import gzip
import json
import random
from datetime import date
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scangraph.sources.blocklists import Blocklist, list_members, listed_vertices
from scangraph.sources.csv_records import csv_records, quoted_lines
from scangraph.sources.graph_files import Graph, graph_state, header_field, join_list, read_graph, split_list, read_graph_csv, write_graph, write_graph_csv, write_typed_edges
from scangraph.sources.resolver import flatten_answers, read_resolver_lines
from scangraph.sources.scans import (
    CERTS_PARSED_SCHEMA,
    HOSTS_COLUMNS,
    HOSTS_SCHEMA,
    DnsScan,
    find_file,
    load_cert_chain,
    load_csv,
    load_http,
    load_parsed_certs,
)
from scangraph.sources.snapshots import read_pointer
from scangraph.storage import Workspace, checkpoint_dir, content_fingerprint, fingerprint, is_complete, list_names


def test_csv_quotes_lines_and_malformed_rows(spark, tmp_path):
    header = ",".join(c.split()[0] for c in HOSTS_SCHEMA.split(", "))
    rows = [
        '1,1.1.1.1,443,"a ""quoted"" name",0,0,0,772,,,"two\nlines",9,hash,,1,,,,',
        "x,1.1.1.2,443,b.com,0,0,0,772,,,,9,hash,,1,,,,",
        "3,1.1.1.3,443,c.com,0,0,0,772,,,,9,hash,,bad,,,,",
        "4,1.1.1.4,bad,d.com,0,0,0,772,,,,9,hash,,0,,,,",
    ]
    file = tmp_path / "hosts.csv"
    file.write_text("\n".join([header, *rows]) + "\n")
    df = load_csv(spark, str(file), HOSTS_SCHEMA)
    (row,) = df.collect()
    assert (row.id, row.server_name, row.error_data, row.cert_valid) == (1, 'a "quoted" name', "two\nlines", 1)
    assert df.select("ip").count() == df.count() == 1  # the same rows whatever is selected
    kept = load_csv(spark, str(file), HOSTS_SCHEMA, HOSTS_COLUMNS)  # a bad port does not matter here
    assert sorted(r.ip for r in kept.select("ip").collect()) == ["1.1.1.1", "1.1.1.4"]


PIECES = ["a", 'b"', "\n", "\r\n", ",", "é", "", "#", " ", '""', "\\", '"\n"', "\n\n"]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_values_with_line_breaks_are_read_by_many_tasks(spark, tmp_path, ending):
    rng = random.Random(7)
    value = lambda: "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 8)))
    rows = [[str(i), value(), value()] for i in range(4000)]
    rows.insert(2000, ["5000", "line\n" * 3000, ""])  # a value over several splits
    (tmp_path / "t").mkdir()
    for name, own in (("x.csv", rows[:2500]), ("y.csv", rows[2500:]), ("empty.csv", [])):
        with open(tmp_path / "t" / name, "w", newline="") as out:
            writer = csv.writer(out, lineterminator=ending)
            writer.writerow(["id", "a", "b"])
            for i, row in enumerate(own):
                writer.writerow(row)
                if i % 50 == 9:
                    writer.writerow([] if i % 100 == 9 else ["1", "too", "many", "values"])
    expected = {r[0]: (r[1] or None, r[2] or None) for r in rows}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert quoted_lines(spark, f"{tmp_path}/t").rdd.getNumPartitions() > 10
        found = load_csv(spark, f"{tmp_path}/t", "id STRING, a STRING, b STRING").collect()
        named = load_csv(spark, f"{tmp_path}/t").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(found) == len(named) == len(rows)
    assert {r.id: (r.a, r.b) for r in found} == {r.id: (r.a, r.b) for r in named} == expected
    lenient = load_csv(spark, f"{tmp_path}/t", "id STRING, a STRING, b STRING", ["id", "a"])
    assert lenient.where("a = 'too'").count() == sum(len(r) and i % 100 == 59 for own in (rows[:2500], rows[2500:]) for i, r in enumerate(own))
    with pytest.raises(ValueError, match="header"):
        load_csv(spark, f"{tmp_path}/t", "id STRING, a STRING, c STRING")


def test_lines_of_csv_are_not_shuffled(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,a\n1,"x\ny"\n')
    found = csv_records(spark, f"{tmp_path}/x.csv")
    assert sorted((r.number, r.record) for r in found.collect()) == [(1, "id,a"), (2, '1,"x\ny"')]
    nodes = found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    ).split("\n\n")
    shuffles = [n for n in nodes if "Exchange" in n.split("\n")[0] and "Input" in n]
    assert shuffles and not any("value#" in n for n in shuffles)


def test_file_variants(spark, tmp_path):
    (tmp_path / "a.csv.zst").write_text("")
    (tmp_path / "b.csv.xz").write_text("")
    (tmp_path / "b.csv.zst").write_text("")
    assert find_file(spark, f"{tmp_path}/a.csv").endswith("a.csv.zst")
    assert find_file(spark, f"{tmp_path}/b.csv").endswith("b.csv.zst")
    with pytest.raises(FileNotFoundError):
        find_file(spark, f"{tmp_path}/c.csv")
    with pytest.raises(FileNotFoundError):
        load_csv(spark, f"{tmp_path}/c.csv")
    with pytest.raises(ValueError, match="xz"):
        load_csv(spark, f"{tmp_path}/b.csv.xz")


def test_compressed_csv(spark, tmp_path):
    import zstandard

    (tmp_path / "a.csv.zst").write_bytes(zstandard.compress(b"1.1.1.1,a.com\n"))
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"1.1.1.1,a.com\n"))
    for name in ("a.csv.zst", "a.csv.gz"):
        df = DnsScan("A", "2024-02-29", str(tmp_path / name)).pairs(spark)
        assert [tuple(r) for r in df.collect()] == [("1.1.1.1", "a.com")]


def test_header_typed_files(spark, tmp_path):
    (tmp_path / "http.csv").write_text('Server,id,Location\nx,1,"https://a.com/?a=1,2"\ny,bad,/\n')
    assert {tuple(r) for r in load_http(spark, f"{tmp_path}/http.csv").collect()} == {
        (1, "https://a.com/?a=1,2"),
        (None, "/"),
    }
    (tmp_path / "cert_chain.csv").write_text("host_id,id,chain_complete\n5,99,1\n6,98,x\n")
    rows = load_cert_chain(spark, f"{tmp_path}/cert_chain.csv").select("id", "chain_complete").collect()
    assert {tuple(r) for r in rows} == {(5, 1), (6, None)}


def test_parsed_certs(spark, tmp_path):
    (tmp_path / "certs.csv").write_text('1,s1,s256,,,CN=a,CN=b,t0,t1,true,false,key,1,"[""a.com""]"\n')
    (row,) = load_parsed_certs(spark, f"{tmp_path}/certs.csv").collect()
    assert (row.sha1, row.isCa, row.numAltNames, row.altNames) == ("s1", False, 1, '["a.com"]')
    df = load_csv(spark, f"{tmp_path}/certs.csv", CERTS_PARSED_SCHEMA, header=False)
    df.write.parquet(f"{tmp_path}/certs")
    assert load_parsed_certs(spark, f"{tmp_path}/certs").collect() == [row]


def test_scan_dates_must_be_iso():
    with pytest.raises(ValueError):
        DnsScan("A", "29.02.2024", "x")


def test_blocklists(spark, tmp_path):
    (tmp_path / "feodo.ip.csv").write_text("# c\nfirst_seen,dst_ip,port\n2024,1.1.1.1,443\n2024,1.1.1.1,80\n")
    (tmp_path / "sslbl.sha1.csv").write_text("# c\n2024,aabb,x\n2024,ccdd,y\n")
    (tmp_path / "names.dn").write_text("a.com\nb.com\na.com\n")
    cases = {
        "feodo.ip.csv": ("ip", "ip", {"1.1.1.1"}),
        "sslbl.sha1.csv": ("sha1", "cert", {"aabb", "ccdd"}),
        "names.dn": ("domain_name", "domain", {"a.com", "b.com"}),
    }
    for name, (column, table, listed) in cases.items():
        blocklist = Blocklist(str(tmp_path / name))
        assert (blocklist.column, blocklist.vertex_table) == (column, table)
        rows = blocklist.read(spark).collect()
        assert len(rows) == len(listed) and {r[column] for r in rows} == listed
    assert Blocklist("x/a.ip.sha1.csv").column == "sha1"  # the last kind that fits
    assert Blocklist("x/zip.txt", kind="dn").column == "domain_name"
    with pytest.raises(ValueError):
        Blocklist("x/other.txt").read(spark)


def write_some_lists(folder, count):
    folder.mkdir()
    for i in range(count):
        (folder / f"plain {i}%.ip").write_text(f"10.0.0.{i}\n10.0.0.1\n\n10.0.0.1\n")
        (folder / f"c{i}.ip.csv").write_text(f'# 10.0.0.9\n"a, b",10.0.0.{i + 1}\n#x,10.0.0.9\nalone\n')
        (folder / f"feodo{i}.sha1.csv").write_text(f"# c\nseen,sha1,more\nx,s{i},1\nx,s{i},2\n")
    (folder / "parts.dn.csv").mkdir()
    for i in range(3):
        (folder / "parts.dn.csv" / f"part-{i}.csv").write_text(f"x,{'abc'[i]}.com\nx,a.com\n")
    (folder / "empty.dn").write_text("")
    (folder / "empty.sha1.csv").write_text("")
    return [Blocklist(f"{folder}/{name}") for name in sorted(p.name for p in folder.iterdir())]


def test_many_lists_are_read_together(spark, tmp_path):
    lists = write_some_lists(tmp_path / "lists", 4)
    kinds = {"ip": ("ip", [f"10.0.0.{i}" for i in range(12)]), "cert": ("sha1", [f"s{i}" for i in range(6)])}
    kinds["domain"] = ("domain_name", ["a.com", "b.com", "d.com"])
    vertices = {k: spark.createDataFrame(list(enumerate(v)), f"id long, {c} string") for k, (c, v) in kinds.items()}
    found = [tuple(r) for r in listed_vertices(spark, lists, vertices).collect()]
    assert len(found) == len(set(found))
    expected = set()
    for i in range(4):
        expected |= {(f"plain {i}%_ip", i), (f"plain {i}%_ip", 1), (f"c{i}_ip_csv", i + 1), (f"feodo{i}_sha1_csv", i)}
    assert set(found) == expected | {("parts_dn_csv", 0), ("parts_dn_csv", 1)}
    # The same as one by one.
    for blocklist in lists:
        if blocklist.file_name != "empty.sha1.csv":  # a single empty file has no columns to infer
            rows = blocklist.read(spark).join(vertices[blocklist.vertex_table], blocklist.column).collect()
            assert {(blocklist.name, r.id) for r in rows} == {f for f in found if f[0] == blocklist.name}
    own = [b for b in lists if b.vertex_table == "ip"]
    (row,) = list_members(spark, own).where("indicator = '10.0.0.1'").collect()
    assert [own[c].name for c in row.codes] == ["c0_ip_csv", *(f"plain {i}%_ip" for i in range(4))]
    assert listed_vertices(spark, [], vertices).collect() == []


def test_joins_do_not_grow_with_the_number_of_lists(spark, tmp_path):
    vertices = {k: spark.createDataFrame([], f"id long, {c} string") for k, c in (("ip", "ip"), ("cert", "sha1"), ("domain", "domain_name"))}
    plans = []
    for count in (2, 40):
        lists = write_some_lists(tmp_path / f"lists{count}", count)
        plan = listed_vertices(spark, lists, vertices)._jdf.queryExecution().optimizedPlan().toString()
        plans.append((plan.count("Join Inner"), plan.count("Relation [")))
        # One join with the vertices for each kind; the others give a row the number and the name of its list.
        assert plan.count("Join Inner, (ip#") + plan.count("Join Inner, (sha1#") + plan.count("Join Inner, (domain_name#") == 3
    assert plans[0] == plans[1]


RELATION = "src long, dst long, scan_dates array<date>, valid boolean, scan_src array<string>"


def sample_graph(spark):
    day = date(2024, 2, 29)
    return Graph(
        vertices={
            "ip": spark.createDataFrame([(0, "1.1.1.1", 1, 0)], "id long, ip string, inDegree long, outDegree long"),
            "cert": spark.createDataFrame([(1, 'O="x", y', True, None)], "id long, subject string, isCa boolean, numAltNames long"),
        },
        relations={
            "resolves": spark.createDataFrame([(0, 1, [day, day], None, ["A", "B"]), (1, 0, [day], True, [])], RELATION),
            "deployed_on": spark.createDataFrame([(1, 0)], "src long, dst long"),
        },
    )


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_graph_round_trip(spark, tmp_path, kind):
    graph = sample_graph(spark)
    write_graph(graph, f"{tmp_path}/g", kind)
    again = read_graph(spark, f"{tmp_path}/g")
    for name in ("ip", "cert", "resolves", "deployed_on"):
        assert again[name].dtypes == graph[name].dtypes, name
        assert sorted(again[name].collect(), key=str) == sorted(graph[name].collect(), key=str), name
    assert set(read_graph(spark, f"{tmp_path}/g", bidirectional=True).relations) == {"resolves"}
    with pytest.raises(KeyError):
        again["nothing"]
    with pytest.raises(ValueError):
        write_graph(graph, f"{tmp_path}/g", "xml")


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_a_graph_is_replaced_when_its_rows_change(spark, tmp_path, kind):
    graph, place = sample_graph(spark), f"{tmp_path}/g"
    assert write_graph(graph, place, kind)
    first = read_pointer(spark, place)
    assert not write_graph(graph, place, kind) and read_pointer(spark, place) == first
    edges = spark.createDataFrame([(1, 0), (0, 1)], "src long, dst long")
    other = Graph(graph.vertices, {**graph.relations, "deployed_on": edges})
    opened = read_graph(spark, place)
    assert write_graph(other, place, kind)
    assert sorted(read_graph(spark, place)["deployed_on"].collect()) == [(0, 1), (1, 0)]
    assert [tuple(r) for r in opened["deployed_on"].collect()] == [(1, 0)]  # a reader of the one before can finish
    assert write_graph(other, place, kind, overwrite=True) and write_graph(graph, place, kind, made_from="these inputs")
    assert not write_graph(other, place, kind, made_from="these inputs")  # told by the caller, rows aren't compared
    folders = [p.name for p in (tmp_path / "g").iterdir() if p.is_dir()]
    assert len(folders) == 2 and first["folder"] not in folders


def test_a_failed_write_leaves_the_graph(spark, tmp_path):
    graph, place = sample_graph(spark), f"{tmp_path}/g"
    write_graph(graph, place)
    broken = spark.createDataFrame([(1, 0)], "src long, dst long").withColumn("x", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        write_graph(Graph(graph.vertices, {**graph.relations, "deployed_on": broken}), place, made_from="x")
    again = read_graph(spark, place)
    assert [tuple(r) for r in again["deployed_on"].collect()] == [(1, 0)] and set(again.vertices) == {"ip", "cert"}
    assert write_graph(graph, place, made_from="y")
    assert len([p for p in (tmp_path / "g").iterdir() if p.is_dir()]) == 2  # the broken one is gone


def test_tables_without_a_pointer_are_read_where_they_lie(spark, tmp_path):
    graph = sample_graph(spark)
    graph["ip"].write.parquet(f"{tmp_path}/ip.vertex")
    graph["deployed_on"].write.parquet(f"{tmp_path}/deployed_on.relation")
    assert set(read_graph(spark, str(tmp_path)).relations) == {"deployed_on"}
    before = graph_state(spark, str(tmp_path))
    assert before == graph_state(spark, str(tmp_path))
    graph["ip"].write.mode("append").parquet(f"{tmp_path}/ip.vertex")
    assert before != graph_state(spark, str(tmp_path))


def test_content_decides(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, None), (2, None, None)], "x long, y string, z array<int>")
    same = content_fingerprint(df.repartition(3).orderBy("y"))
    assert content_fingerprint(df) == same
    for other in (df.distinct(), df.withColumnRenamed("y", "w"), df.withColumn("x", F.col("x") + 1), df.limit(0)):
        assert content_fingerprint(other) != same


def test_typed_edges_are_written_once_each(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, "a"), (1, 2, "a"), (1, 2, "b")], "src long, dst long, type string")
    write_typed_edges(edges, f"{tmp_path}/relations")
    rows = spark.read.parquet(f"{tmp_path}/relations").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 2, "a"), (1, 2, "b")]


def test_csv_with_header_line(spark, tmp_path):
    file = tmp_path / "resolves.relation.csv"
    file.write_text(":START_ID,:END_ID,scan_date:date[],valid:boolean,scan_src:string[]\n1,2,2024-01-01;2024-01-02,,A;B\n3,4,,true,\n")
    rows = read_graph_csv(spark, str(file)).orderBy("src").collect()
    assert [tuple(r) for r in rows] == [
        (1, 2, [date(2024, 1, 1), date(2024, 1, 2)], None, ["A", "B"]),
        (3, 4, [], True, []),
    ]
    assert set(read_graph(spark, str(tmp_path)).relations) == {"resolves"}


def test_list_cells_are_reversible(spark):
    lists = [[], [""], ["", ""], ["a;b", "\\"], ["\\s", "\\b;", "\\\\s;;"], ["\\e"], ["plain", "http://a/?b=%3B"], [";"], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i long, v array<string>")
    rows = df.select("i", join_list(F.col("v")).alias("cell")).select("i", "cell", split_list(F.col("cell")).alias("v"))
    found = {r.i: (r.cell, r.v) for r in rows.collect()}
    assert [found[i][1] for i in range(len(lists))] == [v or [] for v in lists]
    assert found[6][0] == "plain;http://a/?b=%3B" and all((c or "").count(";") == max(0, len(v) - 1) for c, v in found.values())


def test_header_dialect(spark, tmp_path):
    columns = ["id", "src", "dst", "scan_date", "scan_dates", "locations", "isCa", "inDegree", "subject"]
    assert [header_field(c) for c in columns] == [
        ":ID", ":START_ID", ":END_ID", "scan_date:date", "scan_date:date[]", "locations:string[]", "isCa:boolean",
        "inDegree:int", "subject",
    ]
    write_graph_csv(spark.createDataFrame([(1, ["a", "b"])], "id long, locations array<string>"), f"{tmp_path}/x")
    assert (tmp_path / "x-header.csv").read_text() == ":ID,locations:string[]\n"
    assert "".join(p.read_text() for p in (tmp_path / "x").glob("part*")) == "1,a;b\n"


def test_resolver_file(spark, tmp_path):
    answer = {"name": "a.com.", "type": "A", "data": "1.1.1.1"}
    (tmp_path / "answers.json").write_text(json.dumps({"name": "a.com.", "data": {"answers": [answer]}}) + "\nbroken\n")
    rows = flatten_answers(read_resolver_lines(spark, f"{tmp_path}/answers.json")).collect()
    assert [tuple(r) for r in rows] == [("1.1.1.1", "a.com", "A")]


def test_workspace(spark, work):
    df = spark.range(5).withColumn("k", F.col("id") % 2)
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir") and work.root.startswith(checkpoint_dir(spark))
    assert work.write(df, "t").count() == 5
    assert work.write(df.limit(1), "t").count() == 1
    assert Workspace(spark, work.root, resume=True).write(df, "t").count() == 1
    assert fingerprint("a", 1) != fingerprint("a", 2)
    assert work.write(df, "parted", partition_by="k").where("k = 1").count() == 2
    assert is_complete(spark, work.path("parted")) and list_names(spark, work.path("parted")) == ["k=0", "k=1"]
    work.delete("parted")
    assert not is_complete(spark, work.path("parted"))
    assert Workspace.fresh(spark).root != work.root


def test_checkpoint_folder_without_setting():
    def session(master):
        context = SimpleNamespace(master=master, applicationId=f"app-{master}")
        return SimpleNamespace(conf={}, sparkContext=context)

    folder = checkpoint_dir(session("local[2]"))
    assert Path(folder).is_dir() and checkpoint_dir(session("local[2]")) == folder
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session("yarn"))
