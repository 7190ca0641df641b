from datetime import date

import pytest
from pyspark.sql import functions as F

from scangraph.operators import entities, relations
from scangraph.operators.degrees import degrees, finish_vertices, mirror, undirected_degrees, vertex_union
from workload.rules import suffix_rules

D1, D2 = date(2024, 1, 1), date(2024, 1, 2)
HOSTS = "id int, ip string, server_name string, error_data string, cert_hash string, cert_valid int, scan_date date"


def pairs(df):
    return sorted((r["from"], r["to"]) for r in df.collect())


def test_merge_observations_and_id_lookup(spark):
    seen = spark.createDataFrame(
        [
            ("d_a", "ip_1", None, "A", D2),
            ("d_a", "ip_1", True, None, D1),
            ("d_a", "ip_1", False, "AAAA", D1),
            ("d_a", "ip_x", True, None, D1),
            ("d_b", "ip_1", None, None, D1),
            (None, "ip_1", True, "A", D1),
        ],
        "from string, to string, valid boolean, scan_src string, scan_date date",
    )
    ids = spark.createDataFrame([("d_a", 0), ("d_b", 1), ("ip_1", 2)], "guid string, id long")
    merged = relations.merge_observations(seen)
    assert ("d_a", "ip_x") in pairs(merged)
    rows = {(r.src, r.dst): r for r in relations.attach_ids(merged, ids).collect()}
    assert set(rows) == {(0, 2), (1, 2)}
    first, second = rows[0, 2], rows[1, 2]
    assert (first.scan_dates, first.valid, first.scan_src) == ([D1, D2], True, ["A", "AAAA"])
    assert (second.scan_dates, second.valid, second.scan_src) == ([D1], None, [])


def test_unbounded_values_are_rows_and_lists_only_on_request(spark):
    urls = [("d_a", "d_b", f"u{i % 5}", True, D1) for i in range(20)] + [("d_a", "d_c", None, False, D2)]
    seen = spark.createDataFrame(urls, "from string, to string, location string, valid boolean, scan_date date")
    plain = {r.to: r for r in relations.merge_observations(seen).collect()}
    assert "locations" not in plain["d_b"] and plain["d_b"].scan_dates == [D1] and plain["d_c"].valid is False
    listed = {r.to: r.locations for r in relations.merge_observations(seen, ("locations",)).collect()}
    assert listed == {"d_b": [f"u{i}" for i in range(5)], "d_c": []}
    rows = relations.edge_values(seen, "location").collect()
    assert sorted((r.to, r.location) for r in rows) == [("d_b", f"u{i}") for i in range(5)]


def test_hub_is_split_in_the_id_lookup(spark, work):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    other = F.concat(F.lit("ip_"), F.col("id"))
    hub = F.when(F.col("id") % 3 == 0, "d_hub").otherwise(F.concat(F.lit("d_"), F.col("id")))
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        edges = spark.range(60000, numPartitions=8).select(hub.alias("from"), other.alias("to"))
        ids = edges.select(F.inline(F.array(F.struct(F.col("from").alias("guid")), F.struct(F.col("to").alias("guid"))))).distinct()
        ids = work.write(ids.select("guid", F.xxhash64("guid").alias("id")), "ids")
        joined = relations.attach_ids(edges, ids)
        assert len(joined.collect()) == 60000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_merge_without_dates_is_distinct(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", None)], "from string, to string")
    assert pairs(relations.merge_observations(df)) == [("a", "b")]


def test_hot_edge_combines_before_the_shuffle(spark):
    hosts = spark.createDataFrame([(1, "1.1.1.1", "a.com", None, "c", 1, D1)], HOSTS)
    plan = relations.merge_observations(relations.returns(hosts))._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_set" in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize(
    "cert,error,returned,deployed",
    [
        ("x", None, True, True),
        ("x", "timeout", True, True),
        ("x", "x: invalid signature by the server certificate", True, False),
        (None, None, False, False),
        (None, "timeout", False, False),
    ],
)
def test_possession(spark, cert, error, returned, deployed):
    hosts = spark.createDataFrame([(1, "1.1.1.1", "a.com.", error, cert, None, D1)], HOSTS)
    got = relations.merge_observations(relations.returns(hosts))
    assert pairs(got) == ([("ip_1.1.1.1", "c_x")] if returned else [])
    got = relations.merge_observations(relations.deployed_on(hosts))
    assert pairs(got) == ([("c_x", "ip_1.1.1.1")] if deployed else [])


def test_alternative_names_are_routed(spark):
    names = {
        "a" * 64: '["a.com","1.2.3.4","b.com.",null]',
        "b" * 64: "null",
        "c" * 64: None,
        "d" * 64: "{broken",
        "e" * 64: '{"a":1}',
        "f": '["short.com"]',
    }
    certs = spark.createDataFrame(list(names.items()), "sha256 string, altNames string")
    rows = entities.san_entries(entities.clean_certs(certs)).collect()
    assert {(r.domain_name, r.ip) for r in rows} == {("a.com", None), (None, "1.2.3.4"), ("b.com.", None), (None, None)}
    contained = relations.merge_observations(relations.contains(entities.san_entries(entities.clean_certs(certs))))
    key = "c_" + "a" * 64
    assert pairs(contained) == [(key, "d_a.com"), (key, "d_b.com."), (key, "ip_1.2.3.4")]


def test_redirects_join_on_source_when_present(spark):
    rules = suffix_rules(spark)
    hosts = spark.createDataFrame(
        [(1, "1.1.1.1", "a.com", None, None, 1, D1, "s1"), (1, "1.1.1.2", "b.com", None, None, 0, D1, "s2"),
         (2, "1.1.1.3", None, None, None, 1, D1, "s1")],
        HOSTS + ", source string",
    )
    http = spark.createDataFrame(
        [(1, "https://x.org/é", D1, "s1"), (1, "/relative", D1, "s2"), (2, "https://y.org", D1, "s1")],
        "id int, location string, scan_date date, source string",
    )
    rows = relations.redirects(http, hosts, rules).collect()
    assert [(r["from"], r["to"], r.location, r.valid) for r in rows] == [
        ("d_a.com", "d_x.org", "https://x.org/%C3%A9", True)
    ]


def test_hierarchy_gives_vertices_and_parents(spark):
    names = spark.createDataFrame([("*.a.b.com",), ("c.b.com",), ("no_domain",), ("x.*.*.com",)], "domain_name string")
    rows = entities.domain_hierarchy(names, suffix_rules(spark)).collect()
    assert {(r.domain_name, r.parent) for r in rows} == {
        ("*.a.b.com", "a.b.com"),
        ("a.b.com", "b.com"),
        ("c.b.com", "b.com"),
        ("b.com", None),
        ("x.*.*.com", "*.*.com"),
        ("*.*.com", None),
        ("*.com", None),
    }


def test_degrees_count_kinds_separately(spark):
    edges = relations.typed_union(
        {
            "redirects": spark.createDataFrame([(1, 2)], "src long, dst long"),
            "parent_domain": spark.createDataFrame([(1, 2)], "src long, dst long"),
            "returns": spark.createDataFrame([(3, 2)], "src long, dst long"),
        }
    )
    got = {r.id: (r.inDegree, r.outDegree) for r in degrees(edges).collect()}
    assert got == {1: (0, 2), 2: (3, 0), 3: (0, 1)}
    assert {r.id: r.degree for r in undirected_degrees(edges).collect()} == {1: 2, 2: 3, 3: 1}
    assert sorted(tuple(r) for r in mirror(edges).collect()) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    vertices = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("c", "z")], "guid string, ip string")
    ids = spark.createDataFrame([("a", 1), ("b", 9)], "guid string, id long")
    done = finish_vertices(vertices, ids, degrees(edges))
    assert sorted(tuple(r) for r in done.collect()) == [(1, "x", 0, 2), (9, "y", 0, 0)]


def test_vertex_union_fills_missing_degrees(spark):
    a = spark.createDataFrame([(1, None, 2)], "id long, inDegree long, outDegree long")
    b = spark.createDataFrame([(2, 5)], "id long, inDegree long")
    assert sorted(tuple(r) for r in vertex_union({"a": a, "b": b}).collect()) == [(1, 0, 2), (2, 5, 0)]


def test_reverse_valid(spark):
    df = spark.createDataFrame(
        [(1, 2, True, [D1]), (3, 4, False, []), (5, 6, None, [])], "src long, dst long, valid boolean, scan_dates array<date>"
    )
    assert [tuple(r) for r in relations.reverse_valid(df).collect()] == [(2, 1, [D1])]
    assert relations.reverse_valid(df.drop("scan_dates")).columns == ["src", "dst"]


def test_certificates_take_the_largest_attributes(spark):
    rows = [("g", "s", "h", "a", "i", "n", "m", None, True, 1), ("g", "s", "h", "b", "i", "n", "m", False, None, 3)]
    schema = "guid string, sha1 string, sha256 string, subject string, issuer string, notBefore string, notAfter string, basicConstraints boolean, isCa boolean, numAltNames int"
    (row,) = entities.certificates(spark.createDataFrame(rows, schema)).collect()
    assert (row.subject, row.basicConstraints, row.isCa, row.numAltNames) == ("b", False, True, 3)
