from pyspark.sql import functions as F
import pytest

from scangraph.functions.addresses import is_ip
from scangraph.functions.names import is_domain
from scangraph.functions.suffixes import SuffixRules, parent_domain, with_domain_chain, with_location_host
from scangraph.functions.urls import sanitize_url


def values(spark, inputs, expression):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", expression(F.col("v")).alias("out"))
    return [r.out for r in df.orderBy("i").collect()]


@pytest.fixture(scope="module")
def rules(spark):
    return SuffixRules.of(spark, ["com", "org", "uk", "co.uk", "io", "*.ck", "!www.ck", "de", "公司.cn"], ["github.io"])


CHAINS = {
    "www.a.example.co.uk": ["www.a.example.co.uk", "a.example.co.uk", "example.co.uk"],
    "*.example.com": ["*.example.com", "example.com"],
    "x.y.org": ["x.y.org", "y.org"],
    "foo.github.io": ["foo.github.io"],
    "github.io": [],
    "co.uk": [],
    "Foo.COM": ["Foo.COM"],
    "a.b.unknowntld": ["a.b.unknowntld", "b.unknowntld"],
    "a.b.foo.ck": ["a.b.foo.ck", "b.foo.ck"],
    "foo.ck": [],
    "www.ck": ["www.ck"],
    "a.www.ck": ["a.www.ck", "www.ck"],
    "a.ü.de": ["a.ü.de", "ü.de"],
    "a.xn--55qx5d.cn": ["a.xn--55qx5d.cn"],
    None: None,
    "1.2.3.4": None,
    "localhost": None,
    "a_.b": None,
    "a..com": None,
    "example.com.": None,
    "ü" * 70 + ".de": None,
}


def test_domain_chain_and_parent(spark, rules):
    df = spark.createDataFrame([(k,) for k in CHAINS], "name string")
    rows = with_domain_chain(df, "name", rules).select("name", "chain", parent_domain(F.col("chain")).alias("p"))
    for r in rows.collect():
        expected = CHAINS[r.name]
        assert r.chain == expected, r.name
        assert r.p == (expected[1] if expected and len(expected) > 1 else None)


def test_domain_chain_does_not_shuffle_or_use_python(spark, rules):
    df = spark.createDataFrame([("a.com",)], "name string")
    plan = with_domain_chain(df, "name", rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "SortMergeJoin" not in plan
    assert "ArrowEval" not in plan and "BatchEval" not in plan


def test_rules_from_file(spark, tmp_path):
    file = tmp_path / "list.dat"
    file.write_text(
        "// a comment\n// ===BEGIN ICANN DOMAINS===\ncom\n*.ck\n!www.ck\n\n// ===END ICANN DOMAINS===\n"
        "// ===BEGIN PRIVATE DOMAINS===\ngithub.io\n// ===END PRIVATE DOMAINS===\n"
    )
    rules = SuffixRules.from_file(spark, str(file))
    assert rules.depth == 2
    assert {tuple(r) for r in rules.table.collect()} == {("com", 1, 1), ("ck", 2, 2), ("www.ck", 4, 4), ("github.io", 0, 1)}


def test_long_names_are_checked_whole(spark):
    assert values(spark, ["a." * 20000 + "com", "a." * 20000 + "c_"], is_domain) == [True, False]


def test_valid_addresses(spark):
    good = "1.2.3.4 01.2.3.4 ::1 2001:db8::1 1:2 1:2:3:4:5:6:7:8 ::ffff:1.2.3.4 1:10000 : ::1.2.3.4 0a:000ffff".split()
    assert all(values(spark, good, is_ip))


def test_invalid_addresses(spark):
    bad = "256.1.1.1 1.2.3 a.b :: 1:: 1:2:3:4:5:6:7:8:9 1:10001 x:1 example.com 1.2.3.4.5 1:2:3:4:5:6:7:1.2.3.4 1::2::3".split()
    assert not any(values(spark, [*bad, "", None], is_ip))


def test_sanitize_url(spark):
    cases = {
        "http://a.b/c d?x=1&y=%20": "http://a.b/c%20d?x=1&y=%2520",
        "http://ü.de/é#f": "http://%C3%BC.de/%C3%A9%23f",
        "x/😀;a": "x/%F0%9F%98%80%3Ba",
        "a+b*c~d_e-f.g": "a%2Bb%2Ac~d_e-f.g",
        "%2F%7E": "%252F%257E",
        "": "",
        None: "",
    }
    assert values(spark, list(cases), sanitize_url) == list(cases.values())


def test_location_host(spark, rules):
    cases = {
        "https://login.example.org/a b?x=1": "login.example.org",
        "http://user:pw@A.example.com:8080/x": "A.example.com",
        "//cdn.example.com/x": "cdn.example.com",
        "www.example.com/path": "www.example.com",
        "https://example.com.": "example.com",
        "https://foo.github.io/": "foo.github.io",
        "https://github.io/": "github.io",
        "/relative/path": None,
        "index.php": None,
        "https://1.2.3.4/": None,
        "https://co.uk/": None,
        "https://a.unknowntld/": None,
        "https://exa mple.com/": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    got = {r.url: r.host for r in with_location_host(df, "url", rules, "host").collect()}
    assert got == cases
