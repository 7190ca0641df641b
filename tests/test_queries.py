from pathlib import Path

import pytest
from compare import connect, difference

import __spark_entry__ as contract
from workload import queries, sql, views

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sql.ALL)
def test_query_matches_sql(spark, con, name):
    assert difference(contract.queries()[name](spark, SF_DIR), con, contract.oracle_sql()[name]) is None


def test_every_query_of_the_workload_is_checked():
    assert set(queries.ALL) == set(sql.ALL)


def test_the_unrolled_rounds_are_enough(con):
    rows = con.execute(sql.ALL["rounds_changed"]).fetchall()
    last = {name: (n, changed) for name, n, changed in sorted(rows)}
    assert last and all(changed == 0 and n < sql.CONVERGED for n, changed in last.values())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and all(0 < r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.fixed} == {1.0}


def test_views_use_whole_tables(spark):
    events, pages = (views.table(spark, SF_DIR, n).count() for n in ("events", "pages"))
    s = views.scans(spark, SF_DIR)
    assert s.hosts.count() == s.http.count() == events and s.certs.count() == pages and s.dns.count() == 2 * pages


def test_stored_scans_are_read_without_being_derived_again(spark, work):
    stored, derived = views.stored_scans(spark, SF_DIR, work), views.scans(spark, SF_DIR)
    for name in ("hosts", "http", "certs", "dns"):
        assert getattr(stored, name).dtypes == getattr(derived, name).dtypes
        assert getattr(stored, name).exceptAll(getattr(derived, name)).isEmpty()
        assert getattr(stored, name).count() == getattr(derived, name).count()
        assert "Join" not in getattr(stored, name)._jdf.queryExecution().toString()


def test_lists_hold_all_events(spark, con):
    assert views.list_rows(spark, SF_DIR).count() == views.table(spark, SF_DIR, "events").count()
    listed = views.blocklists(spark, SF_DIR)
    n = con.execute("select count(*) from pages").fetchone()[0]
    count = lambda kind, value: con.execute(f"select count(distinct {value}) from events where event_type = '{kind}'").fetchone()[0]
    assert listed["sha1"].count() == count("purchase", f"user_id % {n}")
    assert listed["domain_name"].count() <= count("signup", f"event_id % {n}") > 0
