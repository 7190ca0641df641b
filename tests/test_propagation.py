import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scangraph.operators import propagation
from scangraph.operators.degrees import kind_masks, mask_degrees
from scangraph.operators.propagation import (
    bucket_count,
    changed_counts,
    distinct_edges,
    find_hubs,
    initial_state,
    mutual_messages,
    next_state,
    prepare_topology,
    propagate,
    scores_by_kind,
    senders,
    store_messages,
)
from scangraph.storage import Workspace, buckets_trusted, list_names, write_text

EDGES = [(0, 3), (0, 4), (1, 3), (2, 4), (3, 0), (3, 1), (4, 0), (4, 2), (5, 1)]
DEGREES = {0: 2, 1: 1, 2: 1, 3: 2, 4: 2, 5: 1}
ROUNDS = {
    2: {0: 0.5, 2: 1.0, 3: 0.25, 4: 1.0},
    3: {0: 0.5, 1: 0.25, 2: 1.0, 3: 0.25, 4: 1.0},
    100: {0: 0.5, 1: 0.25, 2: 1.0, 3: 0.25, 4: 1.0, 5: 0.25},
}


def frames(spark, edges, degrees, seeds):
    return (
        spark.createDataFrame(list(degrees.items()), "id long, outDegree long"),
        spark.createDataFrame(edges, "src long, dst long"),
        spark.createDataFrame(seeds, "experiment string, id long"),
    )


def scores(df):
    found = defaultdict(dict)
    for r in df.collect():
        found[r.experiment][r.id] = r.score
    return dict(found)


def by_definition(edges, degrees, seeds, epsilon, max_iter):
    """The scores of one experiment, edge by edge."""
    edges = set(edges)
    state, old, last = {s: 1.0 for s in seeds}, {s: 0.0 for s in seeds}, {}
    for _ in range(max_iter):
        if not any(v is not None and abs(v - old.get(k, 0.0)) >= epsilon for k, v in state.items()):
            break
        messages = {}
        for u, v in edges:
            if state.get(v) is None:
                continue
            message = state[v]
            if v not in seeds and (v, u) in last and degrees.get(v, 0) > 0:
                message -= last[(v, u)] / degrees[v]
            messages[(u, v)] = message
        sums = defaultdict(float)
        for (u, _), m in messages.items():
            sums[u] += m
        following = {}
        for u in set(state) | set(sums):
            mean = sums[u] / degrees[u] if u in sums and degrees.get(u, 0) > 0 else None
            following[u] = 1.0 if u in seeds else mean
        old = {k: (state.get(k) or 0.0) for k in following}
        state, last = following, messages
    return state


def assert_close(actual, expected):
    assert set(actual) == set(expected)
    for key, value in expected.items():
        assert (actual[key] is None and value is None) or actual[key] == pytest.approx(value, abs=1e-9), key


@pytest.mark.parametrize("rounds", ROUNDS)
def test_known_trace(spark, rounds):
    got = propagate(spark, *frames(spark, EDGES, DEGREES, [("a", 4)]), epsilon=0.01, max_iter=rounds)
    assert_close(scores(got)["a"], ROUNDS[rounds])


def test_experiments_together_equal_separate_runs(spark):
    got = propagate(spark, *frames(spark, EDGES, DEGREES, [("a", 4), ("b", 1), ("b", 1)]), epsilon=0.01)
    assert_close(scores(got)["a"], ROUNDS[100])
    assert_close(scores(got)["b"], {0: 0.25, 1: 1.0, 2: 0.125, 3: 0.5, 4: 0.125, 5: 1.0})
    assert {(r.experiment, r.id) for r in got.where("fixed").collect()} == {("a", 4), ("b", 1)}


def random_graph(seed, n=60, m=260):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    edges += [(v, u) for u, v in edges[: m // 2]]  # mutual edges
    edges += [(i, 0) for i in range(n)] + [(0, i) for i in range(0, n, 2)]  # a hub, and a self-loop
    degrees = defaultdict(int)
    for u, _ in edges:  # parallel edges count in the stored degree
        degrees[u] += 1
    degrees[7] = 0  # reached, but never scored
    del degrees[8]  # no vertex
    seeds = {"one": {3}, "many": set(rng.sample(range(10, n), 6)), "hub": {0}}
    return edges, degrees, seeds


@pytest.mark.parametrize("edges_per_split,epsilon,max_iter", [(1_000_000, 0.0, 3), (7, 0.0, 4), (7, 0.02, 100)])
def test_random_graph_matches_definition(spark, edges_per_split, epsilon, max_iter):
    edges, degrees, seeds = random_graph(5)
    rows = [(name, s) for name, ids in seeds.items() for s in ids]
    got = scores(
        propagate(
            spark,
            *frames(spark, edges, degrees, rows),
            epsilon=epsilon,
            max_iter=max_iter,
            edges_per_split=edges_per_split,
            buckets=3,
        )
    )
    for name, ids in seeds.items():
        assert_close(got[name], by_definition(edges, degrees, ids, epsilon, max_iter))


@pytest.mark.parametrize("edges_per_split,epsilon,max_iter", [(1_000_000, 0.0, 4), (7, 0.02, 100)])
def test_changes_give_the_same_scores(spark, edges_per_split, epsilon, max_iter):
    edges, degrees, seeds = random_graph(5)
    rows = [(name, s) for name, ids in seeds.items() for s in ids]
    settings = {"epsilon": epsilon, "max_iter": max_iter, "edges_per_split": edges_per_split, "buckets": 3}
    got = scores(propagate(spark, *frames(spark, edges, degrees, rows), **settings, only_changes=True))
    for name, ids in seeds.items():
        assert_close(got[name], by_definition(edges, degrees, ids, epsilon, max_iter))


def test_changes_of_experiments_that_stop_at_different_rounds(spark):
    chain = [(i, i + 1) for i in range(9)] + [(i + 1, i) for i in range(9)] + [(20, 21), (21, 20)]
    degrees = {v: sum(u == v for u, _ in chain) for v in {v for e in chain for v in e}}
    inputs = frames(spark, chain, degrees, [("long", 0), ("short", 20)])
    got = propagate(spark, *inputs, epsilon=0.001, only_changes=True)
    assert got.count() == got.select("experiment", "id").distinct().count()
    for name, seed in (("long", 0), ("short", 20)):
        assert_close(scores(got)[name], by_definition(chain, degrees, {seed}, 0.001, 100))


def test_changes_sent_follow_the_frontier(spark, monkeypatch):
    # A chain in both directions, and many vertices that point at its end and settle at once.
    chain = [(i, i + 1) for i in range(12)] + [(i + 1, i) for i in range(12)]
    edges = chain + [(100 + i, 12) for i in range(300)]
    degrees = {v: sum(u == v for u, _ in edges) for v in {v for e in edges for v in e}}
    sent = {True: [], False: []}
    for only in (True, False):
        name = "next_state_of_changes" if only else "next_state"
        plain = getattr(propagation, name)

        def counted(state, oneway, mutual, plain=plain, own=sent[only]):
            own.append(oneway.count() + mutual.count())
            return plain(state, oneway, mutual)

        monkeypatch.setattr(propagation, name, counted)
        inputs = frames(spark, edges, degrees, [("a", 12)])
        got = scores(propagate(spark, *inputs, epsilon=0.0, max_iter=7, only_changes=only, buckets=2))
        assert_close(got["a"], by_definition(edges, degrees, {12}, 0.0, 7))
    assert min(sent[False]) > 300 and max(sent[True][1:]) < 30 < sent[True][0]


def test_bidirectional_uses_distinct_neighbours(spark):
    edges = [(0, 1), (1, 0), (1, 2), (1, 2), (3, 1)]
    mirrored = {(u, v) for a, b in edges for u, v in ((a, b), (b, a))}
    neighbours = {v: len([1 for u, _ in mirrored if u == v]) for v in range(5)}
    got = propagate(
        spark, *frames(spark, edges, {v: 9 for v in range(5)}, [("a", 0)]), epsilon=0.0, max_iter=5, bidirectional=True
    )
    assert_close(scores(got)["a"], by_definition(mirrored, neighbours, {0}, 0.0, 5))


def test_distinct_degree(spark):
    edges, _, seeds = random_graph(6)
    distinct = set(edges)
    neighbours = {v: len([1 for u, _ in distinct if u == v]) for v in range(60)}
    inputs = frames(spark, edges, {v: 99 for v in range(60)}, [("many", s) for s in seeds["many"]])
    got = scores(propagate(spark, *inputs, epsilon=0.0, max_iter=4, degree="distinct"))
    assert_close(got["many"], by_definition(distinct, neighbours, seeds["many"], 0.0, 4))
    with pytest.raises(ValueError, match="degree"):
        propagate(spark, *inputs, degree="other")


def test_degrees_from_masks(spark):
    rng = random.Random(2)
    kinds = ["a", "b", "c"]
    rows = [(rng.randrange(6), rng.randrange(6), rng.choice([*kinds, "d"])) for _ in range(60)] + [(None, 1, "a"), (1, 1, None)]
    masks = kind_masks(spark.createDataFrame(rows, "src long, dst long, type string"), kinds)
    found = {r.id: r.asDict() for r in mask_degrees(masks, kinds, {"all": kinds, "bc": ["b", "c"], "none": []}).collect()}
    edges = {r for r in rows if None not in r and r[2] in kinds}
    assert set(found) == {v for s, d, _ in edges for v in (s, d)}
    for v, row in found.items():
        for name, own in {"all": kinds, "bc": ["b", "c"], "none": []}.items():
            out = [(d, k) for s, d, k in edges if s == v and k in own]
            into = [(s, k) for s, d, k in edges if d == v and k in own]
            assert row[f"{name}Out"] == len(out) and row[f"{name}In"] == len(into)
            assert row[f"{name}DistinctOut"] == len({d for d, _ in out}) and row[f"{name}DistinctIn"] == len({s for s, _ in into})
    plan = mask_degrees(masks, kinds, {"all": kinds})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_scores_by_kind_with_labels(spark):
    vertices = spark.createDataFrame([(1, "1.1.1.1"), (2, "2.2.2.2")], "id long, ip string")
    found = spark.createDataFrame([("a", 1, 0.5, False)], "experiment string, id long, score double, fixed boolean")
    labels = spark.createDataFrame([(1, "bad"), (2, "good")], "id long, evaluation string")
    (row,) = scores_by_kind(vertices, found, labels).collect()
    assert (row.ip, row.score, row.evaluation) == ("1.1.1.1", 0.5, "bad")
    assert "evaluation" not in scores_by_kind(vertices, found).columns


def test_buckets_follow_the_size_of_the_graph():
    assert [bucket_count(n, 200) for n in (0, 10, 1_000_000, 10**8, 10**12)] == [1, 1, 10, 200, 100_000]
    assert bucket_count(10**12, 200, 5_000) == 5_000


def test_too_many_experiments_are_refused(spark, monkeypatch):
    monkeypatch.setattr("scangraph.operators.propagation.MAX_EXPERIMENTS", 1)
    with pytest.raises(ValueError, match="experiments"):
        propagate(spark, *frames(spark, EDGES, DEGREES, [("a", 4), ("b", 1)]))


def test_no_seeds_give_no_scores(spark):
    got = propagate(spark, *frames(spark, EDGES, DEGREES, []))
    assert got.count() == 0 and got.columns == ["experiment", "id", "score", "fixed"]


def test_distinct_edges_flag_mutual_ones(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 1), (4, 4), (None, 1)], "src long, dst long")
    assert sorted(tuple(r) for r in distinct_edges(df).collect()) == [
        (1, 2, True),
        (2, 1, True),
        (3, 1, False),
        (4, 4, True),
    ]


def test_hubs_are_bounded_and_split(spark):
    edges = spark.range(1000).select(F.col("id").alias("src"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("dst"))
    hubs = {r.id: r.splits for r in find_hubs(edges, 1000, 100).collect()}
    assert hubs == {0: 4}
    assert find_hubs(edges, 1000, 400).count() == 0


def test_rounds_neither_shuffle_nor_sort_edges(spark, work):
    vertices, edges, seeds = frames(spark, EDGES, DEGREES, [("a", 4)])
    topology = prepare_topology(vertices, edges, work, edges_per_split=1, buckets=2)
    state = work.write(initial_state(seeds, vertices), "state")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with buckets_trusted(spark):
            sent = senders(state, topology.hubs)
            oneway = sent.join(topology.oneway, ["dst", "salt"])._jdf.queryExecution().executedPlan().toString()
            first = store_messages(mutual_messages(sent, topology, None), topology, work, "messages")
            second = mutual_messages(sent, topology, first)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Only the scores are shuffled. The edges are sorted in their files.
    assert oneway.count("Exchange hashpartitioning") == 1 and oneway.count("Sort [") == 1
    assert second.count("Exchange hashpartitioning") == 1 and second.count("Bucketed: true") == 2
    work.forget_tables()


def test_sum_of_messages_combines_before_the_shuffle(spark):
    state = spark.createDataFrame([("a", 1, 1.0, 0.0, True, 1)], "experiment string, id long, score double, old_score double, fixed boolean, out_degree long")
    messages = spark.createDataFrame([("a", 2, 1, 1, 0.5)], "experiment string, src long, dst long, src_degree long, message double")
    plan = next_state(state, messages, messages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan


class Stop(Exception):
    pass


def stopping_at(last, rounds):
    def on_round(step):
        rounds.append(step)
        if step == last:
            raise Stop

    return on_round


def test_a_stopped_run_goes_on(spark, work):
    edges, degrees, seeds = random_graph(9)
    rows = [(name, s) for name, ids in seeds.items() for s in ids]
    inputs, settings = frames(spark, edges, degrees, rows), {"epsilon": 0.02, "edges_per_split": 7, "buckets": 3}
    whole, report, rounds = scores(propagate(spark, *inputs, **settings)), [], []
    resumed = lambda: Workspace(spark, work.root, resume=True)
    for last in (1, 3):
        with pytest.raises(Stop):
            propagate(spark, *inputs, **settings, work=resumed(), on_round=stopping_at(last, rounds))
    # A cut-off entry and half a table of the next round are no harm.
    write_text(spark, work.path("_rounds/round-000004.json"), '{"run": "')
    spark.range(3).write.parquet(work.path("state-4"))
    got = propagate(spark, *inputs, **settings, work=resumed(), on_round=rounds.append, report=report)
    for name in seeds:
        assert_close(scores(got)[name], whole[name])
    last = max(step for _, step, _ in report)
    assert rounds == list(range(1, last + 1))  # no round was run twice
    again = []
    assert scores(propagate(spark, *inputs, **settings, work=resumed(), on_round=rounds.append, report=again)) == scores(got)
    assert again == report and len(rounds) == last
    assert set(list_names(spark, work.root)) == {"scores"}
    # Other edges, seeds or parameters make another run.
    more = propagate(spark, *frames(spark, [*edges, (11, 3)], degrees, rows), **settings, work=resumed(), on_round=rounds.append)
    assert more.count() and rounds[last] == 1
    before = len(rounds)
    propagate(spark, *inputs, **{**settings, "epsilon": 0.5}, work=resumed(), on_round=rounds.append)
    assert len(rounds) > before and rounds[before] == 1


def test_a_failed_run_leaves_nothing_unless_it_may_be_resumed(spark, work):
    with pytest.raises(Stop):
        propagate(spark, *frames(spark, EDGES, DEGREES, [("a", 4)]), work=work, on_round=stopping_at(1, []))
    assert list_names(spark, work.root) == [] and not [t.name for t in spark.catalog.listTables() if t.name.startswith("scangraph_")]


@pytest.mark.parametrize("observed", [200, 1])
def test_moved_vertices_are_counted_without_a_job_of_their_own(spark, work, observed, monkeypatch):
    monkeypatch.setattr("scangraph.operators.propagation.MAX_OBSERVED", observed)
    counted = []
    monkeypatch.setattr("scangraph.operators.propagation.changed_counts", lambda *a: counted.append(1) or changed_counts(*a))
    report = []
    propagate(spark, *frames(spark, EDGES, DEGREES, [("a", 4), ("b", 1)]), epsilon=0.01, report=report)
    rounds = len({step for _, step, _ in report})
    assert len(counted) == (0 if observed == 200 else rounds)
    assert [(e, s, c) for e, s, c in report if s < 3] == [
        ("a", 0, 1), ("b", 0, 1), ("a", 1, 2), ("b", 1, 2), ("a", 2, 1), ("b", 2, 1),
    ]
