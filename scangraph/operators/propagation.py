"""Probabilistic threat propagation.

A seed has score 1. In every round a vertex takes the mean score of the vertices it points to, less
what these owe to the vertex itself: along an edge u -> v the sender v passes on its score without the
share that came over v -> u in the round before.

How the rounds are laid out:

* The edges are static. They are written once, bucketed and sorted by the sender that is looked up, so
  a round shuffles the scores, which are small, and never the edges.
* A vertex with very many incoming edges is split: its edges are spread over several buckets by a
  salt, and its score is sent to each of them.
* Only edges that exist in both directions can echo. Just these keep their message for the next round.
  It is sent to the place of its receiver once, where it is summed up now and subtracted next time.
* The old state joins the sum of messages as further rows of one aggregation, which replaces an outer
  join, and the out-degree travels with the edge, which replaces a lookup per round.
* All blocklists run together under the key ``experiment``; one that has converged is set aside.
* State and messages are written to the shared folder every round; only per-experiment counts reach
  the driver. They are observed while the state is written, unless there are very many experiments.
* In a workspace that may be resumed, every round is logged once its tables are complete, and a run that was
  stopped goes on with the first round that is not, if edges, vertices, seeds and parameters are the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scangraph.functions.suffixes import union_all
from scangraph.operators.degrees import mirror, with_degrees
from scangraph.operators.round_log import RoundLog
from scangraph.storage import Workspace, buckets_trusted, content_fingerprint, fingerprint, list_names, path_exists

MAX_HUBS = 100_000
EDGES_PER_SPLIT = 1_000_000
MAX_EXPERIMENTS = 10_000
# Up to so many experiments are counted while the state is written; more are counted from the written state.
MAX_OBSERVED = 200
MIN_BUCKET, MAX_BUCKET = 100_000, 2_000_000  # edges
_KEY, _BACK = ["dst", "salt"], ["src", "back"]
_OWN_TABLES = ("mirrored", "seeds", "edges", "hubs", "topology")


@dataclass(frozen=True)
class Topology:
    """Static side of a propagation.

    ``oneway`` and ``mutual`` have ``src, dst, salt, back, src_degree`` and are bucketed by ``dst, salt``.
    ``src, back`` is the place of the reverse edge. ``hubs`` has ``id, splits`` for the at most MAX_HUBS
    vertices whose incoming edges are spread.
    """

    oneway: DataFrame
    mutual: DataFrame
    hubs: DataFrame
    buckets: int


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` with a flag for edges that exist in both directions.

    Both directions of a pair meet in one group, so no self-join is needed.
    """
    low, high = F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")
    known = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    pairs = known.groupBy(low, high).agg(
        F.bool_or(F.col("src") <= F.col("dst")).alias("up"), F.bool_or(F.col("src") > F.col("dst")).alias("down")
    )
    mutual = (F.col("up") & F.col("down")) | (F.col("low") == F.col("high"))
    up = F.struct(F.col("low").alias("src"), F.col("high").alias("dst"), mutual.alias("mutual"))
    down = F.struct(F.col("high").alias("src"), F.col("low").alias("dst"), mutual.alias("mutual"))
    both = F.when(F.col("up") & F.col("down"), F.array(up, down)).when(F.col("up"), F.array(up)).otherwise(F.array(down))
    return pairs.select(F.inline(both))


def find_hubs(edges: DataFrame, n_edges: int, edges_per_split: int = EDGES_PER_SPLIT) -> DataFrame:
    """Vertices with more than one split of incoming edges, as ``id, splits``.

    At most n/x vertices can have more than x of n edges. The split size grows with the graph, so that
    the table never has more than MAX_HUBS rows and may be broadcast.
    """
    size = max(edges_per_split, math.ceil(n_edges / MAX_HUBS), 1)
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > size).select("id", F.ceil(F.col("n") / size).cast("int").alias("splits"))


def bucket_count(n_edges: int, partitions: int, most: int = 100_000) -> int:
    """Buckets for a graph: as many as there are shuffle partitions, unless these are far off its size.

    Spark refuses more than ``most``; beyond that the buckets grow.
    """
    return min(max(math.ceil(n_edges / MAX_BUCKET), min(partitions, math.ceil(n_edges / MIN_BUCKET)), 1), most)


def prepare_topology(
    vertices: DataFrame,
    edges: DataFrame,
    work: Workspace,
    edges_per_split: int = EDGES_PER_SPLIT,
    buckets: int | None = None,
) -> Topology:
    """Write the distinct edges, bucketed, with both salts and the receiver's out-degree."""
    flat = work.write(distinct_edges(edges), "edges")
    n_edges = flat.count()
    settings = ("spark.sql.shuffle.partitions", "spark.sql.sources.bucketing.maxBuckets")
    buckets = buckets or bucket_count(n_edges, *(int(work.spark.conf.get(s)) for s in settings))
    hubs = work.write(find_hubs(flat, n_edges, edges_per_split), "hubs")
    degree = vertices.select(F.col("id").alias("src"), F.col("outDegree").cast("long").alias("src_degree"))
    full = flat.join(degree, "src", "left")
    for end, other, salt in (("dst", "src", "salt"), ("src", "dst", "back")):
        spread = F.broadcast(hubs.select(F.col("id").alias(end), "splits"))
        place = F.pmod(F.xxhash64(other), F.coalesce(F.col("splits"), F.lit(1))).cast("int")
        full = full.join(spread, end, "left").withColumn(salt, place).drop("splits")
    full = full.select("src", "dst", "salt", "back", "src_degree", "mutual")
    work.write_bucketed(full, "topology", buckets, _KEY, partition_by="mutual")
    return _stored_topology(work, buckets)


def _stored_topology(work: Workspace, buckets: int) -> Topology:
    """The topology in the tables of ``prepare_topology``."""
    stored = work.read_bucketed("topology", buckets, _KEY, partition_by=("mutual", "boolean"))
    columns = ["src", "dst", "salt", "back", "src_degree"]
    return Topology(
        oneway=stored.where(~F.col("mutual")).select(*columns),
        mutual=stored.where(F.col("mutual")).select(*columns),
        hubs=work.read("hubs"),
        buckets=buckets,
    )


def seed_vertices(blocklist: DataFrame, vertices: DataFrame, column: str) -> DataFrame:
    """Ids of the vertices whose ``column`` is listed."""
    return blocklist.select(column).distinct().join(vertices.select("id", column), column).select("id")


def number_experiments(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds with a number in place of the experiment, and the names as ``code, experiment``.

    Every message carries its experiment, so it should be short. There is one name per blocklist; more
    than MAX_EXPERIMENTS of them are refused.
    """
    names = sorted(row.experiment for row in seeds.select("experiment").distinct().take(MAX_EXPERIMENTS + 1))
    if len(names) > MAX_EXPERIMENTS:
        raise ValueError(f"more than {MAX_EXPERIMENTS} experiments; run them in several calls")
    codes = seeds.sparkSession.createDataFrame(list(enumerate(names)), "code int, experiment string")
    numbered = seeds.join(F.broadcast(codes), "experiment")
    return numbered.select(F.col("code").alias("experiment"), "id"), codes


def initial_state(seeds: DataFrame, vertices: DataFrame) -> DataFrame:
    """Score 1 for every seed of every experiment."""
    degree = vertices.select("id", F.col("outDegree").cast("long").alias("out_degree"))
    state = seeds.join(degree, "id", "left")
    return state.select(
        "experiment",
        "id",
        F.lit(1.0).alias("score"),
        F.lit(0.0).alias("old_score"),
        F.lit(True).alias("fixed"),
        "out_degree",
    )


def senders(state: DataFrame, hubs: DataFrame) -> DataFrame:
    """Scored vertices, one row per split of their incoming edges."""
    spread = state.where(F.col("score").isNotNull()).join(F.broadcast(hubs), "id", "left")
    last = F.coalesce(F.col("splits"), F.lit(1)) - 1
    salts = F.sequence(F.lit(0), last)
    return spread.select(
        "experiment", F.col("id").alias("dst"), F.explode(salts).alias("salt"), "score", "fixed", "out_degree"
    )


def mutual_messages(sent: DataFrame, topology: Topology, previous: DataFrame | None) -> DataFrame:
    """Messages along edges in both directions, less the echo of the round before.

    ``previous`` is bucketed by the place of its receivers, which is where the reverse edges are.
    """
    messages = sent.join(topology.mutual, _KEY)
    message = F.col("score")
    if previous is not None:
        echo = previous.select(
            F.col("src").alias("dst"),
            F.col("back").alias("salt"),
            F.col("dst").alias("src"),
            "experiment",
            F.col("message").alias("echo"),
        )
        messages = messages.join(echo, [*_KEY, "src", "experiment"], "left")
        owes = ~F.coalesce(F.col("fixed"), F.lit(False)) & F.col("echo").isNotNull() & (F.col("out_degree") > 0)
        message = F.when(owes, message - F.col("echo") / F.col("out_degree")).otherwise(message)
    return messages.select("experiment", "src", "back", "dst", "src_degree", message.alias("message"))


def store_messages(messages: DataFrame, topology: Topology, work: Workspace, name: str) -> DataFrame:
    """Send messages to the place of their receivers."""
    return work.write_bucketed(messages, name, topology.buckets, _BACK, ordered=False)


def next_state(state: DataFrame, oneway: DataFrame, mutual: DataFrame) -> DataFrame:
    """Fold old state and new messages into the scores of the next round."""
    received = [
        m.select(
            "experiment",
            F.col("src").alias("id"),
            "message",
            F.lit(None).cast("double").alias("old_score"),
            F.lit(None).cast("boolean").alias("fixed"),
            F.col("src_degree").alias("out_degree"),
        )
        for m in (oneway, mutual)
    ]
    kept = state.select(
        "experiment", "id", F.lit(None).cast("double").alias("message"), F.col("score").alias("old_score"), "fixed", "out_degree"
    )
    merged = (
        union_all([*received, kept])
        .groupBy("experiment", "id")
        .agg(
            F.sum("message").alias("total"),
            F.max("old_score").alias("old_score"),
            F.max("fixed").alias("fixed"),
            F.max("out_degree").alias("out_degree"),
        )
    )
    mean = F.when(F.col("out_degree") > 0, F.col("total") / F.col("out_degree"))
    score = F.when(F.coalesce(F.col("fixed"), F.lit(False)), F.lit(1.0)).otherwise(mean)
    return merged.select(
        "experiment", "id", score.alias("score"), F.coalesce("old_score", F.lit(0.0)).alias("old_score"), "fixed", "out_degree"
    )


def changed_senders(state: DataFrame, hubs: DataFrame) -> DataFrame:
    """``senders`` whose score is not the one that their neighbours have; ``score`` is what it changed by."""
    new = F.coalesce("known", F.lit(False))
    moved = state.where(F.col("score").isNotNull() & (~new | (F.col("score") != F.col("old_score"))))
    change = moved.withColumn("score", F.col("score") - F.col("old_score")).withColumn("first", ~new)
    spread = change.join(F.broadcast(hubs), "id", "left")
    salts = F.sequence(F.lit(0), F.coalesce(F.col("splits"), F.lit(1)) - 1)
    return spread.select("experiment", F.col("id").alias("dst"), F.explode(salts).alias("salt"), "score", "first")


def mutual_changes(
    changed: DataFrame, fixed: DataFrame, topology: Topology, previous: DataFrame | None
) -> DataFrame:
    """What messages along edges in both directions change by, where they do.

    A message is a score less the echo, so its change is the score's less the echo's share of the change of the
    message before. ``fixed`` are the senders that owe nothing. The first message along an edge counts even if it is 0.
    """
    columns = ["experiment", "src", "back", "dst", "src_degree"]
    changes = changed.join(topology.mutual, _KEY).select(*columns, F.col("score").alias("message"), "first")
    if previous is not None:
        echo = previous.where(F.col("src_degree") > 0).select(
            F.col("src").alias("dst"),
            F.col("back").alias("salt"),
            F.col("dst").alias("src"),
            "experiment",
            (-F.col("message") / F.col("src_degree")).alias("message"),
        )
        owed = echo.join(fixed.select("experiment", *_KEY), ["experiment", *_KEY], "left_anti")
        owed = owed.join(topology.mutual, [*_KEY, "src"]).select(*columns, "message", F.lit(False).alias("first"))
        changes = changes.unionByName(owed)
    summed = changes.groupBy(*columns).agg(F.sum("message").alias("message"), F.max("first").alias("first"))
    return summed.where(F.col("first") | (F.col("message") != 0))


def next_state_of_changes(state: DataFrame, oneway: DataFrame, mutual: DataFrame) -> DataFrame:
    """``next_state`` from sums of messages that are kept, and what messages changed by."""
    none = {"old_score": "double", "fixed": "boolean", "known": "boolean"}
    received = [
        m.select(
            "experiment",
            F.col("src").alias("id"),
            "message",
            *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()],
            F.col("src_degree").alias("out_degree"),
        )
        for m in (oneway, mutual)
    ]
    known = F.col("score").isNotNull().alias("known")
    kept = state.select(
        "experiment", "id", F.col("total").alias("message"), F.col("score").alias("old_score"), "fixed", known, "out_degree"
    )
    most = [F.max(c).alias(c) for c in ("old_score", "fixed", "known", "out_degree")]
    merged = union_all([*received, kept]).groupBy("experiment", "id").agg(F.sum("message").alias("total"), *most)
    mean = F.when(F.col("out_degree") > 0, F.col("total") / F.col("out_degree"))
    score = F.when(F.coalesce(F.col("fixed"), F.lit(False)), F.lit(1.0)).otherwise(mean)
    old = F.coalesce("old_score", F.lit(0.0)).alias("old_score")
    return merged.select("experiment", "id", score.alias("score"), old, "fixed", "out_degree", "total", "known")


def _moved(epsilon: float) -> Column:
    return F.abs(F.col("score") - F.col("old_score")) >= epsilon


def changed_counts(state: DataFrame, epsilon: float) -> DataFrame:
    """Number of vertices per experiment whose score moved by ``epsilon`` or more."""
    return state.groupBy("experiment").agg(F.count_if(_moved(epsilon)).alias("changed"))


def write_counted(
    state: DataFrame, codes: list[int], epsilon: float, work: Workspace, name: str
) -> tuple[DataFrame, dict[int, int]]:
    """Write a state, and the number of vertices that moved for each of its experiments.

    The numbers are observed on the rows as they are written, so that they need no job of their own.
    """
    if len(codes) > MAX_OBSERVED:
        stored = work.write(state, name)
        counts = {row.experiment: row.changed for row in changed_counts(stored, epsilon).collect()}  # one row per blocklist
        return stored, {code: counts.get(code, 0) for code in codes}
    seen = Observation()
    counted = [F.count_if((F.col("experiment") == code) & _moved(epsilon)).alias(f"n{code}") for code in codes]
    stored = work.write(state.observe(seen, *counted) if counted else state, name)
    return stored, {code: seen.get[f"n{code}"] for code in codes}


@dataclass
class _Rounds:
    """Where a propagation stands before round ``step``.

    ``changed`` has the experiments of the state in table ``state`` that still move or have just stopped;
    ``finished`` names tables with those that stopped before.
    """

    step: int
    state: str
    changed: dict[int, int]
    finished: list[tuple[str, list[int]]]
    history: list[tuple[int, int, int]]

    @classmethod
    def of(cls, entry: dict) -> _Rounds:
        changed = {int(code): n for code, n in entry["changed"].items()}
        finished = [(name, codes) for name, codes in entry["finished"]]
        return cls(entry["step"], entry["state"], changed, finished, [tuple(h) for h in entry["history"]])

    def log(self, log: RoundLog, buckets: int) -> None:
        facts = {"state": self.state, "changed": self.changed, "finished": self.finished, "history": self.history}
        log.add(self.step, buckets=buckets, **facts)


def _run_rounds(
    topology: Topology,
    at: _Rounds,
    epsilon: float,
    max_iter: int,
    work: Workspace,
    log: RoundLog,
    on_round: Callable[[int], None] | None,
    only_changes: bool = False,
) -> tuple[list[DataFrame], list[tuple[int, int, int]]]:
    """Final states, each experiment in exactly one of them, and (experiment, round, changed) of all rounds."""
    messages = None
    if at.step > 0:
        messages = work.read_bucketed(f"messages-{at.step - 1}", topology.buckets, _BACK, ordered=False)
    while at.step < max_iter:
        step, state = at.step, work.read(at.state)
        done = [code for code, n in at.changed.items() if n == 0]
        moving = [code for code, n in at.changed.items() if n]
        if not moving:
            break
        active, finished = state, at.finished
        if done:
            finished = [*finished, (at.state, done)]
            active = state.where(~F.col("experiment").isin(done))

        if only_changes:
            sent = changed_senders(active, topology.hubs)
            fixed = senders(active.where("fixed"), topology.hubs)
            # Experiments that stopped in the round before have messages in it, too.
            own = None if messages is None else messages.where(F.col("experiment").isin(moving))
            made, following_state = mutual_changes(sent, fixed, topology, own), next_state_of_changes
        else:
            sent = senders(active, topology.hubs)
            made, following_state = mutual_messages(sent, topology, messages), next_state
        mutual = store_messages(made, topology, work, f"messages-{step}")
        oneway = sent.join(topology.oneway, _KEY)
        oneway = oneway.select("experiment", "src", "src_degree", F.col("score").alias("message"))
        following = f"state-{step + 1}"
        work.delete(following)  # left by a run that was stopped
        _, changed = write_counted(following_state(active, oneway, mutual), moving, epsilon, work, following)
        history = [*at.history, *((code, step + 1, n) for code, n in changed.items())]
        before, at = at, _Rounds(step + 1, following, changed, finished, history)
        at.log(log, topology.buckets)

        # Both tables are complete now, so what they were made from is no longer needed.
        if step > 0:
            work.delete(f"messages-{step - 1}")
        if not done:
            work.delete(before.state)
        messages = mutual
        if on_round:
            on_round(step + 1)
    finished = [work.read(name).where(F.col("experiment").isin(codes)) for name, codes in at.finished]
    return [df.select("experiment", "id", "score", "fixed") for df in (*finished, work.read(at.state))], at.history


def propagate(
    spark: SparkSession,
    vertices: DataFrame,
    edges: DataFrame,
    seeds: DataFrame,
    epsilon: float = 0.01,
    max_iter: int = 100,
    bidirectional: bool = False,
    degree: str = "parallel",
    only_changes: bool = False,
    work: Workspace | None = None,
    edges_per_split: int = EDGES_PER_SPLIT,
    buckets: int | None = None,
    report: list[tuple[str, int, int]] | None = None,
    on_round: Callable[[int], None] | None = None,
) -> DataFrame:
    """Scores of all reached vertices as ``experiment, id, score, fixed``.

    ``vertices``: ``id, outDegree``; ``edges``: ``src, dst``; ``seeds``: ``experiment, id``. An
    experiment stops when no score moves by ``epsilon`` or more, at the latest after ``max_iter``
    rounds, so results equal those of separate runs. Vertices that were reached without being seeds
    have ``fixed`` false.

    ``bidirectional`` mirrors every edge and divides by the number of distinct neighbours. ``degree="distinct"`` does
    the latter for directed edges too, in place of ``outDegree``, which counts parallel edges: the shares that a
    vertex takes then add up to 1.

    With ``only_changes`` a round sends what messages changed by, and only where they did: sums of messages are kept with
    the scores. Rounds get cheaper as scores settle; sums may differ in the last digits, so a score that should be 0
    may be next to it.

    ``report`` is filled with (experiment, round, number of vertices that moved by ``epsilon`` or more). An
    experiment whose last number is not 0 had not converged by ``max_iter``.

    ``on_round`` is called with the number of every round that is complete. What it raises stops the run. In a
    ``work`` with ``resume``, a stopped run keeps its tables, and the next call with the same inputs goes on
    behind its last complete round; a call with other inputs deletes them and starts anew.
    """
    if degree not in ("parallel", "distinct"):
        raise ValueError(f"unknown degree {degree}")
    work = work or Workspace.fresh(spark)
    run = None
    if work.resume:
        inputs = ((vertices, ["id", "outDegree"]), (edges, ["src", "dst"]), (seeds, ["experiment", "id"]))
        contents = [content_fingerprint(df.select(*columns), *columns) for df, columns in inputs]
        run = fingerprint(*contents, epsilon, max_iter, bidirectional, degree, only_changes, edges_per_split, buckets)
    log = RoundLog(work, run)
    entry = log.last()
    if entry and entry.get("complete"):
        if report is not None:
            report += [tuple(h) for h in entry["named"]]
        return work.read("scores")
    if entry is None:
        _delete_own(work, "scores")
        log.clear()
    complete = False
    try:
        if entry is None:
            if bidirectional:
                edges = work.write(mirror(edges), "mirrored")
                vertices = neighbour_degrees(vertices, edges)
            elif degree == "distinct":
                edges = work.write(edges.select("src", "dst").dropna().distinct(), "mirrored")
                vertices = neighbour_degrees(vertices, edges)
            vertices = vertices.select("id", "outDegree").distinct()
            coded, codes = number_experiments(work.write(seeds.select("experiment", "id").distinct(), "seeds"))
            topology = prepare_topology(vertices, edges, work, edges_per_split, buckets)
            every = [row.code for row in codes.collect()]
            start = initial_state(coded, vertices)
            if only_changes:
                start = start.withColumns({"total": F.lit(None).cast("double"), "known": F.lit(False)})
            _, changed = write_counted(start, every, epsilon, work, "state-0")
            at = _Rounds(0, "state-0", changed, [], [(code, 0, n) for code, n in changed.items()])
            at.log(log, topology.buckets)
        else:
            _, codes = number_experiments(work.read("seeds"))
            topology, at = _stored_topology(work, entry["buckets"]), _Rounds.of(entry)
        with buckets_trusted(spark):
            finished, history = _run_rounds(topology, at, epsilon, max_iter, work, log, on_round, only_changes)
        names = {row.code: row.experiment for row in codes.collect()}
        named = [(names[code], step, changed) for code, step, changed in history]
        if report is not None:
            report += named
        scored = union_all(finished).withColumnRenamed("experiment", "code").join(F.broadcast(codes), "code")
        fixed = F.coalesce("fixed", F.lit(False)).alias("fixed")
        work.delete("scores")
        scores = work.write(scored.select("experiment", "id", "score", fixed), "scores")
        log.add(max_iter + 1, complete=True, named=named)
        complete = True
        return scores
    finally:
        # A failed run leaves no catalogue entries, and no files either unless it may be resumed.
        work.forget_tables()
        if complete or run is None:
            _delete_own(work)


def _delete_own(work: Workspace, *more: str) -> None:
    """Delete the tables of a propagation, but for its result."""
    if path_exists(work.spark, work.root):
        for name in list_names(work.spark, work.root):
            if name in (*_OWN_TABLES, *more) or name.startswith(("state-", "messages-")):
                work.delete(name)


def scores_by_kind(vertices: DataFrame, scores: DataFrame, evaluation: DataFrame | None = None) -> DataFrame:
    """Vertices of one kind with their scores, and with a label ``evaluation`` by ``id`` if given."""
    if evaluation is not None:
        scores = scores.join(evaluation.select("id", "evaluation"), "id", "left")
    return vertices.join(scores, "id")


def neighbour_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, outDegree`` with the number of distinct ``edges`` of each vertex; an undirected graph has both directions."""
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outDegree"))
    return with_degrees(vertices.select("id").distinct(), degree)


def score_histogram(scores: DataFrame) -> DataFrame:
    """Number of reached, unseeded vertices per rounded score."""
    bucket = F.round("score", 1).alias("score_bucket")
    return scores.where(~F.col("fixed")).groupBy("experiment", bucket).count().orderBy("experiment", "score_bucket")


def anomalies(scores: DataFrame) -> DataFrame:
    """Scores above 1, which a consistent graph cannot have."""
    return scores.where(F.col("score") > 1.0)


def affected_counts(scores: DataFrame) -> DataFrame:
    """Number of vertices with a positive score per experiment."""
    return scores.groupBy("experiment").agg(F.count_if(F.col("score") > 0).alias("affected"))
