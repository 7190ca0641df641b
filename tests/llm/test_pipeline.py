from pathlib import Path

import pytest
from compare import connect, difference

import corpus_pipeline
from scangraph.llm import maxplus_pieces, queries
from scangraph.llm.bloom_lookup import fingerprints
from scangraph.llm.common import documents
from test_duplicates import folded, links

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.mark.parametrize("name", queries.SQL)
def test_query_matches_sql(spark, name):
    assert difference(queries.ALL[name](spark, SF_DIR), connect(SF_DIR), queries.SQL[name]) is None


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in queries.ALL} == {f"op{n}" for n in range(1, 14)}


def test_stages(spark, tmp_path):
    docs, seen = documents(spark, SF_DIR), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append((docs.columns, docs.collect()))
    columns = documents(spark, SF_DIR).columns
    assert [c for c, _ in seen[:-1]] == [columns] * 4
    toxic, exact, near, cut = ([(r.doc_id, r.text) for r in rows] for _, rows in seen[:-1])
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic = 1")
    labelled = {r.doc_id for r in labels.collect()}
    assert labelled and len(labelled & {i for i, _ in toxic}) < 0.6 * len(labelled)
    last = {}
    for doc_id, text in toxic:
        last[folded(text)] = max(doc_id, last.get(folded(text), -1))
    assert {i for i, _ in exact} == set(last.values())
    expected, groups = links(exact, 5)
    assert len(near) == groups and {i for i, _ in near} == {least for _, _, least in expected}
    assert {i for i, _ in cut} == {i for i, _ in near}
    assert all(r.n_chars == len(r.text) for r in seen[3][1])
    assert sum(r.length for r in seen[4][1]) > 0 and {r.doc_id for r in seen[4][1]} == {i for i, _ in near}


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    fills = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert rows and max(fills.values()) <= 2048


def test_rows_keep_their_numbers_when_splits_change(spark, table, monkeypatch):
    """Row numbers of a scan follow its splits, and these the cores there are: joins must not depend on it."""
    rows = [(i, f"{i} " + "words that are all the same in each of them " * 3) for i in range(40)]
    rows += [(i + 100, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)]
    docs = table(rows)
    monkeypatch.setattr(maxplus_pieces, "is_bpe", lambda path=None: False)
    results = {
        "exact": lambda: corpus_pipeline.exact_dedup(spark, docs, SF_DIR),
        "near": lambda: corpus_pipeline.minhash_near_dedup(spark, docs, SF_DIR),
        "passages": lambda: corpus_pipeline.suffix_array_dedup(spark, docs, SF_DIR),
        "pieces": lambda: maxplus_pieces.round_trip(docs),
        "fingerprints": lambda: fingerprints(docs).select("doc_id", "n_chars", "edited_sha256"),
    }
    one_split = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}
    for name, make in results.items():
        expected = sorted(map(repr, make().collect()))
        later = make()  # some of the scans are done by now, the others see other splits
        try:
            for key, value in one_split.items():
                spark.conf.set(key, value)
            assert sorted(map(repr, later.collect())) == expected, name
        finally:
            for key in one_split:
                spark.conf.unset(key)
        assert len(expected) in (len(rows), len(rows) - 39), name


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, table, odd_rows, tmp_path, empty):
    """Nulls in every column, empty and long texts, repeated rows and clashing columns, or no rows at all."""
    rows = [] if empty else odd_rows
    docs = table(rows, "documents.parquet")
    labels = [] if empty else [(1, 1, 0), (2, 1, 0), (None, 1, 1), (3, None, 0), (4, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns and all(r.row_id == r._row == "x" for r in seen[name])
    kept = {name: [(r.doc_id, r.text) for r in own] for name, own in seen.items() if name != "best_fit_packing"}
    assert sorted(kept["toxicity"], key=repr) == sorted(rows, key=repr)
    last = {}
    for doc_id, text in rows:
        last[folded(text)] = max((i for i in (doc_id, last.get(folded(text))) if i is not None), default=None)
    assert sorted(map(repr, (i for i, _ in kept["exact_dedup"]))) == sorted(map(repr, last.values()))
    assert len(kept["minhash_near_dedup"]) == (0 if empty else links(kept["exact_dedup"], 5)[1])
    assert len(kept["suffix_array_dedup"]) == len(kept["minhash_near_dedup"])
    packed = seen["best_fit_packing"]
    assert {r.doc_id for r in packed} == {i for i, _ in kept["suffix_array_dedup"]}
    fills = {}
    for r in packed:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert all(n <= 2048 for n in fills.values())
