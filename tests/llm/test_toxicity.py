import random

import pytest

from scangraph.llm.toxicity_chain import distinct_terms, fit_chain, score_chain, toxicity, without_toxic


@pytest.fixture
def labelled(spark, table, tmp_path):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(400):
        body = [rng.choice(words) for _ in range(30)]
        toxic, poor = int(i % 7 == 0), int(i % 5 == 0)
        body += ["Scumbag,", "vile"] * toxic + ["click"] * poor
        rng.shuffle(body)
        rows.append((i, " ".join(body)))
        labels.append((i, 1 - poor, toxic))
    rows += [(None, "a scumbag"), (1000, None), (1001, ""), (1000, None)]
    labels += [(None, 1, 1), (5, None, 0), (7, 1, None), (99_999, 1, 1)]
    path = str(tmp_path / "labels")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path)
    return table(rows), spark.read.parquet(path), len(rows)


def test_held_out_rows_are_told(labelled):
    docs, labels, n = labelled
    chain = fit_chain(docs, labels.where("doc_id < 200"))
    assert [len(link.earlier) for link in chain] == [0, 1]
    found = score_chain(docs, chain).collect()
    assert len(found) == n
    told = {r.doc_id: r.p_toxic >= chain[-1].cut for r in found}
    assert all(told[i] == (i % 7 == 0) for i in range(200, 400)) and told[None]
    assert not told[1000] and not told[1001]
    left = without_toxic(docs, chain)
    assert left.columns == docs.columns and left.count() == n - sum(r.p_toxic >= chain[-1].cut for r in found)


def test_few_or_no_labels(labelled, table):
    docs, labels, n = labelled
    assert not any(r.toxic for r in toxicity(docs, labels.limit(0)).collect())
    assert all(r.toxic for r in toxicity(docs, labels.where("toxic = 1")).collect())
    assert toxicity(table([], "none"), labels).collect() == []


def test_terms():
    assert distinct_terms("Loser, LOSER über_x".encode()) == {"loser", "über", "x", "^lose"}
