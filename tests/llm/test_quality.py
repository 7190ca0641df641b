import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scangraph.llm import passage_attention as mil
from scangraph.llm.passage_attention import Attention, encode, fit, fit_attention, quality, score_attention
from scangraph.llm.queries import ALL

SF_DIR = "/root/testdata/sf0.01"


def text(rng, poor):
    """Prose of some passages; in a poor text one of them is shouted or repeated."""
    prose = lambda n: " ".join(rng.choice("the of reran onder tith ing".split()) + rng.choice(["", "", ",", "."]) for _ in range(n))
    parts = [prose(rng.randint(30, 90)) for _ in range(rng.randint(1, 4))]
    if poor:
        junk = prose(40).upper().replace(" ", "!! ") if rng.random() < 0.5 else "spam " * 50
        parts.insert(rng.randint(0, len(parts)), junk)
    return "\n".join(parts)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(2)
    return [(i, text(rng, i % 4 == 0), int(i % 4 > 0)) for i in range(500)]


@pytest.fixture
def tables(spark, table, tmp_path, labelled):
    odd = [(None, "a b."), (None, None), (9000, None), (9001, ""), (9001, " \n "), (9002, "x " * 20_000), (3, "twice.")]
    docs = table([(i, t) for i, t, _ in labelled] + odd, "documents.parquet")
    labels = [(i, q, 0) for i, _, q in labelled] + [(None, 1, 0), (7, None, 1), (99_999, 0, 0), (8, 0, 0), (9000, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return docs, spark.read.parquet(str(tmp_path / "labels.parquet")), len(labelled) + len(odd)


def test_held_out_documents_are_told(tables, labelled, spark, tmp_path):
    docs, _, n = tables
    found = ALL["op13_passage_attention"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= mil.CUT) for r in rows)
    for r in rows:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    told = {r.doc_id: r.predicted for r in rows if r.held_out}
    right = [told[i] == q for i, _, q in labelled if i in told]
    assert len(right) > 60 and np.mean(right) >= 0.97


def test_labels_of_held_out_documents_are_not_read(tables):
    docs, labels, _ = tables
    other = labels.withColumn("quality", F.when(mil.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = fit_attention(docs, labels), fit_attention(docs, other)
    assert all((first.weights[k] == second.weights[k]).all() for k in first.weights)


def test_only_the_text_counts(spark, table, labelled):
    bodies = [t.encode() for _, t, _ in labelled[:60]] + [b"", b" \n", b"  lead", b"trail  "]
    x, counts = encode(bodies)
    alone = [encode([b]) for b in bodies]
    assert (x == np.concatenate([a for a, _ in alone])).all()
    assert counts.tolist() == [c[0] for _, c in alone] == [max(1, math.ceil(len(b.split()) / mil.PASSAGE)) for b in bodies]


def test_model_against_plain_loops(labelled):
    bodies, y = [t.encode() for _, t, _ in labelled[:80]], np.array([float(q) for *_, q in labelled[:80]])
    x, counts = encode(bodies)
    model = fit(x, counts, y)
    w = {k: v.astype(float) for k, v in model.weights.items()}
    at = 0
    for count, score in zip(counts, model.scores(x, counts), strict=True):
        codes = [np.tanh((row - w["mean"]) / w["spread"] @ w["encode"] + w["encode_0"]) for row in x[at : at + count]]
        raw = [float(w["attend"] @ (np.tanh(c @ w["tanh"]) / (1 + np.exp(-(c @ w["gate"]))))) for c in codes]
        shares = [math.exp(r) / sum(map(math.exp, raw)) for r in raw]
        pooled = sum(s * c for s, c in zip(shares, codes, strict=True))
        assert score == pytest.approx(1 / (1 + math.exp(-(pooled @ w["score"] + w["score_0"][0]))), abs=1e-4)
        at += count


def test_gradients():
    rng = np.random.default_rng(1)
    counts, y = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(6, mil.N_FEATURES))
    shapes = {"encode": (mil.N_FEATURES, 4), "encode_0": 4, "tanh": (4, 3), "gate": (4, 3), "attend": 3, "score": 4, "score_0": 1}
    weights = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}
    model = Attention({**weights, "mean": np.zeros(mil.N_FEATURES), "spread": np.ones(mil.N_FEATURES)})

    def loss():
        p = model.scores(x, counts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = model.gradients(x, counts, y)
    for name, value in weights.items():
        flat, told = value.reshape(-1), np.asarray(found[name]).reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 7)):
            kept = flat[i]
            flat[i] = kept + 1e-5
            above = loss()
            flat[i] = kept - 1e-5
            below = loss()
            flat[i] = kept
            assert told[i] == pytest.approx((above - below) / 2e-5, abs=1e-6), name


def test_few_or_no_labels(spark, table, tables):
    docs, labels, n = tables
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality(table([], "none"), labels).collect() == []
    assert fit_attention(docs, labels, sample_passages=0).prior == 0.5
    bounded = fit_attention(docs, labels, sample_rows=200, sample_passages=300)
    scores = score_attention(docs, bounded).collect()
    assert len(scores) == n and len({r.score for r in scores if r.doc_id in (9000, 9001)}) <= 3


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_given_tables(spark):
    found = ALL["op13_passage_attention"](spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 60 and np.mean([r.predicted == r.quality for r in rows]) >= 0.97
