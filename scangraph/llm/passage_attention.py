"""Quality of documents by attention over their passages (multiple-instance learning).

A label tells of a whole document, not of the passages that earn it. Each passage of ``PASSAGE`` words is encoded:
shares of kinds of characters, repetition, hashed words and word shapes, then one learned layer. Gated attention
``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the passages of a document, and the weighted sum of their codes is
scored by a logistic unit. All weights are learned from the labels of documents together, by Adam.

The model is fitted on a bounded sample of labelled documents whose passages Spark has encoded, and applied to every
passage of every text. Labels of held-out documents are never read for it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scangraph.llm.common import scratch, texts

#: Words of a passage.
PASSAGE = 40
#: Bounds of what a model is fitted on: labelled documents (those with the least hash of doc_id), and their
#: passages in all. A document that would go beyond the second bound is left out, with all behind it.
SAMPLE_ROWS, SAMPLE_PASSAGES = 6_000, 80_000
#: A document is held out when the CRC-32 of its decimal id is divisible by this.
FOLDS = 5
SHAPES, WORDS = 32, 64
#: Width of the learned code and of the attention.
CODE, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 25, 128, 0.01, 1e-4
CUT = 0.3
#: Bytes of text encoded together, and distinct words that a task remembers at most.
TOGETHER, REMEMBERED = 1 << 20, 200_000

_LOWER, _UPPER, _DIGIT, _STOP, _COMMA, _SYMBOL, _BLANK, _BREAK, _OTHER = range(9)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)  # beyond ASCII
    for code in range(128):
        char = chr(code)
        kinds[code] = (
            _LOWER if char.islower() else _UPPER if char.isupper() else _DIGIT if char.isdigit()
            else _STOP if char in ".!?" else _COMMA if char in ",;:'\"()-" else _BREAK if char == "\n"
            else _BLANK if char.isspace() else _SYMBOL
        )
    return kinds


_KIND = _kinds()
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_RUNS = re.compile(rb"([a-z\x80-\xff]+)|([A-Z]+)|([0-9]+)")
N_FEATURES = 9 + 6 + SHAPES + WORDS


def shape(word: bytes) -> bytes:
    """``word`` with runs of small letters as ``a``, of capitals as ``A`` and of digits as ``0``."""
    return _RUNS.sub(lambda m: b"a" if m[1] else b"A" if m[2] else b"0", word)


class _Words(dict):
    """Distinct words as numbers, with the buckets of their shape and their small letters."""

    def __init__(self) -> None:
        self.shapes: list[int] = []
        self.buckets: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.shapes.append(zlib.crc32(shape(word)) % SHAPES)
        self.buckets.append(zlib.crc32(word.lower()) % WORDS)
        return number


def _per_passage(values: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(passage, weights=values, minlength=n)


def encode(bodies: list[bytes], words: _Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of every text (1 at least).

    What a passage gets depends on its own text only.
    """
    words = _Words() if words is None else words
    split = [body.split() for body in bodies]
    lengths = np.array([len(own) for own in split], np.int64)
    ids = np.fromiter((words[w] for own in split for w in own), np.int64, int(lengths.sum()))
    counts = np.maximum(-(-lengths // PASSAGE), 1)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    n = int(firsts[-1])
    doc = np.repeat(np.arange(len(bodies)), lengths)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = firsts[doc] + place // PASSAGE

    # Every text is followed by a blank, so that each has a byte; passages part the bytes of their text.
    data = np.frombuffer(b" ".join([*bodies, b""]), np.uint8)
    sizes = np.array([len(body) + 1 for body in bodies], np.int64)
    begins = np.cumsum(sizes) - sizes
    blank = _SPACE[data]
    at = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    starts = np.empty(n, np.int64)
    starts[passage[place % PASSAGE == 0]] = at[place % PASSAGE == 0]
    starts[firsts[:-1]] = begins
    kinds = _KIND[data]
    own = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(9)], axis=1).astype(float)
    total = own.sum(axis=1)

    number = np.bincount(passage, minlength=n).astype(float)
    some = np.maximum(number, 1)
    vocabulary = max(len(words), 1)
    _, in_passage = np.unique(passage * vocabulary + ids, return_index=True)
    _, in_doc = np.unique(doc * vocabulary + ids, return_index=True)
    again = np.zeros(len(ids))
    again[1:] = (ids[1:] == ids[:-1]) & (passage[1:] == passage[:-1])
    shapes, buckets = np.array(words.shapes, np.int64)[ids], np.array(words.buckets, np.int64)[ids]
    features = np.zeros((n, N_FEATURES))
    features[:, :9] = own / total[:, None]
    features[:, 9] = total / some / 10
    features[:, 10] = number / PASSAGE
    features[:, 11] = np.bincount(passage[in_passage], minlength=n) / some
    features[:, 12] = np.bincount(passage[in_doc], minlength=n) / some
    features[:, 13] = _per_passage(again, passage, n) / some
    features[:, 14] = np.log1p(np.repeat(counts, counts)) / 5
    for first, width, bucket in ((15, SHAPES, shapes), (15 + SHAPES, WORDS, buckets)):
        table = np.bincount(passage * width + bucket, minlength=n * width).reshape(n, width)
        features[:, first : first + width] = np.sqrt(table / some[:, None])
    return features.astype(np.float32), counts


def _sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, firsts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    """Weights of the model. Without labelled documents to learn from it scores everything ``prior``."""

    weights: dict[str, np.ndarray]
    prior: float | None = None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """All steps from the features of passages to the scores of documents."""
        w = self.weights
        firsts = np.cumsum(counts) - counts
        x = (x - w["mean"]) / w["spread"]
        code = np.tanh(x @ w["encode"] + w["encode_0"])
        left, right = np.tanh(code @ w["tanh"]), _sigmoid(code @ w["gate"])
        logit = (left * right) @ w["attend"]
        logit = np.exp(logit - np.repeat(np.maximum.reduceat(logit, firsts), counts))
        attention = logit / np.repeat(_sums(logit, firsts), counts)
        pooled = _sums(attention[:, None] * code, firsts)
        score = _sigmoid(pooled @ w["score"] + w["score_0"])
        return {"x": x, "code": code, "left": left, "right": right, "attention": attention, "pooled": pooled, "score": score}

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(counts), self.prior)
        return self.forward(x, counts)["score"]

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss, without the constant ones of the scaling."""
        w, f = self.weights, self.forward(x, counts)
        firsts = np.cumsum(counts) - counts
        wrong = (f["score"] - y) / len(y)
        d_pooled = np.repeat(wrong[:, None] * w["score"], counts, axis=0)
        gain = (d_pooled * f["code"]).sum(axis=1)
        mean = np.repeat(_sums(f["attention"] * gain, firsts), counts)
        d_logit = f["attention"] * (gain - mean)
        left, right = f["left"], f["right"]
        d_left = d_logit[:, None] * w["attend"] * right * (1 - left**2)
        d_right = d_logit[:, None] * w["attend"] * left * right * (1 - right)
        d_code = f["attention"][:, None] * d_pooled + d_left @ w["tanh"].T + d_right @ w["gate"].T
        d_code *= 1 - f["code"] ** 2
        return {
            "encode": f["x"].T @ d_code,
            "encode_0": d_code.sum(axis=0),
            "tanh": f["code"].T @ d_left,
            "gate": f["code"].T @ d_right,
            "attend": (left * right).T @ d_logit,
            "score": f["pooled"].T @ wrong,
            "score_0": wrong.sum(keepdims=True),
        }


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, seed: int = 0) -> Attention:
    """The model of documents with ``counts`` passages each and labels ``y`` (0 or 1)."""
    if not 0 < y.sum() < len(y):
        return Attention({}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
    prior = np.log(y.mean() / (1 - y.mean()))
    weights = {
        "mean": mean,
        "spread": spread,
        "encode": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], CODE)),
        "encode_0": np.zeros(CODE),
        "tanh": rng.normal(0, 1 / np.sqrt(CODE), (CODE, GATE)),
        "gate": rng.normal(0, 1 / np.sqrt(CODE), (CODE, GATE)),
        "attend": rng.normal(0, 1 / np.sqrt(GATE), GATE),
        "score": rng.normal(0, 1 / np.sqrt(CODE), CODE),
        "score_0": np.array([prior]),
    }
    model = Attention({k: v.astype(np.float32) for k, v in weights.items()})
    learned = [k for k in weights if k not in ("mean", "spread")]
    slow = {k: (np.zeros_like(model.weights[k]), np.zeros_like(model.weights[k])) for k in learned}
    firsts, step = np.cumsum(counts) - counts, 0
    rounds = -(-len(y) // BATCH) * EPOCHS
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            own = order[at : at + BATCH]
            rows = np.concatenate([np.arange(firsts[i], firsts[i] + counts[i]) for i in own])
            found = model.gradients(x[rows], counts[own], y[own])
            step += 1
            rate = RATE * (1 - step / (rounds + 1))
            for k in learned:
                g = found[k] + DECAY * model.weights[k]
                first, second = slow[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                model.weights[k] -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept for checking; of a null id, the text is empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _together(bodies: list[bytes]) -> Iterator[slice]:
    first = size = 0
    for i, body in enumerate(bodies):
        size += len(body)
        if size >= TOGETHER:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(bodies):
        yield slice(first, len(bodies))


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for part in _together(list(rows.text)):
            own = rows.iloc[part]
            x, counts = encode(list(own.text))
            bounds = np.concatenate([[0], np.cumsum(counts)])
            bags = [x[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pd.DataFrame({"doc_id": own.doc_id, "passages": counts, "bag": bags})


def fit_attention(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    sample_passages: int = SAMPLE_PASSAGES,
) -> Attention:
    """Fit the model on labelled documents that are not held out, within the two bounds.

    Labels are 0 or 1. Rows without doc_id or label are not used; a repeated doc_id counts once (its largest label,
    its least encoded text). With one value of the label only, or none, that share (or 0.5) is every score.
    """
    work = scratch(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = work.write(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "sample")
    # The sample is bounded by its parameter, so it may be broadcast; texts aren't shuffled.
    bodies = texts(docs).join(F.broadcast(sample), "doc_id", "left_semi").select("doc_id", "text")
    bags = bodies.mapInPandas(_encoded, "doc_id long, passages long, bag binary")
    bags = bags.groupBy("doc_id").agg(F.min(F.struct("passages", "bag")).alias("own"))
    bags = work.write(bags.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "own.*"), "bags")
    sizes = bags.select("doc_id", "passages").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    used = sizes.doc_id[sizes.passages.cumsum() <= sample_passages]
    if used.empty:
        return fit(np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0))
    chosen = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": used.astype("int64")}))
    rows = bags.join(F.broadcast(chosen), "doc_id", "left_semi").toPandas().sort_values("doc_id", ignore_index=True)
    x = np.frombuffer(b"".join(map(bytes, rows.bag)), np.float32).reshape(-1, N_FEATURES)
    return fit(x, rows.passages.to_numpy(np.int64), rows.y.to_numpy())


def _scored(model: Attention):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for rows in batches:
            found = []
            for part in _together(list(rows.text)):
                if len(words) > REMEMBERED:
                    words = _Words()
                found.append(model.scores(*encode(list(rows.text[part]), words)))
            score = np.concatenate(found) if found else np.zeros(0)
            yield pd.DataFrame({"row_id": rows.row_id, "doc_id": rows.doc_id, "score": score.astype(float)})

    return work


def score_attention(docs: DataFrame, model: Attention) -> DataFrame:
    """``row_id, doc_id, score`` of every row; a text without words is one passage without words."""
    return texts(docs).mapInPandas(_scored(model), "row_id long, doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row_id, doc_id, held_out, score, predicted`` for every row of ``docs``.

    The score (0 to 1) depends on the text only. Null and empty texts are scored like other texts, without
    words; equal texts of repeated rows get equal scores; rows without doc_id are scored too. Texts of any length are
    encoded whole, by one task each. An empty table gives an empty result; other columns are left behind.
    """
    scored = score_attention(docs, fit_attention(docs, labels))
    told = (F.col("score") >= CUT).cast("int").alias("predicted")
    return scored.select("row_id", "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", told)
