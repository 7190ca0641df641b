"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each model is a logistic regression on the words of a
text (and their beginnings) and on the probabilities of the categories before it. Those probabilities are made out of fold for
training, so that a later model sees them as good as they will be on new texts.

The chain is fitted on a bounded sample of the labelled rows, whose words Spark counts and encodes, and
applied to every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangraph.llm.common import scratch, texts

#: Rows that a chain is fitted on at most: those with the least hash of doc_id.
SAMPLE_ROWS = 10_000
FOLDS = 3
#: Words in fewer sampled texts are no features; of the others the most frequent are looked at, and each
#: model has those most associated with its category.
MIN_TEXTS, VOCABULARY, SCREENED = 5, 1 << 15, 256
#: Words below this statistic are left out: of so many words, some reach less by chance.
CHI_SQUARE = 30.0
#: Letters of a longer word that are a feature by themselves.
BEGINNINGS = (4, 5)

_WORD = re.compile(r"[^\W_]+")


def distinct_terms(text: bytes) -> set[str]:
    """Runs of letters and digits, lower-cased, and the beginnings of the longer ones, marked by ``^``.

    Beginnings catch the inflected forms of a stem, each of which may be rare.
    """
    words = set(_WORD.findall(bytes(text).decode("utf-8", "replace").lower()))
    for size in BEGINNINGS:
        words.update({"^" + w[:size] for w in words if len(w) > size and w[0] != "^"})
    return words


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"doc_id": rows.doc_id, "words": [sorted(distinct_terms(t)) for t in rows.text]})


@dataclass
class Link:
    """One category's model: logit = intercept + word weights + weights of earlier probabilities."""

    category: str
    intercept: float
    words: dict[str, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)
    #: Probability from which on the category is told, found on out-of-fold predictions.
    cut: float = 0.5

    def probability(self, words: set[str], before: list[float]) -> float:
        known = self.words
        # In sorted order, so that the sum is the same in every process.
        logit = self.intercept + sum(known[w] for w in sorted(known.keys() & words))
        logit += sum(a * b for a, b in zip(self.earlier, before, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))


def _screen(rows: list[np.ndarray], y: np.ndarray, words: int, most: int) -> np.ndarray:
    """The words most associated with ``y``, by the chi-square statistic of their presence."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows)
    total = np.bincount(flat, minlength=words)
    positive = np.bincount(flat, weights=y[owner], minlength=words)
    expected = total * y.mean()
    spread = expected * (1 - y.mean()) * (1 - total / len(rows)) + 1e-9
    score = (positive - expected) ** 2 / spread
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(best[score[best] >= CHI_SQUARE])


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a ridge logistic regression; the last one is the intercept, which isn't held down."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights, held = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    held[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curvature = (x * (p * (1 - p))[:, None]).T @ x + np.diag(held)
        step = np.linalg.solve(curvature, x.T @ (y - p) - held * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _design(rows: list[np.ndarray], chosen: np.ndarray, words: int, earlier: np.ndarray) -> np.ndarray:
    column = np.full(words, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)))
    for i, present in enumerate(rows):
        own = column[present]
        x[i, own[own >= 0]] = 1
    return np.hstack([x, earlier])


def _fit_link(rows, earlier, y, vocabulary: list[str], category: str, settings: tuple[int, float]) -> Link:
    most, ridge = settings
    if not 0 < y.sum() < len(y):
        return Link(category, 500.0 if y.sum() else -500.0, {}, [0.0] * earlier.shape[1])
    chosen = _screen(rows, y, len(vocabulary), most)
    weights = _newton(_design(rows, chosen, len(vocabulary), earlier), y, ridge)
    terms = {vocabulary[w]: float(c) for w, c in zip(chosen, weights, strict=False)}
    return Link(category, float(weights[-1]), terms, [float(v) for v in weights[len(chosen) : -1]])


def _best_cut(y: np.ndarray, p: np.ndarray) -> float:
    """Probability that parts the classes best (by F1), in the middle of the gap between two rows."""
    order = np.argsort(-p, kind="stable")
    hits, ranked = np.cumsum(y[order]), p[order]
    score = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    score[:-1][ranked[:-1] == ranked[1:]] = -1  # equal rows stay together
    best = int(np.argmax(score))
    below = ranked[best + 1] if best + 1 < len(ranked) else 0.0
    return float(np.sqrt(max(ranked[best], 1e-12) * max(below, 1e-12)))


def _encode(places: dict[str, int], categories: tuple[str, ...]):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [np.array(sorted(places[w] for w in ws if w in places), "<i4").tobytes() for ws in rows.words]
            yield rows[["doc_id", *categories]].assign(present=found)

    return encode


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: tuple[str, ...] = ("quality", "toxic"),
    sample_rows: int = SAMPLE_ROWS,
    folds: int = FOLDS,
    screened: int = SCREENED,
    ridge: float = 0.02,
) -> list[Link]:
    """Fit one model per label column, in the given order, on at most ``sample_rows`` labelled texts.

    Labels are 0 or 1; rows without doc_id or with a null label are not used, and a repeated doc_id counts
    once (its largest label, its first words in order). A category of which a fit has one value only gets
    that value; without any labelled text all probabilities are 0.
    """
    work = scratch(docs.sparkSession)
    values = [F.col(c).cast("double").alias(c) for c in categories]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *values).dropna()
    known = known.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    sample = work.write(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "sample")
    # The sample is bounded by its parameter, so it may be broadcast; texts aren't shuffled.
    bodies = texts(docs).join(F.broadcast(sample), "doc_id", "left_semi").select("doc_id", "text")
    words = bodies.mapInPandas(_words, "doc_id long, words array<string>")
    words = words.groupBy("doc_id").agg(F.min("words").alias("words")).join(F.broadcast(sample), "doc_id")
    words = work.write(words, "words")

    frequent = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    frequent = frequent.where(F.col("n") >= MIN_TEXTS).orderBy(F.desc("n"), "word").limit(VOCABULARY)
    vocabulary = [row.word for row in frequent.collect()]
    places = {word: i for i, word in enumerate(vocabulary)}
    columns = "".join(f", {c} double" for c in categories)
    encoded = words.mapInPandas(_encode(places, categories), f"doc_id long{columns}, present binary")
    # One short row per sampled text; the sample is bounded, so is what comes to the driver.
    fitted = encoded.toPandas().sort_values("doc_id", ignore_index=True)
    if fitted.empty:
        return [Link(c, -500.0, {}, [0.0] * i) for i, c in enumerate(categories)]

    rows = [np.frombuffer(present, "<i4") for present in fitted.present]
    fold = pd.util.hash_array(fitted.doc_id.to_numpy()) % folds
    earlier, chain = np.zeros((len(rows), 0)), []
    for category in categories:
        y = fitted[category].to_numpy()
        settings = (category, (screened, ridge))
        chain.append(_fit_link(rows, earlier, y, vocabulary, *settings))
        # What later models learn from is predicted by models that have not seen the row.
        held_out = np.zeros(len(rows))
        for k in range(folds):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if not len(train):
                train = test
            link = _fit_link([rows[i] for i in train], earlier[train], y[train], vocabulary, *settings)
            for i in test:
                held_out[i] = link.probability({vocabulary[w] for w in rows[i]}, list(earlier[i]))
        if 0 < y.sum() < len(y):
            chain[-1].cut = _best_cut(y, held_out)
        earlier = np.hstack([earlier, held_out[:, None]])
    return chain


def _score(chain: list[Link]):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found: dict[str, list[float]] = {f"p_{link.category}": [] for link in chain}
            for text in rows.text:
                words, before = distinct_terms(text), []
                for link in chain:
                    before.append(link.probability(words, before))
                for name, value in zip(found, before, strict=True):
                    found[name].append(value)
            yield pd.DataFrame({"row_id": rows.row_id, "doc_id": rows.doc_id, **found})

    return score


def score_chain(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """``row_id, doc_id`` and ``p_<category>`` for every row of ``docs``; null texts have no words."""
    columns = "".join(f", p_{link.category} double" for link in chain)
    return texts(docs).mapInPandas(_score(chain), f"row_id long, doc_id long{columns}")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row_id, doc_id, p_quality, p_toxic, toxic`` for every row of ``docs``.

    Repeated rows get equal results, rows without doc_id are scored like others, and an empty table gives
    an empty result. ``toxic`` tells whether the last probability reaches the model's cut.
    """
    chain = fit_chain(docs, labels)
    return score_chain(docs, chain).withColumn("toxic", F.col("p_toxic") >= chain[-1].cut)


def without_toxic(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """The rows of ``docs`` that the chain's last category is not told of, with all their columns.

    Null and empty texts have no words and are judged by that; repeated rows are judged alike, rows without doc_id and
    texts of any length like others, and an empty table gives an empty result.
    """
    place, cut = docs.columns.index("text"), chain[-1].cut

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for text in rows.column(place).to_pylist():
                terms, before = distinct_terms((text or "").encode()), []
                for link in chain:
                    before.append(link.probability(terms, before))
                keep.append(before[-1] < cut)
            yield rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
