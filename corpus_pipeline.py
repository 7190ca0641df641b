"""A training corpus from raw documents: five stages, each of which works on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). Its result is written as Parquet and
read again as the next one's ``docs``. Scratch tables of a stage are deleted when the next one begins, so a
stage's result must be written by then.

Toxic documents go; of equal documents the one with the largest doc_id stays; of each group of near copies
(five-word shingles, similarity of 0.8 or more) the one with the smallest; passages that an earlier document
has are cut out; and what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scangraph.llm.bayes_minhash import near_duplicates
from scangraph.llm.common import documents, keep_rows, on_scratch, scratch, stored
from scangraph.llm.exact_dedup import exact_duplicates
from scangraph.llm.residual_packing import pack_documents
from scangraph.llm.suffix_levels import without_passages
from scangraph.llm.toxicity_chain import fit_chain, without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. Null and empty texts are not toxic by themselves; every other row stays, with its columns."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, fit_chain(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest doc_id stays (null last, then the last row);
    null and empty texts are equal.
    """
    docs = stored(docs, scratch(spark))
    return keep_rows(docs, exact_duplicates(docs).where("kept").select("row_id"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id stays (null last, then the first row). Texts without
    words are nobody's copy.
    """
    docs = stored(docs, scratch(spark))
    return keep_rows(docs, near_duplicates(docs, shingle_words=5).where("first_row").select("row_id"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of texts; every row stays, also one of which nothing is left."""
    return without_passages(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the texts; null and empty ones are one token each."""
    return pack_documents(docs)


_left: list = []


def _tidy(stage: Stage) -> Stage:
    """``stage``, after the scratch tables of the stage before are deleted."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            _left.pop().close()
        stop = on_scratch(_left.append)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            stop()

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _tidy(toxicity)),
    ("exact_dedup", _tidy(exact_dedup)),
    ("minhash_near_dedup", _tidy(minhash_near_dedup)),
    ("suffix_array_dedup", _tidy(suffix_array_dedup)),
    ("best_fit_packing", _tidy(best_fit_packing)),
]

#: The classifier, the components and the packing can't be stated in SQL; tests hold a run against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of all documents of ``sf_dir``: one row per piece."""
    work, docs = scratch(spark), documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = work.write(docs, name)
            if number:
                work.delete(STAGES[number - 1][0])
    return docs
