"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scangraph.llm.arrow_tokens import read_tokens, write_tokens
from scangraph.llm.bayes_minhash import near_duplicates
from scangraph.llm.bloom_lookup import fingerprints
from scangraph.llm.common import documents, scratch
from scangraph.llm.content_archive import archive_pages
from scangraph.llm.exact_dedup import exact_duplicates
from scangraph.llm.maxplus_pieces import round_trip
from scangraph.llm.passage_attention import quality
from scangraph.llm.periodic_runs import longest_run, periodic_runs, with_planted_runs
from scangraph.llm.residual_packing import pack_documents
from scangraph.llm.suffix_levels import repeated_passages
from scangraph.llm.toxicity_chain import toxicity
from scangraph.llm.trie_counts import token_counts
from scangraph.llm.turn_alignment import damaged, repair_conversations

ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    ALL[f.__name__] = f
    return f


@_query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op1_exact_dedup"] = """
with folded as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') as body from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(body) as text_sha256
from folded window same as (partition by body)
"""


@_query
def op2_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL["op2_content_archive"] = """
with sized as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as n from pages),
typed as (select *, max(page_id) over (partition by body) as top from sized)
select page_id, cast(n as bigint) as payload_bytes, sha1(body) as payload_digest,
       case when n < 1000 or page_id = top then 'response' else 'revisit' end as record_type,
       case when n >= 1000 and page_id <> top then top end as refers_to
from typed
"""


@_query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


@_query
def op4_maxplus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


@_query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), shingle_words=2)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept)


@_query
def op6_bloom_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(documents(spark, sf_dir))
    likeness = ["near_edited", "near_next"]
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *likeness)


@_query
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity(documents(spark, sf_dir), labels)
    return found.select("doc_id", "p_quality", "p_toxic", "toxic", (~F.col("toxic")).alias("kept"))


@_query
def op9_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark).path("tokens")
    write_tokens(documents(spark, sf_dir), path)
    return read_tokens(spark, path)


@_query
def op10_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir)).drop("row_id")


@_query
def op11_turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(documents(spark, sf_dir))).withColumn("best", longest_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op13_passage_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(documents(spark, sf_dir), labels).drop("row_id")
