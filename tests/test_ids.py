from pyspark.sql import functions as F

from scangraph.operators.ids import dense_ids


def test_ids_are_ranks(spark, work):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id") % 100, F.lit("_"), "id").alias("guid"))
    rows = dense_ids(keys, "guid", work).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.guid)] == list(range(5000))


def test_ids_do_not_depend_on_partitions(spark, work):
    keys = spark.range(300).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("guid"))
    first = {r.guid: r.id for r in dense_ids(keys.repartition(1), "guid", work, "one").collect()}
    second = {r.guid: r.id for r in dense_ids(keys.repartition(9), "guid", work, "two").collect()}
    assert first == second


def test_window_runs_over_partition_sizes_only(spark, work):
    plan = dense_ids(spark.range(10).select(F.col("id").alias("k")), "k", work)
    text = plan._jdf.queryExecution().executedPlan().toString()
    below_window = text[text.index("Window") :]
    assert "HashAggregate" in below_window and "position" not in below_window


def test_no_keys(spark, work):
    assert dense_ids(spark.range(0).select(F.col("id").alias("k")), "k", work).count() == 0
