"""Stored tables: built again when an input changes; bronze in buckets of the key needs no shuffle by it."""

import time

from pyspark.sql import functions as F

from conftest import SF, rows
from tarnish.operators.dense_index import dense_index
from tarnish.operators.features import build_order_features, feature_table_columns
from tarnish.session import materialize, scratch_path
from tarnish.sources import adapter, colocated
from tarnish.sources.freshness import input_state
from tarnish.sources.silver import read_silver, silver, silver_path, write_silver


def test_input_state_sees_files_not_their_order(spark):
    path = scratch_path(spark, "state")
    spark.range(10).write.parquet(f"{path}/a")
    spark.range(10).write.parquet(f"{path}/b")
    first = input_state(spark, [f"{path}/a", f"{path}/b"])
    assert first == input_state(spark, [f"{path}/b", f"{path}/a"])
    spark.range(11).write.mode("append").parquet(f"{path}/a")
    assert first != input_state(spark, [f"{path}/a", f"{path}/b"])


def test_silver_follows_its_inputs(spark):
    folder = scratch_path(spark, "inputs")
    for name in adapter.SOURCES:
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    first = silver_path(spark, folder)
    n = silver(spark, folder).count()
    assert silver_path(spark, folder) == first
    fewer = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 2 = 0")
    fewer.write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    assert silver_path(spark, folder) != first
    assert silver(spark, folder).count() == fewer.count() < n


def test_colocated_bronze_needs_no_shuffle_by_order(spark):
    of = build_order_features(colocated.colocated_tables(spark, SF), adapter.TRAIN_END, adapter.VAL_END)
    plan = of._jdf.queryExecution().sparkPlan().toString() + of._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(order_id" not in plan
    assert "SelectedBucketsCount: 8 out of 8" in plan
    plain = build_order_features(adapter.canonical_tables(spark, SF), adapter.TRAIN_END, adapter.VAL_END)
    assert "hashpartitioning(order_id" in plain._jdf.queryExecution().executedPlan().toString()
    assert rows(of, "order_id") == rows(plain, "order_id")


def test_a_hot_bucket_is_not_stored_in_buckets(spark):
    assert not colocated.even_buckets(spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k")), "k", 8)
    assert colocated.even_buckets(spark.range(4000).select(F.col("id").alias("k")), "k", 8)
    assert colocated.even_buckets(spark.range(0).select(F.col("id").alias("k")), "k", 8)
    folder = scratch_path(spark, "hot")
    hot = spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), "id")
    database = "hot_" + folder.rsplit("-", 1)[1]
    out = colocated.write_tables({"hot": hot}, "k", database, folder, 8)["hot"]
    assert rows(out, "id") == rows(hot, "id")
    assert "bucket" not in spark.sql(f"SHOW CREATE TABLE {database}.hot").first()[0].lower()


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def left_over(spark, made):
    """Shuffle files that a job leaves; Spark removes them beside the next jobs, so they get some seconds."""
    before = shuffle_files(spark)
    result = made()
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    return result, left


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k")).groupBy("k").count()
    stored, left = left_over(spark, lambda: materialize(rows, "counts"))
    assert not left and sorted(r["count"] for r in stored.collect()) == [142, 143, 143, 143, 143, 143, 143]
    columns = [F.first("k").cast("string").alias(c) if c != "split" else F.lit("test").alias(c) for c in feature_table_columns()]
    _, left = left_over(spark, lambda: write_silver(rows.groupBy("count").agg(*columns), str(tmp_path / "silver")))
    assert not left and read_silver(spark, str(tmp_path / "silver")).count() == 2


def test_counts_of_buckets_leave_no_shuffle_files(spark):
    index, left = left_over(spark, lambda: dense_index(spark.range(1000), "id"))
    assert not left and index.n == 1000 and index.rows.agg(F.count_distinct("_idx"), F.max("_idx")).first()[:] == (1000, 999)
