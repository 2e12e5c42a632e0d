"""Streams that are stopped in the middle and resumed give what one batch gives."""

import time

import pytest
from pyspark.sql import functions as F

from tarnish.operators import corruption as C
from tarnish.streaming import jobs


def listed(df):
    return sorted(map(str, df.collect()))


def stopped_then_resumed(stream, path, checkpoint, batches):
    """Starts the job, stops it after some micro-batches, and runs the rest; returns how many were through before."""
    q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    deadline = time.time() + 90
    while q.isActive and len(q.recentProgress) < batches and time.time() < deadline:
        time.sleep(0.05)
    q.stop()
    before = len(q.recentProgress)
    jobs.store_available(stream, path, checkpoint)
    return before


def test_a_stream_stopped_in_the_middle(spark, features, tmp_path):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    features.repartition(9).write.parquet(source)
    stream = jobs.corrupted(jobs.arriving(spark, source, features.schema, 1), "missing_injection", 0.3, 7)
    assert 1 <= stopped_then_resumed(stream, sink, checkpoint, 3) < 9
    want = listed(C.apply(features, "missing_injection", 0.3, 7))
    read = spark.read.schema(features.schema)
    assert listed(read.parquet(sink)) == want
    jobs.store_available(stream, sink, checkpoint)  # nothing new
    assert listed(read.parquet(sink)) == want


def test_families_that_need_all_rows(spark, features, tmp_path):
    features.limit(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.arriving(spark, str(tmp_path / "in"), features.schema)
    for family in ("duplicate_rows", "label_noise_categorical"):
        with pytest.raises(ValueError, match="all rows"):
            jobs.corrupted(stream, family, 0.1, 1)
    assert set(jobs.ROW_LOCAL) < set(C.list_families())


def test_copies_within_the_delay(spark, tmp_path):
    schema = "id int, ts timestamp, v string"
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    add = lambda rows: spark.createDataFrame([(i, t, v) for i, t, v in rows], "id int, ts string, v string").select(
        "id", F.col("ts").cast("timestamp").alias("ts"), "v").coalesce(1).write.mode("append").parquet(source)
    run = lambda: jobs.store_available(
        jobs.without_copies(jobs.arriving(spark, source, schema), ["id"], "ts", "1 hour"), sink, checkpoint)
    add([(1, "2024-01-01 10:00:00", "a"), (1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 10:30:00", "b"), (9, None, "no time")])
    run()
    add([(2, "2024-01-01 10:30:00", "b"), (3, "2024-01-01 11:00:00", "c")])  # a copy after a restart
    run()
    add([(4, "2024-01-01 18:00:00", "d")])
    run()
    add([(5, "2024-01-01 10:00:00", "too late"), (4, "2024-01-01 18:00:00", "d")])
    run()
    assert sorted(r["id"] for r in spark.read.schema(schema).parquet(sink).collect()) == [1, 2, 3, 4]
