"""Corruption as rows arrive, and removal of copies with bounded state.

A job reads what has come into a folder, writes files, and stops; its checkpoint remembers what it has read, so the next run (or
one after a crash) goes on there, and the sink's log admits each micro-batch once. The row-local families need nothing but the
row, so their stream has no state. Copies are told apart by their key as long as the watermark keeps it: state covers the
stated delay, not the whole stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.operators import corruption as C

#: Families whose result for a row depends on that row alone.
ROW_LOCAL = ("missing_injection", "type_flip", "schema_drift", "currency_unit_drift", "timezone_collapse",
             "category_taxonomy_drift", "mojibake_roundtrip")


def arriving(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files of a folder as a stream, the oldest first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def corrupted(stream: DataFrame, family: str, severity: float, seed: int, **options) -> DataFrame:
    """A stream under a row-local family, or under level swaps when the caller gives the levels (a stream doesn't know them)."""
    if family not in ROW_LOCAL and not (family == "label_noise_categorical" and options.get("levels") is not None):
        raise ValueError(f"{family!r} needs all rows at once; on a stream: {ROW_LOCAL}")
    return C.apply(stream, family, severity, seed, **options)


def without_copies(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; a copy is recognised while it comes within ``delay`` of event time, and rows later than that are dropped.

    Rows without a time can't be placed and are dropped by the watermark's rules, so they are refused here by a filter.
    """
    timed = stream.where(F.col(time).isNotNull()).withColumn("_event_time", F.col(time).cast("timestamp"))
    return timed.withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(keys).drop("_event_time")


def store_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that has arrived and stops; a later call with the same checkpoint does only what is new."""
    (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
