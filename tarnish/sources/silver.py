"""The stored feature table, and its get-or-build form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnish.operators.features import build_order_features, feature_table_columns
from tarnish.session import scratch_path, shuffles_removed
from tarnish.sources import adapter
from tarnish.sources.freshness import input_state

#: Path of the stored table by (application, folder), with the state of the inputs it was built from.
_STORED: dict[tuple[str, str], tuple[str, str]] = {}


def write_silver(features: DataFrame, path: str) -> None:
    """Stored by split, so jobs on one split read only its files."""
    with shuffles_removed(features.sparkSession):
        features.select(*feature_table_columns()).write.mode("overwrite").partitionBy("split").parquet(path)


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*feature_table_columns())


def silver_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the feature table of the test tables is stored: built on first use, and again whenever an input file has changed."""
    state = input_state(spark, [f"{sf_dir}/{name}.parquet" for name in adapter.SOURCES])
    key = (spark.sparkContext.applicationId, sf_dir)
    path, built_from = _STORED.get(key, ("", ""))
    if built_from != state:
        path = scratch_path(spark, "order_features")
        write_silver(build_order_features(
            adapter.canonical_tables(spark, sf_dir), adapter.TRAIN_END, adapter.VAL_END), path)
        _STORED[key] = path, state
    return path


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_silver(spark, silver_path(spark, sf_dir))
