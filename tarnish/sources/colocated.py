"""Bronze tables stored in buckets of their join key, as named catalog tables: jobs that join or group by the key shuffle nothing.

Each table is shuffled once, when it is stored, into one sorted file a bucket; every later aggregation and join by the key finds its rows
together. A bucket is read by one task, so a table whose largest bucket holds more than ``MAX_SKEW`` times the mean is stored without
buckets; its jobs shuffle as before, with the same result. Dimension tables are stored plain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.operators.features import ByOrder
from tarnish.session import scratch_path
from tarnish.sources import adapter
from tarnish.sources.freshness import input_state

MAX_SKEW = 4
#: (database, folder) of the stored tables by (application, folder), with the state of the inputs.
_STORED: dict[tuple[str, str], tuple[str, str]] = {}


def even_buckets(df: DataFrame, key: str, buckets: int) -> bool:
    """Whether no bucket is far above the mean. Counts are combined before the shuffle, at most one row a bucket and task."""
    sizes = df.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    seen = sizes.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    return (seen["largest"] or 0) * buckets <= MAX_SKEW * (seen["total"] or 0)


def write_tables(tables: dict[str, DataFrame], key: str, database: str, folder: str, buckets: int) -> dict[str, DataFrame]:
    """Stores tables as ``database``.name below the folder, those with the key in buckets of it, and returns them by name."""
    spark = next(iter(tables.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{folder}'")
    for name, df in tables.items():
        write = df.write
        if key in df.columns and even_buckets(df, key, buckets):
            write = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        write.mode("overwrite").option("path", f"{folder}/{name}").saveAsTable(f"{database}.{name}")
    return {name: spark.table(f"{database}.{name}") for name in tables}


def colocated_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The seven canonical tables by order, stored on first use and again when an input file has changed."""
    state = input_state(spark, [f"{sf_dir}/{name}.parquet" for name in adapter.SOURCES])
    key = (spark.sparkContext.applicationId, sf_dir)
    database, built_from = _STORED.get(key, ("", ""))
    if built_from != state:
        folder = scratch_path(spark, "colocated")
        database = folder.rsplit("/", 1)[1].replace("-", "_")
        write_tables(adapter.canonical_tables(spark, sf_dir), "order_id", database, folder,
                     int(spark.conf.get("spark.sql.shuffle.partitions")))
        _STORED[key] = database, state
    return ByOrder({name: spark.table(f"{database}.{name}") for name in adapter.TABLES})
