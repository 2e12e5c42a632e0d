"""Stored sketches of columns and keys: increments are sketched once, merged as often as wanted.

Quantiles of a column come from a KLL sketch for each increment and split, key counts and orphans of joins from a theta
sketch of each key column. A sketch has a fixed size whatever the rows behind it, is filled by map-side combined aggregation, and
increments are overwritten alone, so a job that runs again replaces its own part and no other.

Bounds. A KLL quantile's rank is off by at most ``rank_error(k)`` of the rows with a confidence of 99 %. A theta sketch counts exactly up to
``1 << lg_keys`` keys; beyond, ``key_error`` is three standard deviations. Nulls and NaN count in neither; a column or table without values
has a sketch of none, and its quantiles are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.functions.shapes import unpivot
from tarnish.operators.reports import union_all

#: Size of the quantile sketches, and the binary logarithm of the keys that a key sketch holds.
KLL_K, LG_KEYS = 400, 14


def rank_error(k: int = KLL_K) -> float:
    """Normalised rank error of one quantile of a KLL sketch, as published for it."""
    return 2.296 / k**0.9723


def key_error(n: Column, largest: Column, lg_keys: int = LG_KEYS) -> Column:
    """Bound of an estimate of n keys out of sketches whose largest has seen that many; 0 while all keys fit."""
    return F.when(largest <= (1 << lg_keys), 0.0).otherwise(3 * F.sqrt(n * largest / (1 << lg_keys)))


def column_sketches(df: DataFrame, columns: list[str], keys: list[str], k: int = KLL_K) -> DataFrame:
    """(keys…, column, n_rows, sketch) from one scan; the sketch is null where the column has no value."""
    long = unpivot(df, columns, "double", keep={key: f"`{key}`" for key in keys})
    return long.groupBy(*keys, "column").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.kll_sketch_agg_double(F.when(~F.isnan("value"), F.col("value")), k).alias("sketch"))


def store_increment(sketches: DataFrame, path: str, increment: str) -> None:
    """Stores the sketches of one increment; a second run of the same increment replaces the first."""
    sketches.withColumn("increment", F.lit(increment)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("increment").parquet(path)


def merged_quantiles(sketches: DataFrame, keys: list[str], probs: list[float], k: int = KLL_K) -> DataFrame:
    """(keys…, column, prob, n, quantile) over all stored increments of a group of keys."""
    merged = sketches.groupBy(*keys, "column").agg(F.kll_merge_agg_double("sketch", k).alias("_s"))
    n = F.coalesce(F.kll_sketch_get_n_double("_s"), F.lit(0)).alias("n")
    ranks = F.array(*[F.lit(float(p)) for p in probs])
    asked = F.when(F.kll_sketch_get_n_double("_s") > 0, F.kll_sketch_get_quantile_double("_s", ranks))
    paired = F.arrays_zip(ranks.alias("prob"), F.coalesce(asked, F.array_repeat(F.lit(None).cast("double"), len(probs))).alias("quantile"))
    return merged.select(*keys, "column", n, F.explode(paired).alias("q")).select(
        *keys, "column", F.col("q.prob").alias("prob"), "n", F.col("q.quantile").alias("quantile"))


def rank_gap(df: DataFrame, quantiles: DataFrame, columns: list[str]) -> DataFrame:
    """(column, prob, n, quantile, gap): how far the share of values at or below each quantile is from its rank, by the exact counts.

    ``quantiles`` has a few rows for each column, so it goes to every task.
    """
    long = unpivot(df, columns, "double").where("value is not null and not isnan(value)")
    q, x = F.col("quantile"), F.col("value")
    seen = long.join(F.broadcast(quantiles), "column").groupBy("column", "prob", "n", "quantile").agg(
        (F.count_if(x < q) / F.count(F.lit(1))).alias("_below"), (F.count_if(x <= q) / F.count(F.lit(1))).alias("_at"))
    return seen.select("column", "prob", "n", "quantile",
                       F.greatest(F.col("_below") - F.col("prob"), F.col("prob") - F.col("_at"), F.lit(0.0)).alias("gap"))


def key_sketches(tables: dict[str, DataFrame], keys: dict[str, list[str]], lg_keys: int = LG_KEYS) -> DataFrame:
    """(table_name, key, n_rows, sketch): all key columns of a table from one scan of it."""
    def of(name: str, columns: list[str]) -> DataFrame:
        seen = tables[name].agg(F.count(F.lit(1)).alias("n_rows"), *[F.theta_sketch_agg(F.col(c), lg_keys).alias(c) for c in columns])
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("sketch")) for c in columns])).alias("k")
        return seen.select(F.lit(name).alias("table_name"), "n_rows", each).select("table_name", "k.key", "n_rows", "k.sketch")

    return union_all([of(name, columns) for name, columns in keys.items()])


def merged_keys(sketches: DataFrame, lg_keys: int = LG_KEYS) -> DataFrame:
    """(table_name, key, n_rows, sketch) over all stored increments."""
    return sketches.groupBy("table_name", "key").agg(
        F.sum("n_rows").alias("n_rows"), F.theta_union_agg("sketch", lg_keys).alias("sketch"))


def key_overlap(merged: DataFrame, references: list[tuple[str, str, str]], lg_keys: int = LG_KEYS) -> DataFrame:
    """For each (child table, parent table, key): keys of both, common keys, orphans of the child and childless keys of the parent, as
    estimates, with their bounds. The sketches are the only input: no table is joined."""
    spark = merged.sparkSession
    pairs = spark.createDataFrame(references, "child string, parent string, key string")
    side = lambda name, s: merged.select(F.col("table_name").alias(name), "key", F.col("sketch").alias(s))
    both = F.broadcast(pairs).join(side("child", "c"), ["child", "key"]).join(side("parent", "p"), ["parent", "key"])
    size = F.theta_sketch_estimate
    figures = both.select(
        "child", "parent", "key", size("c").alias("child_keys"), size("p").alias("parent_keys"),
        size(F.theta_intersection("c", "p")).alias("common"), size(F.theta_difference("c", "p")).alias("orphans"),
        size(F.theta_difference("p", "c")).alias("childless"))
    largest = F.greatest("child_keys", "parent_keys")
    return figures.select("*", *[
        key_error(F.col(c), largest, lg_keys).alias(f"{c}_error") for c in ("child_keys", "parent_keys", "common", "orphans", "childless")])


def read_increments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
