"""Seeded, exactly sized samples that scale with the pool and with the sample.

A row's rank is its hash. A histogram of the hashes (a fixed number of buckets per
stratum) tells in which bucket the quota ends; all rows below it are taken as they are
and only the rows of that one bucket are ranked. No task ever sorts a whole stratum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnish.functions.keyed_hash import PRIME, row_hash

BUCKETS = 1024


def _with_rank_bucket(df: DataFrame, key: str) -> DataFrame:
    hashed = df.select("*", row_hash(F.col("seed"), F.col(key)).alias("_h"))
    return hashed.withColumn("_bucket", F.floor(F.col("_h") * BUCKETS / F.lit(PRIME)).cast("int"))


def _cut(counts: dict[int, int], quota: int) -> tuple[int, int]:
    """The bucket in which ``quota`` rows are reached, and how many of its rows still belong."""
    taken = 0
    for bucket in range(BUCKETS):
        here = counts.get(bucket, 0)
        if taken + here >= quota:
            return bucket, quota - taken
        taken += here
    return BUCKETS, 0


def _take(ranked: DataFrame, key: str, cuts: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    def lookup(i: int) -> Column:
        pairs = [((F.col("seed") == s) & (F.col("_stratum") == y), F.lit(v[i])) for (s, y), v in cuts.items()]
        return reduce(lambda chain, p: chain.when(*p), pairs[1:], F.when(*pairs[0])).otherwise(F.lit(-1))

    w = Window.partitionBy("seed", "_stratum", "_bucket").orderBy("_h", key)
    inside = ranked.withColumns({"_cut": lookup(0), "_rest": lookup(1)}).filter(F.col("_bucket") <= F.col("_cut"))
    return inside.withColumn("_rn", F.row_number().over(w)).filter(
        (F.col("_bucket") < F.col("_cut")) | (F.col("_rn") <= F.col("_rest"))
    ).drop("_cut", "_rest", "_rn", "_bucket")


def class_quotas(mode: str, n: int | None, pos: int, neg: int) -> tuple[int, int]:
    """Positives and negatives to draw. strict: n//2 and the rest, or an error; capped: as many as there are;
    pool: everything when n is None or reaches the pool."""
    if mode == "pool" and (n is None or n >= pos + neg):
        return pos, neg
    half = n // 2
    if mode == "strict":
        if pos < half or neg < n - half:
            raise ValueError(f"sample of {n} needs {half} positives and {n - half} negatives, found {pos} and {neg}")
        return half, n - half
    take_pos = min(half, pos)
    return take_pos, min(n - take_pos, neg)


def stratified_samples(
    pool: DataFrame, label: str, n: int | None, seeds: list[int], key: str = "order_id", mode: str = "capped"
) -> DataFrame:
    """(seed, key, label) rows of one sample per seed, all seeds in one pass.

    ``pool`` is already filtered to its split; rows without a label are left out.
    """
    narrow = pool.filter(F.col(label).isNotNull()).select(
        key, label, F.col(label).cast("int").alias("_stratum"),
        F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
    ranked = _with_rank_bucket(narrow, key)
    hist: dict[tuple[int, int], dict[int, int]] = {(s, y): {} for s in seeds for y in (0, 1)}
    for r in ranked.groupBy("seed", "_stratum", "_bucket").count().collect():
        hist[(r["seed"], r["_stratum"])][r["_bucket"]] = r["count"]
    cuts = {}
    for s in seeds:
        quota = class_quotas(mode, n, sum(hist[(s, 1)].values()), sum(hist[(s, 0)].values()))
        cuts[(s, 1)], cuts[(s, 0)] = _cut(hist[(s, 1)], quota[0]), _cut(hist[(s, 0)], quota[1])
    return _take(ranked, key, cuts).drop("_h", "_stratum")


def simple_sample(df: DataFrame, n: int, seed: int, key: str = "order_id") -> DataFrame:
    """Keys of exactly min(n, rows) rows, drawn without replacement."""
    narrow = df.select(key, F.lit(0).alias("_stratum"), F.lit(int(seed)).alias("seed"))
    ranked = _with_rank_bucket(narrow, key)
    counts = {r["_bucket"]: r["count"] for r in ranked.groupBy("_bucket").count().collect()}
    return _take(ranked, key, {(seed, 0): _cut(counts, n)}).drop("_h", "_stratum")


def seeded_order(df: DataFrame, seed: int, key: str = "order_id") -> list[Column]:
    """Sort columns of a seeded shuffle."""
    return [row_hash(seed, F.col(key)), F.col(key)]


def rows_of(df: DataFrame, sample: DataFrame, key: str = "order_id") -> DataFrame:
    """The rows of ``df`` whose key is in the sample: the same rows under every condition."""
    return df.join(sample.select(key), key, "left_semi")
