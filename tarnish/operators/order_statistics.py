"""Exact rank statistics without ever sorting one group in one task.

Approximate quantiles of all values, taken once, cut the value range into ways of about
equal weight whichever group they belong to; exact work then happens inside each
(group, range), on counted values so that ties collapse, and the ranges are chained by
their totals. The cuts only steer the split: any cuts give the same result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WAYS = 256
LOCAL_ROWS = 10_000


def range_cuts(df: DataFrame, value: str, ways: int = WAYS) -> list[float]:
    """At most ``ways`` - 1 increasing cut points, from a bounded sketch."""
    if ways <= 1:
        return []
    probs = F.array(*[F.lit(i / ways) for i in range(1, ways)])
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, F.lit(4 * ways)).alias("q")).first()["q"]
    return sorted({float(q) for q in found or [] if q == q and abs(q) != float("inf")})


def with_range(df: DataFrame, value: str, cuts: list[float], out: str = "_range") -> DataFrame:
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=f"{out}_in", outputCol=f"{out}_out", handleInvalid="keep")
    ready = df.withColumn(f"{out}_in", F.col(value).cast("double"))
    return cut.transform(ready).withColumn(out, F.col(f"{out}_out").cast("int")).drop(f"{out}_in", f"{out}_out")


def _with_known_size(small: DataFrame) -> DataFrame:
    """The same rows as a local table when there are few. Spark does not know the size of such a table, so it is marked to be
    broadcast: else the large side is shuffled and sorted by keys of which one may hold a whole column."""
    rows = small.limit(LOCAL_ROWS + 1).collect()
    return small if len(rows) > LOCAL_ROWS else F.broadcast(small.sparkSession.createDataFrame(rows, small.schema))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], ways: int = WAYS
) -> DataFrame:
    """(keys…, prob, quantile) with linear interpolation between neighbours, for every group."""
    filled = df.filter(F.col(value).isNotNull())
    ranged = with_range(filled.select(*keys, value), value, range_cuts(filled, value, ways))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_in"))
        .withColumns({
            "_before": F.coalesce(F.sum("_in").over(before), F.lit(0)),
            "_total": F.sum("_in").over(Window.partitionBy(*keys)),
        })
    )
    place = lambda p: (F.col("_total") - 1) * F.lit(float(p))
    targets = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.lit(side).alias("side"),
                 f(place(p)).cast("bigint").alias("rank"), (place(p) - F.floor(place(p))).alias("part"))
        for p in probs for side, f in (("lo", F.floor), ("hi", F.ceil))])
    wanted = ranges.withColumn("_targets", F.filter(targets, lambda t: (t["rank"] >= F.col("_before")) & (
        t["rank"] < F.col("_before") + F.col("_in")))).filter(F.size("_targets") > 0).select(
        *keys, "_range", "_before", "_targets")
    # only values of the few ranges that hold a wanted rank are shuffled
    needed = _with_known_size(wanted)
    counted = ranged.join(needed.select(*keys, "_range"), [*keys, "_range"], "left_semi").groupBy(
        *keys, "_range", value).agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(needed, [*keys, "_range"]).withColumn(
        "_start", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    hits = placed.select(*keys, value, F.explode(F.filter("_targets", lambda t: (t["rank"] >= F.col("_start")) & (
        t["rank"] < F.col("_start") + F.col("_n")))).alias("t"))
    side = lambda name: F.max(F.when(F.col("t.side") == name, F.col(value).cast("double")))
    return hits.groupBy(*keys, F.col("t.prob").alias("prob")).agg(
        (side("lo") + (side("hi") - side("lo")) * F.max("t.part")).alias("quantile"))


def auroc(df: DataFrame, keys: list[str], label: str, score: str, ways: int = WAYS) -> DataFrame:
    """(keys…, n_pos, n_neg, auroc): area under the ROC curve, ties half; NULL when a class is absent.

    ``ways=1`` skips the split where each group is known to be small, as in a sweep cell.
    """
    used = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    tied = used.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    ranged = with_range(tied, score, range_cuts(used, score, ways))
    inside = Window.partitionBy(*keys, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    per_range = ranged.withColumn(
        "_wins", F.col("_pos").cast("double") * (below.cast("double") + F.col("_neg") / 2.0)
    ).groupBy(*keys, "_range").agg(
        F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"), F.sum("_wins").alias("_wins"))
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    chained = per_range.withColumn(
        "_wins", F.col("_wins") + F.col("_pos").cast("double") * F.coalesce(F.sum("_neg").over(across), F.lit(0)))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return chained.groupBy(*keys).agg(
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"),
        F.try_divide(F.sum("_wins"), pairs).alias("auroc"))
