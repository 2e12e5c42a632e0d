"""A dense row number 0 … n-1 without a single sorted stream.

Rows fall into a fixed number of buckets by a hash of their key. Bucket sizes are a
small, bounded table, so their running total gives each bucket's offset, and the
numbering inside a bucket is a window over that bucket alone. The order is that of
(bucket, key), which depends on the keys only. ``sorted_index`` numbers in sort order instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnish.functions.keyed_hash import row_hash
from tarnish.session import materialize, shuffles_removed

BUCKETS = 4096


@dataclass
class DenseIndex:
    rows: DataFrame
    n: int
    largest: int


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return (row_hash(0, key) % buckets).cast("int")


def dense_index(df: DataFrame, key: str, out: str = "_idx", buckets: int = BUCKETS, tie: str | None = None,
                weight: str | None = None) -> DenseIndex:
    """Narrow (key, index) rows, their number and the largest weight. At most ``buckets`` counts reach the driver.

    ``tie`` orders rows of equal keys; a row with a ``weight`` takes that many places, from its index on. Both columns are kept.
    """
    extra = [c for c in (tie, weight) if c]
    places = F.col(weight) if weight else F.lit(1).cast("bigint")
    # a NULL key hashes like any other
    keyed = df.select(key, *extra, F.coalesce(bucket_of(F.col(key), buckets), F.lit(0)).alias("_bucket"))
    with shuffles_removed(df.sparkSession):
        seen = keyed.groupBy("_bucket").agg(F.sum(places), F.max(places)).collect()
    sizes = {bucket: n for bucket, n, _ in seen}
    offsets = [0, *accumulate(sizes.get(b, 0) for b in range(buckets))]
    w = Window.partitionBy("_bucket").orderBy(*[c for c in (key, tie) if c]).rowsBetween(Window.unboundedPreceding, 0)
    at = element(offsets[:-1], F.col("_bucket")) + F.sum(places).over(w) - places
    return DenseIndex(keyed.select(key, *extra, at.alias(out)), offsets[-1], max((most for _, _, most in seen), default=0))


def element(values: list[int], at: Column) -> Column:
    """The value at a place of a literal list, written as one text."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), at + 1)


def sorted_index(df: DataFrame, columns: list[str], name: str, out: str = "_idx") -> DataFrame:
    """Distinct rows numbered 0 … n-1 in ascending order of ``columns``.

    Ranges are sorted apart and written; their sizes, one for each written range, give the offsets.
    """
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(
        "_place", F.monotonically_increasing_id())
    stored = materialize(placed, name).withColumn("_range", F.shiftright("_place", 33).cast("int"))
    sizes = dict(stored.groupBy("_range").count().collect())
    offsets = [0, *accumulate(sizes.get(r, 0) for r in range(max(sizes, default=0) + 1))]
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn(out, element(offsets[:-1], F.col("_range")) + inside).drop("_place", "_range")
