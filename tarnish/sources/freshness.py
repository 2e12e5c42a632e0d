"""The state of input files, as a key for what is derived from them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def input_state(spark: SparkSession, paths: list[str]) -> str:
    """A key that changes when a file below the paths is added, removed, resized or written anew; no content is read.

    The files are listed by Spark, so any store that it reads will do, and combined by sums, so their order doesn't matter.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    key = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
                     F.coalesce(F.bit_xor(key), F.lit(0)).alias("mixed"), F.coalesce(F.sum(key.cast("decimal(38,0)")), F.lit(0)).alias("total")).first()
    return f"{seen['n']}-{seen['bytes']}-{seen['mixed'] & (2**64 - 1):016x}-{int(seen['total']) & (2**64 - 1):016x}"
