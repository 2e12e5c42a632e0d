"""Merged sketches against exact figures: bounds hold, increments replace themselves, empty input is defined."""

import random

from pyspark.sql import functions as F

from tarnish.operators import sketches as K
from tarnish.session import scratch_path


def test_quantiles_merge_over_increments(spark):
    r = random.Random(5)
    data = [("x" if i % 3 else "y", r.gauss(0, 1) if i % 7 else 2.5, None) for i in range(40_000)] + [("x", float("nan"), None)]
    df = spark.createDataFrame(data, "k string, v double, empty double").repartition(8)
    path = scratch_path(spark, "sketches")
    part = F.pmod(F.hash("v"), F.lit(3))
    for i in (0, 1, 2, 1):
        K.store_increment(K.column_sketches(df.where(part == i), ["v", "empty"], ["k"]), path, f"p{i}")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = K.merged_quantiles(K.read_increments(spark, path), ["k"], probs).collect()
    assert len(got) == 2 * 2 * len(probs)
    for k in ("x", "y"):
        values = sorted(v for g, v, _ in data if g == k and v == v)
        for g in (g for g in got if g["k"] == k and g["column"] == "v"):
            assert g["n"] == len(values)
            below = sum(v < g["quantile"] for v in values) / len(values)
            at = sum(v <= g["quantile"] for v in values) / len(values)
            assert below - K.rank_error() <= g["prob"] <= at + K.rank_error()
    assert all(g["quantile"] is None and g["n"] == 0 for g in got if g["column"] == "empty")


def test_rank_gap_is_zero_for_exact_and_positive_for_wrong_quantiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    asked = spark.createDataFrame([("v", 0.5, 100, 49.0), ("v", 0.9, 100, 49.0)], "column string, prob double, n long, quantile double")
    gap = {r["prob"]: r["gap"] for r in K.rank_gap(df, asked, ["v"]).collect()}
    assert gap[0.5] == 0 and abs(gap[0.9] - 0.4) < 1e-9


def overlap(spark, child, parent, lg):
    tables = {"c": spark.createDataFrame([(x,) for x in child], "key long"), "p": spark.createDataFrame([(x,) for x in parent], "key long")}
    path = scratch_path(spark, "keys")
    for i in range(2):
        some = {name: df.where(F.pmod(F.hash("key"), F.lit(2)) == i) for name, df in tables.items()}
        K.store_increment(K.key_sketches(some, {"c": ["key"], "p": ["key"]}, lg), path, str(i))
    return K.key_overlap(K.merged_keys(K.read_increments(spark, path), lg), [("c", "p", "key")], lg).first()


def test_key_overlap_is_exact_while_keys_fit(spark):
    got = overlap(spark, [1, 1, 2, 3, None, 9], [2, 3, 4], 10)
    assert [got[c] for c in ("child_keys", "parent_keys", "common", "orphans", "childless")] == [4, 3, 2, 2, 1]
    assert got["orphans_error"] == 0
    empty = overlap(spark, [], [None], 10)
    assert [empty[c] for c in ("child_keys", "parent_keys", "common", "orphans", "childless")] == [0, 0, 0, 0, 0]


def test_key_overlap_keeps_its_bound_beyond(spark):
    got = overlap(spark, list(range(0, 30_000)), list(range(10_000, 60_000)), 10)
    for c, exact in {"child_keys": 30_000, "parent_keys": 50_000, "common": 20_000, "orphans": 10_000, "childless": 30_000}.items():
        assert 0 < got[f"{c}_error"] < exact / 2 and abs(got[c] - exact) <= got[f"{c}_error"]
