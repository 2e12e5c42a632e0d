"""Exact quantiles, area under the curve and samples, against brute force, with hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tarnish.functions.keyed_hash import PRIME
from tarnish.operators import metrics as M
from tarnish.operators import sampling as W
from tarnish.operators.dense_index import dense_index
from tarnish.operators.order_statistics import auroc, exact_quantiles


def groups():
    r = random.Random(3)
    data = [("hot", round(r.gauss(0, 1), 3)) for _ in range(3000)] + [("one", 5.0)] * 400
    data += [("wide", r.uniform(-1e9, 1e9)) for _ in range(57)] + [("single", 1.5), ("gap", None), ("gap", 2.0), ("none", None)]
    return data


@pytest.mark.parametrize("ways", [1, 2, 7, 256])
def test_quantiles(spark, ways):
    data = groups()
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["k"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["k"], "v", probs, ways).collect()}
    for k in {d[0] for d in data}:
        values = [v for g, v in data if g == k and v is not None]
        for p in probs:
            if values:
                assert got[(k, p)] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
            else:
                assert (k, p) not in got


def test_the_ranges_of_a_quantile_meet_the_values_without_a_shuffle(spark):
    df = spark.createDataFrame([(g, float(i % 900)) for i in range(9000) for g in "ab"], "k string, v double").repartition(4)
    plan = exact_quantiles(df, ["k"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("ways", [1, 3, 64])
def test_auroc(spark, ways):
    r = random.Random(5)
    data = [("hot", r.randint(0, 1), round(r.random(), 2)) for _ in range(2000)]
    data += [("tied", y, 0.5) for y in (0, 1, 1, 0)] + [("oneclass", 1, r.random()) for _ in range(9)]
    data += [("sharp", int(i > 20), float(i)) for i in range(40)] + [("nulls", 1, None), ("nulls", 0, 0.1), ("nulls", None, 0.2)]
    df = spark.createDataFrame(data, "k string, y int, p double").repartition(5)
    got = {r["k"]: r["auroc"] for r in auroc(df, ["k"], "y", "p", ways).collect()}
    for k in {d[0] for d in data}:
        pos = [p for g, y, p in data if g == k and y == 1 and p is not None]
        neg = [p for g, y, p in data if g == k and y == 0 and p is not None]
        want = None
        if pos and neg:
            want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert got[k] == (None if want is None else pytest.approx(want, abs=1e-12))


def test_auroc_of_everything(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.6)], "y int, p double")
    assert auroc(df, [], "y", "p").first()["auroc"] == 0.75


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.8), (1, 0, 0.2), (0, 0, 0.3), (0, -1, 0.5), (0, 1, 0.9)], "y int, p int, s double")
    m = M.classification_metrics(df.withColumn("ok", F.col("p") >= 0), [], "y", "p", "s", "ok").first()
    assert (m["n"], m["n_pos"], m["n_neg"], m["parse_ok"]) == (5, 2, 3, 4)
    assert m["f1"] == 0.5 and m["tpr"] == 0.5 and m["tnr"] == pytest.approx(2 / 3)
    assert m["brier"] == pytest.approx((0.04 + 0.64 + 0.09 + 0.25 + 0.81) / 5)
    none = M.classification_metrics(df.filter("y = 0 and p = 0").withColumn("ok", F.lit(True)), [], "y", "p", ok="ok").first()
    assert (none["f1"], none["tpr"], none["tnr"]) == (0.0, 0.0, 1.0)


def test_ratios(spark):
    df = spark.createDataFrame([(0.1, 0.3), (0.3, -0.1), (0.0, 0.2), (0.2, 1e-7), (0.0, 0.0), (None, 0.1)], "m double, a double")
    got = rows(df.select(F.round(M.ratio_max(F.col("m"), F.col("a")), 6), M.ratio_status(F.col("m"), F.col("a"))))
    inf = float("inf")
    assert got == [(3.0, "finite"), (3.0, "finite"), (inf, "ml_zero"), (inf, "agent_zero"), (inf, "both_zero"),
                   (None, "undefined")]


def hash_of(seed, key):
    import hashlib

    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16) % PRIME


@pytest.mark.parametrize("n,mode", [(20, "strict"), (31, "capped"), (300, "capped"), (4000, "capped"), (9999, "pool"), (0, "capped")])
def test_samples_are_the_lowest_hashes(spark, n, mode):
    data = [(i, 1 if i % 9 == 0 else 0 if i % 9 < 8 else None) for i in range(3000)]
    df = spark.createDataFrame(data, "order_id bigint, y int").repartition(5)
    got = W.stratified_samples(df, "y", n, [1, 2], mode=mode).collect()
    pos = [k for k, y in data if y == 1]
    neg = [k for k, y in data if y == 0]
    q = W.class_quotas(mode, n, len(pos), len(neg))
    for s in (1, 2):
        want = set()
        for pool, k in ((pos, q[0]), (neg, q[1])):
            want |= set(sorted(pool, key=lambda x: (hash_of(s, x), x))[:k])
        mine = [r["order_id"] for r in got if r["seed"] == s]
        assert len(mine) == len(set(mine)) and set(mine) == want


def test_short_class(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(13)], "order_id bigint, y int")
    with pytest.raises(ValueError):
        W.stratified_samples(df, "y", 8, [1], mode="strict")
    got = W.stratified_samples(df, "y", 8, [1], mode="capped").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {1: 3, 0: 5}
    assert W.stratified_samples(df, "y", None, [1], mode="pool").count() == 13


def test_simple_sample(spark):
    df = spark.range(5000).withColumnRenamed("id", "order_id")
    got = {r["order_id"] for r in W.simple_sample(df, 700, 4).collect()}
    assert got == set(sorted(range(5000), key=lambda k: (hash_of(4, k), k))[:700])
    assert W.simple_sample(df, 9999, 4).count() == 5000


@pytest.mark.parametrize("buckets", [1, 16, 4096])
def test_dense_index_is_a_bijection(spark, buckets):
    df = spark.range(1234).withColumnRenamed("id", "k").repartition(7)
    index = dense_index(df, "k", buckets=buckets)
    got = index.rows.collect()
    assert index.n == 1234 and sorted(r["_idx"] for r in got) == list(range(1234))
    assert sorted(r["k"] for r in got) == list(range(1234))
