"""Registered queries: sketches stored by increment and merged, beside the exact figures that they stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnish.functions import scalars as S
from tarnish.operators import sketches as K
from tarnish.plans.sweep_queries import train_t2
from tarnish.session import scratch_path
from tarnish.sources import adapter as A
from tarnish.sources.silver import silver

PROBS = [0.1, 0.5, 0.9]
KEYS = {"orders": ["order_id", "customer_id"], "customers": ["customer_id"], "order_items": ["order_id", "product_id", "seller_id"],
        "order_payments": ["order_id"], "order_reviews": ["order_id"], "products": ["product_id"], "sellers": ["seller_id"]}
#: (child table, parent table, key)
REFERENCES = [("orders", "customers", "customer_id"), ("order_items", "orders", "order_id"), ("order_payments", "orders", "order_id"),
              ("order_reviews", "orders", "order_id"), ("order_items", "products", "product_id"), ("order_items", "sellers", "seller_id")]


def a10_sketched(spark, sf):
    """Quantiles of the training rows from sketches of two increments, one of them stored twice, and whether their rank error keeps its bound."""
    rows, columns = train_t2(spark, sf), S.numeric_columns(silver(spark, sf))
    path = scratch_path(spark, "column-sketches")
    half = F.pmod(F.xxhash64("order_id"), F.lit(2)) == 0
    for increment, part in (("a", half), ("b", ~half), ("a", half)):
        K.store_increment(K.column_sketches(rows.where(part), columns, ["split"]), path, increment)
    merged = K.merged_quantiles(K.read_increments(spark, path), ["split"], PROBS).drop("split")
    return K.rank_gap(rows, merged, columns).select("column", "prob", "n", (F.col("gap") <= K.rank_error()).alias("within_bound"))


def a9_sketched(spark, sf):
    """Orphans of every foreign key, exact and from merged key sketches: the estimates must keep their bounds."""
    tables, path = A.canonical_tables(spark, sf), scratch_path(spark, "key-sketches")
    K.store_increment(K.key_sketches(tables, KEYS), path, "all")
    estimate = K.key_overlap(K.merged_keys(K.read_increments(spark, path)), REFERENCES)
    # exact, without joining any two tables' rows: each key once, with the tables that hold it
    held = []
    for child, parent, key in REFERENCES:
        for role, name in (("child", child), ("parent", parent)):
            held.append(tables[name].where(F.col(key).isNotNull()).select(
                F.lit(child).alias("child"), F.lit(parent).alias("parent"), F.lit(key).alias("key"), F.col(key).alias("value"),
                F.lit(role == "child").alias("c"), F.lit(role == "parent").alias("p")))
    each = K.union_all(held).groupBy("child", "parent", "key", "value").agg(F.bool_or("c").alias("c"), F.bool_or("p").alias("p"))
    exact = each.groupBy("child", "parent", "key").agg(
        F.count_if("c").alias("child_keys"), F.count_if("p").alias("parent_keys"), F.count_if(F.col("c") & F.col("p")).alias("common"),
        F.count_if(F.col("c") & ~F.col("p")).alias("orphans"), F.count_if(~F.col("c") & F.col("p")).alias("childless"))
    figures = ["child_keys", "parent_keys", "common", "orphans", "childless"]
    both = exact.alias("x").join(estimate.alias("e"), ["child", "parent", "key"])
    within = [F.abs(F.col(f"x.{f}") - F.col(f"e.{f}")) <= F.col(f"e.{f}_error") for f in figures]
    return both.select("child", "parent", "key", *[F.col(f"x.{f}").alias(f) for f in figures],
                       F.forall(F.array(*within), lambda w: w).alias("within_bound"))


QUERIES = {
    "a10_sketched_quantiles": a10_sketched,
    "a9_sketched_orphans": a9_sketched,
}
