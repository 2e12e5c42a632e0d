"""Counts, coverage and cardinality reports. Each is one pass of map-side-combined aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.fixed_values import COMPLETION_TOKEN_PRICE, LABEL_COLS, PROMPT_TOKEN_PRICE
from tarnish.functions import scalars as S
from tarnish.functions.shapes import unpivot


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def ingest_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table plus one total row."""
    rows = union_all([
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"))
        for name, df in tables.items()
    ])
    return rows.select(
        F.explode(F.array("table_name", F.lit("TOTAL"))).alias("table_name"), "n_rows", "n_cols"
    ).groupBy("table_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_cols").alias("n_cols"))


def frequency(df: DataFrame, column: str, report: str | None = None) -> DataFrame:
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if report is None:
        return out
    return out.select(F.lit(report).alias("report"), F.col(column).cast("string").alias("level"), "n")


def split_summary(split: DataFrame) -> DataFrame:
    """One row: counts of every split, total, fractions to four places."""
    names = ["train", "val", "test", "drop"]
    counts = split.agg(
        F.count(F.lit(1)).alias("n_total"),
        *[F.count_if(F.col("split") == n).alias(f"n_{n}") for n in names])
    return counts.select(
        "*", *[F.round(F.try_divide(F.col(f"n_{n}"), F.col("n_total")), 4).alias(f"frac_{n}") for n in names[:3]])


def label_coverage(features: DataFrame) -> DataFrame:
    """Non-null count and positive share per label."""
    return unpivot(features, LABEL_COLS, "int").groupBy(F.col("column").alias("label")).agg(
        F.count("value").alias("n"), F.count(F.lit(1)).alias("n_total"),
        F.round(F.avg("value"), 6).alias("prevalence"))


def orders_by_period(orders: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    """Orders per year and per quarter, from one aggregation of the quarters."""
    year = F.year(ts).cast("string")
    quarters = orders.filter(F.col(ts).isNotNull()).groupBy(
        year.alias("year"), F.concat(year, F.lit("Q"), F.quarter(ts).cast("string")).alias("quarter")
    ).agg(F.count(F.lit(1)).alias("n"))
    periods = F.explode(F.array(
        F.struct(F.lit("year").alias("kind"), F.col("year").alias("period")),
        F.struct(F.lit("quarter").alias("kind"), F.col("quarter").alias("period")))).alias("p")
    return quarters.select(periods, "n").groupBy("p.kind", "p.period").agg(F.sum("n").alias("n")).orderBy(
        "kind", "period")


def date_range(orders: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    return orders.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def missing_timestamps(orders: DataFrame, ts: str) -> DataFrame:
    return orders.agg(F.count_if(F.col(ts).isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_total"))


def _distinct(column: str, approx: bool) -> Column:
    return F.approx_count_distinct(column) if approx else F.count_distinct(column)


def join_cardinality(tables: dict[str, DataFrame], approx: bool = False) -> DataFrame:
    """Long form: one named figure per row, so no one-row tables need to be crossed."""
    def figure(name: str, df: DataFrame, value: Column) -> DataFrame:
        return df.agg(value.cast("bigint").alias("value")).select(F.lit(name).alias("figure"), "value")

    rows = F.count(F.lit(1))
    return union_all([
        figure("customers_in_orders", tables["orders"], _distinct("customer_id", approx)),
        figure("customers", tables["customers"], rows),
        figure("orders", tables["orders"], _distinct("order_id", approx)),
        figure("reviews", tables["order_reviews"], rows),
        figure("items", tables["order_items"], rows),
        figure("products_used", tables["order_items"], _distinct("product_id", approx)),
        figure("products", tables["products"], rows),
        figure("sellers_active", tables["order_items"], _distinct("seller_id", approx)),
        figure("sellers", tables["sellers"], rows),
    ])


def join_ratios(cardinality: DataFrame) -> DataFrame:
    """Reviews and items per order, from the long form (nine rows)."""
    pick = lambda name: F.max(F.when(F.col("figure") == name, F.col("value")))
    return cardinality.agg(
        F.round(F.try_divide(pick("reviews"), pick("orders")), 6).alias("reviews_per_order"),
        F.round(F.try_divide(pick("items"), pick("orders")), 6).alias("items_per_order"))


def eda_summary(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """The one-row summary record; each input contributes disjoint partial figures, combined by one aggregation."""
    late = S.label_late(F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date"))
    high = S.label_high_review(F.col("review_score"))
    null = lambda kind: F.lit(None).cast(kind)
    o = orders.agg(
        F.count(F.lit(1)).alias("n_orders"), F.count(late).alias("n_orders_used_T2"),
        F.round(F.avg(late), 6).alias("T2_positive_prev"),
        F.min("order_purchase_timestamp").alias("purchase_min"),
        F.max("order_purchase_timestamp").alias("purchase_max"),
    ).withColumns({"n_reviews_used_T1": null("bigint"), "T1_positive_prev": null("double")})
    r = reviews.agg(
        F.count(high).alias("n_reviews_used_T1"), F.round(F.avg(high), 6).alias("T1_positive_prev"),
    ).withColumns({
        "n_orders": null("bigint"), "n_orders_used_T2": null("bigint"), "T2_positive_prev": null("double"),
        "purchase_min": null("timestamp_ntz"), "purchase_max": null("timestamp_ntz")})
    return o.unionByName(r).agg(*[F.max(c).alias(c) for c in o.columns])


def token_costs(calls: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Token totals and estimated price of a call log."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = calls.groupBy(*(keys or [])).agg(
        total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"),
        total("total_tokens").alias("total_tokens"))
    cost = F.col("prompt_tokens") * PROMPT_TOKEN_PRICE + F.col("completion_tokens") * COMPLETION_TOKEN_PRICE
    return out.withColumn("cost", F.round(cost, 6))


def seed_summary(per_seed: DataFrame, keys: list[str], metrics: list[str], places: int = 4) -> DataFrame:
    """Mean and sample standard deviation over seeds."""
    return per_seed.groupBy(*keys).agg(*[
        F.round(f(m), places).alias(f"{m}_{tag}") for m in metrics
        for f, tag in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def pilot_report(scored: DataFrame, label: str, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, recall per class and predicted-positive rate over the valid answers only."""
    p, y = F.col("prediction"), F.col(label)
    ok = S.valid_prediction(p)
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    n = lambda cond: F.count_if(cond)
    return scored.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"),
        n(ok).alias("parsed_ok"),
        share(n(ok & (p == y)), n(ok)).alias("accuracy"),
        share(n(ok & (p == 1) & (y == 1)), n(ok & (y == 1))).alias("tpr"),
        share(n(ok & (p == 0) & (y == 0)), n(ok & (y == 0))).alias("tnr"),
        n(ok & (p == 1)).alias("predicted_positive"))
