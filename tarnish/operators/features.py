"""The one-row-per-order feature table, as one lazy plan.

Items, payments and reviews are reduced to one row per order before they meet the
orders, so each of the three joins finds both sides partitioned by ``order_id``.
No side is hinted: dimension tables grow with the business, so Spark decides from
their size, and a skewed stream side is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnish import fixed_values as fv
from tarnish.functions import scalars as S

#: Rows of an order that one task takes together.
MOST_ROWS = 10_000


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the stated order. Each task passes on at most one row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def items_with_dimensions(items: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    dims = products.select(
        "product_id", "product_category_name", "product_weight_g",
        S.box_volume("product_length_cm", "product_height_cm", "product_width_cm").alias("product_volume_cm3"),
    )
    return items.join(dims, "product_id", "left").join(
        sellers.select("seller_id", "seller_state"), "seller_id", "left")


def modal_value(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Most frequent non-null value per key, the smallest on ties; NULL for an all-null key.

    Counts per (key, value) first: a key holding a third of all rows reaches its
    final task as one pre-aggregated row per distinct value and map task.
    """
    return df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n")).groupBy(key).agg(
        _most_frequent(value, "_n").alias(out))


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _most_frequent(value: str, n: str) -> Column:
    """The value with the largest count among pre-counted rows, the smallest on ties; NULLs do not count."""
    counted = F.when(F.col(value).isNotNull(), F.struct((-F.col(n)).alias("n"), F.col(value).alias("v")))
    return F.min(counted).getField("v")


def _mean(total: Column, n: Column) -> Column:
    return F.try_divide(total.cast("double"), n)


def _product_dimensions(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id", "product_category_name", "product_weight_g",
        S.box_volume("product_length_cm", "product_height_cm", "product_width_cm").alias("product_volume_cm3"))


def _product_side(items: DataFrame, products: DataFrame) -> DataFrame:
    """Item and product measures per order: (order, product) → (order, category) → order."""
    per_product = items.groupBy("order_id", "product_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(S.money_units(F.col("price"))).alias("_price"),
        F.sum(S.money_units(F.col("freight_value"))).alias("_freight"),
        F.max("price").alias("_max"), F.count("price").alias("_n_price"))
    dims = _product_dimensions(products)
    n = F.col("_n")
    times = lambda c: F.sum(n * F.col(c))
    filled = lambda c: F.sum(F.when(F.col(c).isNotNull(), n))
    per_category = per_product.join(dims, "product_id", "left").groupBy("order_id", "product_category_name").agg(
        F.sum("_n").alias("_n"), F.sum("_price").alias("_price"), F.sum("_freight").alias("_freight"),
        F.max("_max").alias("_max"), F.sum("_n_price").alias("_n_price"), F.count("product_id").alias("_products"),
        times("product_weight_g").alias("_weight"), filled("product_weight_g").alias("_n_weight"),
        times("product_volume_cm3").alias("_volume"), filled("product_volume_cm3").alias("_n_volume"))
    return per_category.groupBy("order_id").agg(
        F.sum("_n").alias("n_items"), _total("_price").alias("_price"), _total("_freight").alias("_freight"),
        F.max("_max").alias("max_price"), F.sum("_n_price").alias("_n_price"),
        F.sum("_products").alias("n_unique_products"),
        _mean(F.sum("_weight"), F.sum("_n_weight")).alias("mean_product_weight_g"),
        _mean(F.sum("_volume"), F.sum("_n_volume")).alias("mean_product_volume_cm3"),
        _most_frequent("product_category_name", "_n").alias("dominant_category"))


def _seller_side(items: DataFrame, sellers: DataFrame) -> DataFrame:
    """Distinct sellers and seller states per order: (order, seller) → (order, state) → order."""
    per_seller = items.select("order_id", "seller_id").distinct()
    per_state = per_seller.join(sellers.select("seller_id", "seller_state"), "seller_id", "left").groupBy(
        "order_id", "seller_state").agg(F.count("seller_id").alias("_sellers"))
    return per_state.groupBy("order_id").agg(
        F.sum("_sellers").alias("n_unique_sellers"), F.count("seller_state").alias("n_seller_states"))


def _copies(dims: DataFrame, key: str, value: str, *more: Column) -> DataFrame:
    """One row of each key and value, with their number ``_rows``: keys of a dimension may repeat."""
    return dims.where(F.col(key).isNotNull()).repartition(key).groupBy(key, value).agg(F.count(F.lit(1)).alias("_rows"), *more)


def _first_of(*keys: str) -> Column:
    """Whether a row is the first of its keys; the rows are already sorted so. The window is that of the keys before the last, so that Spark
    doesn't swap it with theirs and sort twice."""
    w = Window.partitionBy(*keys[:-1]).orderBy(keys[-1])
    return F.row_number().over(w) == F.rank().over(w)


def _small_product_side(items: DataFrame, products: DataFrame) -> DataFrame:
    """``_product_side`` for orders of few items: they are shuffled once and sorted once by (order, category, product)."""
    key, category = "product_id", "product_category_name"
    dims = _copies(_product_dimensions(products), key, category,
                   *[f(c).alias(f"_{f.__name__}_{c[8]}") for c in ("product_weight_g", "product_volume_cm3") for f in (F.sum, F.count)])
    each = items.select("order_id", key, "price", "freight_value").join(dims, key, "left").repartition("order_id").withColumns({
        "_rows": F.coalesce("_rows", F.lit(1)), "_first": _first_of("order_id", category, key)})
    each = each.withColumn("_n", F.sum("_rows").over(Window.partitionBy("order_id", category)))
    times = lambda c: F.sum(c * F.col("_rows"))
    filled = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c)))
    return each.groupBy("order_id").agg(
        F.sum("_rows").alias("n_items"), F.coalesce(times(S.money_units(F.col("price"))), F.lit(0)).alias("_price"),
        F.coalesce(times(S.money_units(F.col("freight_value"))), F.lit(0)).alias("_freight"),
        F.max("price").alias("max_price"), times(F.col("price").isNotNull().cast("bigint")).alias("_n_price"),
        F.sum(F.when(F.col("_first") & F.col(key).isNotNull(), F.col("_rows")).otherwise(0)).alias("n_unique_products"),
        _mean(F.sum("_sum_w"), filled("_count_w")).alias("mean_product_weight_g"),
        _mean(F.sum("_sum_v"), filled("_count_v")).alias("mean_product_volume_cm3"),
        _most_frequent(category, "_n").alias("dominant_category"))


def _small_seller_side(items: DataFrame, sellers: DataFrame) -> DataFrame:
    """``_seller_side`` for orders of few items: they are shuffled once and sorted once by (order, state, seller)."""
    key, state = "seller_id", "seller_state"
    each = items.select("order_id", key).join(_copies(sellers, key, state), key, "left").repartition("order_id").withColumn(
        "_first", _first_of("order_id", state, key))
    each = each.withColumn("_state", F.row_number().over(Window.partitionBy("order_id", state).orderBy(key)) == 1)
    known = F.when(F.col("_first") & F.col(key).isNotNull(), F.coalesce("_rows", F.lit(1)))
    # totals by windows and one row of each order: a grouping would hash all orders and sort them once more
    order = Window.partitionBy("order_id")
    return each.select(
        "order_id", F.coalesce(F.sum(known).over(order), F.lit(0)).alias("n_unique_sellers"),
        F.count_if(F.col("_state") & F.col(state).isNotNull()).over(order).alias("n_seller_states"),
        F.row_number().over(order.orderBy(state)).alias("_at")).where("_at = 1").drop("_at")


def _by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of orders of at most ``MOST_ROWS`` rows, and the others, with those without an order.

    There are few large orders, so their keys are broadcast; where there are none, Spark drops the second part when it runs.
    """
    counts = rows.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"))
    large = F.broadcast(counts.where(f"_n > {MOST_ROWS} or order_id is null").select(F.col("order_id").alias("_large")))
    same = F.col("order_id").eqNullSafe(F.col("_large"))
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


class ByOrder(dict):
    """Tables by name that are stored in buckets of the order: no grouping within an order shuffles them."""


def item_aggregates(items: DataFrame, products: DataFrame, sellers: DataFrame, stored_by_order: bool = False) -> DataFrame:
    """Counts, sums, distinct counts and the modal category per order.

    The items of an order meet the dimensions and are then shuffled and sorted once for each of both sides. Large orders are reduced step by
    step instead, from (order, product) and (order, seller) to the order, so distinct and modal values need no per-order set, and
    an order that holds a third of all items is spread over many tasks until only a few rows of it are left. So are all orders of items that
    are stored by order, as no step shuffles these.
    """
    small, large = (None, items) if stored_by_order else _by_size(items.where("order_id is not null"))
    both = _product_side(large, products).join(_seller_side(large, sellers), "order_id")
    if small is not None:
        both = _small_product_side(small, products).join(_small_seller_side(small, sellers), "order_id").unionByName(both)
    price, freight = S.money(F.col("_price")), S.money(F.col("_freight"))
    return both.select(
        "order_id", "n_items",
        price.alias("total_price"), freight.alias("total_freight"), "max_price",
        _mean(price, F.col("_n_price")).alias("mean_price"),
        "n_unique_products", "n_unique_sellers", "n_seller_states",
        "mean_product_weight_g", "mean_product_volume_cm3", "dominant_category",
        S.freight_ratio(freight, price).alias("freight_ratio"),
    )


def payment_aggregates(payments: DataFrame, stored_by_order: bool = False) -> DataFrame:
    """Count, sum, largest instalment count and modal type per order; a large order goes by way of (order, type)."""
    small, large = (None, payments) if stored_by_order else _by_size(payments)
    per_type = large.groupBy("order_id", "payment_type").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(S.money_units(F.col("payment_value"))).alias("_value"),
        F.max("payment_installments").alias("_max"))
    totals = per_type.groupBy("order_id").agg(
        F.sum("_n").alias("n_payments"), S.money(_total("_value")).alias("total_payment_value"),
        F.max("_max").alias("max_installments"), _most_frequent("payment_type", "_n").alias("payment_type_modal"))
    if small is None:
        return totals
    each = small.select("order_id", "payment_type", "payment_value", "payment_installments").repartition("order_id").withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("order_id", "payment_type")))
    return each.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_payments"),
        S.money(F.coalesce(F.sum(S.money_units(F.col("payment_value"))), F.lit(0))).alias("total_payment_value"),
        F.max("payment_installments").alias("max_installments"),
        _most_frequent("payment_type", "_n").alias("payment_type_modal")).unionByName(totals)


def split_labels(orders: DataFrame, train_end: str = fv.TRAIN_END, val_end: str = fv.VAL_END) -> DataFrame:
    return orders.select(
        "order_id", S.temporal_split(F.col("order_purchase_timestamp"), train_end, val_end).alias("split"))


def order_date_features(orders: DataFrame) -> DataFrame:
    ts = "order_purchase_timestamp"
    return orders.select(
        "*",
        S.hour_of_day(ts).alias("purchase_hour"),
        S.day_of_week(ts).alias("purchase_dow"),
        S.month_of_year(ts).alias("purchase_month"),
        S.days_between("order_estimated_delivery_date", ts).alias("days_to_estimated"),
        S.days_between("order_approved_at", ts).alias("days_to_approved"),
        S.days_between("order_delivered_customer_date", "order_delivered_carrier_date").alias(
            "days_carrier_to_customer"),
        S.days_between("order_delivered_customer_date", ts).alias("days_purchase_to_delivery"),
        S.days_between("order_delivered_customer_date", "order_estimated_delivery_date").alias(
            "delivery_vs_estimate_days"),
    )


def first_reviews(reviews: DataFrame) -> DataFrame:
    return dedup_first(reviews, ["order_id"], ["review_creation_date", "review_id"]).select(
        "order_id", "review_score", *fv.TEXT_COLS)


def feature_table_columns() -> list[str]:
    wanted = ["order_id", "split", *fv.LABEL_COLS, *fv.T2_FEATURE_COLS, *fv.T1_EXTRA_FEATURE_COLS, *fv.TEXT_COLS]
    return list(dict.fromkeys(wanted))


def build_order_features(
    tables: dict[str, DataFrame], train_end: str = fv.TRAIN_END, val_end: str = fv.VAL_END
) -> DataFrame:
    """All 33 columns. Uses a stored ``split_orders`` table when given, else labels the split in place."""
    orders = order_date_features(tables["orders"]).join(
        tables["customers"].select("customer_id", "customer_state"), "customer_id", "left")
    stored = isinstance(tables, ByOrder)
    joined = (
        orders.join(item_aggregates(tables["order_items"], tables["products"], tables["sellers"], stored), "order_id", "left")
        .join(payment_aggregates(tables["order_payments"], stored), "order_id", "left")
        .join(first_reviews(tables["order_reviews"]), "order_id", "left")
    )
    if "split_orders" in tables:
        joined = joined.join(tables["split_orders"].select("order_id", "split"), "order_id", "left")
    else:
        split = S.temporal_split(F.col("order_purchase_timestamp"), train_end, val_end)
        joined = joined.withColumn("split", split)
    labelled = joined.select(
        "*",
        S.label_high_review(F.col("review_score")).alias("y_t1"),
        S.label_late(F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")).alias("y_t2"),
        S.label_low_review(F.col("review_score")).alias("y_t3"),
    )
    return labelled.select(*[
        F.col(c).alias(c, metadata={"comment": fv.COLUMN_DESCRIPTIONS[c]}) if c in fv.COLUMN_DESCRIPTIONS else F.col(c)
        for c in feature_table_columns()
    ])
