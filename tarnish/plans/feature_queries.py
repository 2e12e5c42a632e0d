"""Registered queries: projections, joins, aggregates, reports and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnish import fixed_values as fv
from tarnish.functions import scalars as S
from tarnish.functions.shapes import unpivot
from tarnish.operators import features as X
from tarnish.operators import reports as R
from tarnish.sources import adapter as A
from tarnish.sources.colocated import colocated_tables


def order_features(spark, sf):
    return X.build_order_features(A.canonical_tables(spark, sf), A.TRAIN_END, A.VAL_END)


def colocated_features(spark, sf):
    """The same table from bronze in buckets of order_id: no further shuffle by order."""
    return X.build_order_features(colocated_tables(spark, sf), A.TRAIN_END, A.VAL_END)


def p1(spark, sf):
    ts = "order_purchase_timestamp"
    return A.orders(spark, sf).select(
        "order_id", S.hour_of_day(ts).alias("purchase_hour"), S.day_of_week(ts).alias("purchase_dow"),
        S.month_of_year(ts).alias("purchase_month"))


def p2(spark, sf):
    return X.order_date_features(A.orders(spark, sf)).select("order_id", *fv.TIME_DAY_COLS)


def p3(spark, sf):
    return A.products(spark, sf).select(
        "product_id",
        S.box_volume("product_length_cm", "product_height_cm", "product_width_cm").alias("product_volume_cm3"))


def p4(spark, sf):
    return A.order_items(spark, sf).select(
        "order_id", "order_item_id", "price",
        S.freight_ratio(F.col("freight_value"), F.col("price")).alias("freight_ratio"))


def p5_p6(spark, sf):
    score = F.col("review_score")
    return A.order_reviews(spark, sf).select(
        "review_id", "review_score", S.label_high_review(score).alias("y_t1"), S.label_low_review(score).alias("y_t3"))


def p7(spark, sf):
    return A.orders(spark, sf).select("order_id", S.label_late(
        F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")).alias("y_t2"))


def p8(spark, sf):
    return X.split_labels(A.orders(spark, sf), A.TRAIN_END, A.VAL_END)


def p9(spark, sf):
    of = order_features(spark, sf)
    return of.filter((F.col("split") == "test") & F.col("y_t2").isNotNull()).select(
        "order_id", "y_t2", *fv.T2_FEATURE_COLS)


def p10(spark, sf):
    """Column roles, with the number of filled values, so the roles meet the data."""
    of = order_features(spark, sf)
    numeric, categorical = set(S.numeric_columns(of)), set(S.categorical_columns(of))
    role = lambda c: "numeric" if c in numeric else "categorical" if c in categorical else "text"
    columns = S.feature_columns(of)
    roles = F.create_map(*[F.lit(x) for c in columns for x in (c, role(c))])
    filled = unpivot(of, columns, "boolean", values={c: f"`{c}` is not null" for c in columns})
    return filled.groupBy("column").agg(F.count_if("value").alias("n_filled")).select(
        "column", roles[F.col("column")].alias("role"), F.col("column").isin(fv.MONETARY_COLS).alias("monetary"),
        "n_filled")


def p11(spark, sf):
    d = A.read_table(spark, sf, "events")
    odd = ("case event_id % 5 when 0 then concat(cast(user_id as string), 'd') when 1 then cast(user_id as string)"
                 " when 2 then concat(' ', cast(event_id as string), '.5') when 3 then event_type"
                 " else concat(cast(user_id as string), 'e2') end")
    return d.select("event_id", S.lenient_number(odd).alias("number"))


def p12(spark, sf):
    of = order_features(spark, sf)
    return of.select(
        "order_id", *[S.text_or_empty(F.col(c)).alias(c) for c in fv.TEXT_COLS],
        *[F.col(c).cast("string").alias(c) for c in fv.CATEGORICAL_COLS])


def p13(spark, sf):
    of = order_features(spark, sf).drop("total_price", "n_items").withColumn("col_13_000", F.lit(1))
    return S.align_columns(
        of, [("total_price", "double"), ("n_items", "bigint"), ("max_price", "double")], ["order_id"])


def p14(spark, sf):
    return A.read_table(spark, sf, "documents").select(
        "doc_id", S.clip_text(F.col("text"), fv.PROMPT_TEXT_CHARS).alias("text"))


def p16_p17(spark, sf):
    e = A.read_table(spark, sf, "events").select(
        "event_id", (F.col("value") % 1).alias("confidence"), (F.col("user_id") % 3 - 1).alias("prediction"))
    return e.select(
        "event_id", S.at_threshold(F.col("confidence")).alias("yhat"),
        S.positive_score(F.col("prediction"), F.col("confidence")).alias("score"))


def p18(spark, sf):
    return A.orders(spark, sf).dropna(subset=["order_approved_at", "order_delivered_customer_date"]).select(
        "order_id", "order_approved_at", "order_delivered_customer_date")


def p19(spark, sf):
    o = A.orders(spark, sf)
    return R.union_all([
        R.missing_timestamps(o, c).select(F.lit(c).alias("column"), "n_missing", "n_total")
        for c in ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date")])


def j1_j2(spark, sf):
    return X.items_with_dimensions(A.order_items(spark, sf), A.products(spark, sf), A.sellers(spark, sf)).select(
        "order_id", "order_item_id", "product_id", "seller_id", "price", "product_category_name",
        "product_weight_g", "product_volume_cm3", "seller_state")


def j3(spark, sf):
    return A.orders(spark, sf).join(
        A.customers(spark, sf).select("customer_id", "customer_state"), "customer_id", "left"
    ).select("order_id", "customer_id", "customer_state")


def j4(spark, sf):
    items = X.item_aggregates(A.order_items(spark, sf), A.products(spark, sf), A.sellers(spark, sf))
    return A.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id")).join(
        items, "order_id", "left")


def j5(spark, sf):
    return A.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id")).join(
        X.payment_aggregates(A.order_payments(spark, sf)), "order_id", "left")


def j6(spark, sf):
    return A.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id")).join(
        X.first_reviews(A.order_reviews(spark, sf)), "order_id", "left")


def j7(spark, sf):
    o = A.orders(spark, sf)
    return o.select("order_id", "order_status").join(
        X.split_labels(o, A.TRAIN_END, A.VAL_END), "order_id", "left")


def a3(spark, sf):
    e = A.read_table(spark, sf, "events").withColumn(
        "kind", F.when(F.col("user_id") % 7 != 0, F.col("event_type")))
    return X.modal_value(e, "user_id", "kind", "modal_kind")


def a5(spark, sf):
    of = order_features(spark, sf)
    return R.union_all([
        R.frequency(of, "split", "split"), R.frequency(of, "order_status", "order_status"),
        R.frequency(A.order_reviews(spark, sf), "review_score", "review_score"),
        R.frequency(of.filter("y_t2 is not null"), "y_t2", "late")])


def a9(spark, sf):
    return R.join_cardinality(A.canonical_tables(spark, sf))


def w1(spark, sf):
    return X.dedup_first(A.read_table(spark, sf, "conversations"), ["conv_id"], ["turn"])


def u1(spark, sf):
    of = order_features(spark, sf).select("order_id", "split", "y_t2")
    return R.union_all([of.filter("split = 'train'"), of.filter("split = 'val'")])


QUERIES = {
    "e4_order_features": order_features,
    "e4_colocated_features": colocated_features,
    "p1_date_parts": p1,
    "p2_day_differences": p2,
    "p3_product_volume": p3,
    "p4_freight_ratio": p4,
    "p5_p6_review_labels": p5_p6,
    "p7_late_label": p7,
    "p8_temporal_split": p8,
    "p9_split_projection": p9,
    "p10_column_roles": p10,
    "p11_lenient_number": p11,
    "p12_text_coercion": p12,
    "p13_align_columns": p13,
    "p14_clip_text": p14,
    "p16_p17_threshold_and_score": p16_p17,
    "p18_drop_nulls": p18,
    "p19_missing_timestamps": p19,
    "j1_j2_items_dimensions": j1_j2,
    "j3_orders_customers": j3,
    "j4_orders_items": j4,
    "j5_orders_payments": j5,
    "j6_orders_reviews": j6,
    "j7_orders_split": j7,
    "a1_item_aggregates": lambda s, d: X.item_aggregates(A.order_items(s, d), A.products(s, d), A.sellers(s, d)),
    "a2_payment_aggregates": lambda s, d: X.payment_aggregates(A.order_payments(s, d)),
    "a3_modal_value": a3,
    "a4_split_summary": lambda s, d: R.split_summary(X.split_labels(A.orders(s, d), A.TRAIN_END, A.VAL_END)),
    "a5_frequencies": a5,
    "a6_label_coverage": lambda s, d: R.label_coverage(order_features(s, d)),
    "a7_orders_by_period": lambda s, d: R.orders_by_period(A.orders(s, d)),
    "a8_date_range": lambda s, d: R.date_range(A.orders(s, d)),
    "a9_join_cardinality": a9,
    "a9_join_ratios": lambda s, d: R.join_ratios(a9(s, d)),
    "a14_eda_summary": lambda s, d: R.eda_summary(A.orders(s, d), A.order_reviews(s, d)),
    "w1_dedup_first": w1,
    "w7_sorted_frequency": lambda s, d: R.frequency(A.order_reviews(s, d), "review_score").orderBy("review_score"),
    "u1_union_all": u1,
}
