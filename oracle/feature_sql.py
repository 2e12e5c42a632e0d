"""SQL of the projection, join, aggregate and report queries."""

from oracle.base import sql
from tarnish.fixed_values import (CATEGORICAL_COLS, MONETARY_COLS, T1_EXTRA_FEATURE_COLS, T2_FEATURE_COLS, TEXT_COLS,
                                  TIME_DAY_COLS)

FEATURES = T2_FEATURE_COLS + T1_EXTRA_FEATURE_COLS + TEXT_COLS


def _roles():
    role = lambda c: "categorical" if c in CATEGORICAL_COLS else "text" if c in TEXT_COLS else "numeric"
    return sql(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{role(c)}' AS role, {str(c in MONETARY_COLS).lower()} AS monetary, "
        f"count({c}) AS n_filled FROM order_features" for c in FEATURES))


SQL = {
    "e4_order_features": sql("SELECT * FROM order_features"),
    "e4_colocated_features": sql("SELECT * FROM order_features"),
    "p1_date_parts": sql("SELECT order_id, purchase_hour, purchase_dow, purchase_month FROM of_wide"),
    "p2_day_differences": sql(f"SELECT order_id, {', '.join(TIME_DAY_COLS)} FROM of_wide"),
    "p3_product_volume": sql("""SELECT product_id, CAST(product_length_cm AS DOUBLE) * product_height_cm
        * product_width_cm AS product_volume_cm3 FROM c_products"""),
    "p4_freight_ratio": sql("""SELECT order_id, order_item_id, price, freight_value / (price + 1e-6) AS freight_ratio
        FROM c_items"""),
    "p5_p6_review_labels": sql("""SELECT review_id, review_score,
        CASE WHEN review_score >= 4 THEN 1 WHEN review_score <= 2 THEN 0 END AS y_t1,
        CASE WHEN review_score >= 4 THEN 0 WHEN review_score <= 2 THEN 1 END AS y_t3 FROM c_reviews"""),
    "p7_late_label": sql("SELECT order_id, y_t2 FROM of_wide"),
    "p8_temporal_split": sql("SELECT order_id, split FROM split_orders"),
    "p9_split_projection": sql(f"""SELECT order_id, y_t2, {', '.join(T2_FEATURE_COLS)} FROM of_wide
        WHERE split = 'test' AND y_t2 IS NOT NULL"""),
    "p10_column_roles": _roles(),
    "p11_lenient_number": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(user_id AS DOUBLE)
        WHEN 2 THEN event_id + 0.5::DOUBLE WHEN 3 THEN NULL ELSE user_id * 100.0::DOUBLE END AS number FROM events""",
    "p12_text_coercion": sql(f"""SELECT order_id, {', '.join(f"coalesce({c}, '') AS {c}" for c in TEXT_COLS)},
        {', '.join(CATEGORICAL_COLS)} FROM of_wide"""),
    "p13_align_columns": sql("""SELECT order_id, CAST(NULL AS DOUBLE) AS total_price, CAST(NULL AS BIGINT) AS n_items,
        max_price FROM of_wide"""),
    "p14_clip_text": """SELECT doc_id, CASE WHEN length(text) > 800 THEN substring(text, 1, 800) || '…' ELSE text END
        AS text FROM documents""",
    "p16_p17_threshold_and_score": """SELECT event_id, CAST(value % 1 >= 0.5 AS INTEGER) AS yhat,
        CASE user_id % 3 - 1 WHEN 1 THEN value % 1 WHEN 0 THEN 1.0 - value % 1 ELSE 0.5 END::DOUBLE AS score
        FROM events""",
    "p18_drop_nulls": sql("""SELECT order_id, order_approved_at, order_delivered_customer_date FROM c_orders
        WHERE order_approved_at IS NOT NULL AND order_delivered_customer_date IS NOT NULL"""),
    "p19_missing_timestamps": sql(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, count(*) AS n_total FROM c_orders"
        for c in ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date"))),
    "j1_j2_items_dimensions": sql("""SELECT order_id, order_item_id, product_id, seller_id, price,
        product_category_name, product_weight_g, product_volume_cm3, seller_state FROM items_joined"""),
    "j3_orders_customers": sql("SELECT order_id, customer_id, customer_state FROM of_wide"),
    "j4_orders_items": sql("SELECT o_orderkey AS order_id, i.* EXCLUDE (order_id) FROM orders "
                           "LEFT JOIN item_agg i ON i.order_id = o_orderkey"),
    "j5_orders_payments": sql("SELECT o_orderkey AS order_id, i.* EXCLUDE (order_id) FROM orders "
                              "LEFT JOIN pay_agg i ON i.order_id = o_orderkey"),
    "j6_orders_reviews": sql("SELECT o_orderkey AS order_id, i.* EXCLUDE (order_id) FROM orders "
                             "LEFT JOIN first_review i ON i.order_id = o_orderkey"),
    "j7_orders_split": sql("SELECT order_id, order_status, split FROM of_wide"),
    "a1_item_aggregates": sql("SELECT * FROM item_agg"),
    "a2_payment_aggregates": sql("SELECT * FROM pay_agg"),
    "a3_modal_value": """SELECT user_id, arg_min(kind, (-n, kind)) FILTER (kind IS NOT NULL) AS modal_kind FROM (
        SELECT user_id, CASE WHEN user_id % 7 <> 0 THEN event_type END AS kind, count(*) AS n FROM events GROUP BY 1, 2)
        GROUP BY 1""",
    "a4_split_summary": sql("""SELECT n_total, n_train, n_val, n_test, n_drop, round(n_train / n_total, 4) AS frac_train,
        round(n_val / n_total, 4) AS frac_val, round(n_test / n_total, 4) AS frac_test
        FROM (SELECT count(*) AS n_total, count(*) FILTER (split = 'train') AS n_train,
              count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test,
              count(*) FILTER (split = 'drop') AS n_drop FROM split_orders)"""),
    "a5_frequencies": sql("""
        SELECT 'split' AS report, split AS level, count(*) AS n FROM of_wide GROUP BY ALL
        UNION ALL SELECT 'order_status', order_status, count(*) FROM of_wide GROUP BY ALL
        UNION ALL SELECT 'review_score', CAST(review_score AS VARCHAR), count(*) FROM c_reviews GROUP BY ALL
        UNION ALL SELECT 'late', CAST(y_t2 AS VARCHAR), count(*) FROM of_wide WHERE y_t2 IS NOT NULL GROUP BY ALL"""),
    "a6_label_coverage": sql(" UNION ALL ".join(
        f"SELECT '{c}' AS label, count({c}) AS n, count(*) AS n_total, round(avg({c}), 6) AS prevalence FROM of_wide"
        for c in ("y_t1", "y_t2", "y_t3"))),
    "a7_orders_by_period": sql("""
        SELECT 'year' AS kind, CAST(year(order_purchase_timestamp) AS VARCHAR) AS period, count(*) AS n
        FROM c_orders GROUP BY ALL UNION ALL
        SELECT 'quarter', year(order_purchase_timestamp) || 'Q' || quarter(order_purchase_timestamp), count(*)
        FROM c_orders GROUP BY ALL"""),
    "a8_date_range": sql("""SELECT min(order_purchase_timestamp) AS first_ts, max(order_purchase_timestamp) AS last_ts
        FROM c_orders"""),
    "a9_join_cardinality": sql("""
        SELECT 'customers_in_orders' AS figure, count(DISTINCT customer_id) AS value FROM c_orders
        UNION ALL SELECT 'customers', count(*) FROM c_customers
        UNION ALL SELECT 'orders', count(DISTINCT order_id) FROM c_orders
        UNION ALL SELECT 'reviews', count(*) FROM c_reviews
        UNION ALL SELECT 'items', count(*) FROM c_items
        UNION ALL SELECT 'products_used', count(DISTINCT product_id) FROM c_items
        UNION ALL SELECT 'products', count(*) FROM c_products
        UNION ALL SELECT 'sellers_active', count(DISTINCT seller_id) FROM c_items
        UNION ALL SELECT 'sellers', count(*) FROM c_sellers"""),
    "a9_join_ratios": sql("""SELECT round((SELECT count(*) FROM c_reviews) / n, 6) AS reviews_per_order,
        round((SELECT count(*) FROM c_items) / n, 6) AS items_per_order
        FROM (SELECT count(DISTINCT order_id) AS n FROM c_orders)"""),
    "a14_eda_summary": sql("""SELECT * FROM (SELECT count(*) AS n_orders,
            count(*) FILTER (order_delivered_customer_date IS NOT NULL) AS "n_orders_used_T2",
            round(avg(CAST(order_delivered_customer_date > order_estimated_delivery_date AS INTEGER)), 6)
                AS "T2_positive_prev",
            min(order_purchase_timestamp) AS purchase_min, max(order_purchase_timestamp) AS purchase_max FROM c_orders),
        (SELECT count(*) FILTER (review_score <> 3) AS "n_reviews_used_T1",
            round(avg(CAST(review_score > 3 AS INTEGER)) FILTER (review_score <> 3), 6) AS "T1_positive_prev"
         FROM c_reviews)"""),
    "w1_dedup_first": """SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""",
    "w7_sorted_frequency": sql("SELECT review_score, count(*) AS n FROM c_reviews GROUP BY 1"),
    "u1_union_all": sql("""SELECT order_id, split, y_t2 FROM of_wide WHERE split IN ('train', 'val')"""),
}
