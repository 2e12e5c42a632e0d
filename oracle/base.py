"""SQL text of the canonical tables and of the feature table, for the independent engine."""

from tarnish.fixed_values import LABEL_COLS, T1_EXTRA_FEATURE_COLS, T2_FEATURE_COLS, TEXT_COLS
from tarnish.sources.adapter import BRAND_CATEGORIES, TRAIN_END, VAL_END


def quoted(text):
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


BRANDS = "[" + ", ".join(quoted(c) for c in BRAND_CATEGORIES) + "]"

CTES = {
    "c_orders": """
        SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, o.o_orderstatus AS order_status,
               o.p AS order_purchase_timestamp,
               CASE WHEN o.o_orderkey % 50 = 0 THEN NULL ELSE o.p + to_hours(o.o_orderkey % 97) END AS order_approved_at,
               o.p + to_days(CAST(date_diff('day', TIMESTAMP '1995-01-01', s.f) % 10 AS INTEGER))
                   AS order_delivered_carrier_date,
               o.p + to_days(CAST(date_diff('day', TIMESTAMP '1995-01-01', s.l) % 40 AS INTEGER))
                   AS order_delivered_customer_date,
               o.p + to_days(CAST(20 + o.o_orderkey % 15 AS INTEGER)) AS order_estimated_delivery_date
        FROM (SELECT *, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS p FROM orders) o
        LEFT JOIN (SELECT l_orderkey, min(l_shipdate) f, max(l_shipdate) l FROM lineitem GROUP BY 1) s
               ON s.l_orderkey = o.o_orderkey""",
    "c_items": """
        SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, l_shipdate AS shipping_limit_date, l_extendedprice AS price,
               floor(l_extendedprice * l_tax * 100.0 + 0.5) / 100.0 AS freight_value
        FROM lineitem""",
    "c_payments": """
        SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS payment_sequential,
               CASE l_returnflag WHEN 'A' THEN 'boleto' WHEN 'N' THEN 'credit_card' WHEN 'R' THEN 'voucher' END
                   AS payment_type,
               CAST(l_quantity AS BIGINT) AS payment_installments, l_extendedprice * (1.0 + l_tax) AS payment_value
        FROM lineitem""",
    "c_reviews": """
        SELECT d.doc_id AS review_id, d.doc_id AS order_id,
               CAST(CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL WHEN quality = 1 AND toxic = 0 THEN 5 WHEN quality = 1 THEN 3
                         WHEN toxic = 0 THEN 2 ELSE 1 END AS BIGINT) AS review_score,
               split_part(d.text, chr(10), 1) AS review_comment_title, d.text AS review_comment_message,
               TIMESTAMP '2001-09-01' + to_days(CAST(n_chars % 365 AS INTEGER)) AS review_creation_date,
               TIMESTAMP '2001-09-01' + to_days(CAST(3 + n_chars % 365 AS INTEGER)) AS review_answer_timestamp
        FROM documents d LEFT JOIN labels USING (doc_id)""",
    "c_customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_unique_id, c_custkey % 100000 AS customer_zip_code_prefix,
               c_mktsegment AS customer_city, n_name AS customer_state
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "c_sellers": """
        SELECT s_suppkey AS seller_id, s_suppkey % 100000 AS seller_zip_code_prefix, s_name AS seller_city,
               n_name AS seller_state
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""",
    "c_products": f"""
        SELECT p_partkey AS product_id, ({BRANDS})[CAST(substring(p_brand, 7) AS INTEGER)] AS product_category_name,
               CAST(length(p_name) AS BIGINT) AS product_name_lenght,
               CAST(length(p_type) AS BIGINT) AS product_description_lenght, p_partkey % 5 AS product_photos_qty,
               CAST(p_size AS BIGINT) AS product_weight_g, CAST(p_size AS BIGINT) AS product_length_cm,
               CAST(p_size % 7 + 1 AS BIGINT) AS product_height_cm, CAST(p_size % 5 + 1 AS BIGINT) AS product_width_cm
        FROM part""",
    "items_joined": """
        SELECT i.*, p.product_category_name, p.product_weight_g, s.seller_state,
               CAST(p.product_length_cm AS DOUBLE) * p.product_height_cm * p.product_width_cm AS product_volume_cm3
        FROM c_items i LEFT JOIN c_products p USING (product_id) LEFT JOIN c_sellers s USING (seller_id)""",
    "item_modes": """
        SELECT order_id, product_category_name AS dominant_category FROM (
            SELECT order_id, product_category_name,
                   row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, product_category_name) rn
            FROM items_joined WHERE product_category_name IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""",
    "item_agg": """
        SELECT order_id, n_items, price / 10000.0 AS total_price, freight / 10000.0 AS total_freight, max_price,
               price / 10000.0 / nullif(n_price, 0) AS mean_price, n_unique_products, n_unique_sellers,
               n_seller_states, mean_product_weight_g, mean_product_volume_cm3, dominant_category,
               (freight / 10000.0) / (price / 10000.0 + 1e-6) AS freight_ratio
        FROM (SELECT order_id, count(*) AS n_items,
                     coalesce(CAST(sum(CAST(floor(price * 10000.0 + 0.5) AS BIGINT)) AS DOUBLE), 0) AS price,
                     coalesce(CAST(sum(CAST(floor(freight_value * 10000.0 + 0.5) AS BIGINT)) AS DOUBLE), 0) AS freight,
                     max(price) AS max_price, count(price) AS n_price,
                     count(DISTINCT product_id) AS n_unique_products, count(DISTINCT seller_id) AS n_unique_sellers,
                     count(DISTINCT seller_state) AS n_seller_states,
                     CAST(sum(product_weight_g) AS DOUBLE) / count(product_weight_g) AS mean_product_weight_g,
                     sum(product_volume_cm3) / count(product_volume_cm3) AS mean_product_volume_cm3
              FROM items_joined GROUP BY 1)
        LEFT JOIN item_modes USING (order_id)""",
    "pay_modes": """
        SELECT order_id, payment_type AS payment_type_modal FROM (
            SELECT order_id, payment_type,
                   row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, payment_type) rn
            FROM c_payments WHERE payment_type IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""",
    "pay_agg": """
        SELECT order_id, n_payments, total_payment_value, max_installments, payment_type_modal
        FROM (SELECT order_id, count(*) AS n_payments,
                     coalesce(CAST(sum(CAST(floor(payment_value * 10000.0 + 0.5) AS BIGINT)) AS DOUBLE), 0) / 10000.0
                         AS total_payment_value,
                     max(payment_installments) AS max_installments FROM c_payments GROUP BY 1)
        LEFT JOIN pay_modes USING (order_id)""",
    "first_review": """
        SELECT order_id, review_score, review_comment_title, review_comment_message FROM c_reviews
        QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY review_creation_date, review_id) = 1""",
    "split_orders": f"""
        SELECT order_id, CASE WHEN order_purchase_timestamp IS NULL THEN 'drop'
                              WHEN order_purchase_timestamp < TIMESTAMP '{TRAIN_END}' THEN 'train'
                              WHEN order_purchase_timestamp < TIMESTAMP '{VAL_END}' THEN 'val'
                              ELSE 'test' END AS split
        FROM c_orders""",
    "of_wide": """
        SELECT o.*, s.split, c.customer_state, i.* EXCLUDE (order_id), p.* EXCLUDE (order_id),
               r.* EXCLUDE (order_id),
               hour(order_purchase_timestamp) AS purchase_hour,
               isodow(order_purchase_timestamp) - 1 AS purchase_dow,
               month(order_purchase_timestamp) AS purchase_month,
               (epoch_us(order_estimated_delivery_date) - epoch_us(order_purchase_timestamp)) / 86400000000.0
                   AS days_to_estimated,
               (epoch_us(order_approved_at) - epoch_us(order_purchase_timestamp)) / 86400000000.0 AS days_to_approved,
               (epoch_us(order_delivered_customer_date) - epoch_us(order_delivered_carrier_date)) / 86400000000.0
                   AS days_carrier_to_customer,
               (epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)) / 86400000000.0
                   AS days_purchase_to_delivery,
               (epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date)) / 86400000000.0
                   AS delivery_vs_estimate_days,
               CASE WHEN review_score IN (4, 5) THEN 1 WHEN review_score IN (1, 2) THEN 0 END AS y_t1,
               CASE WHEN order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL
                    THEN CAST(order_delivered_customer_date > order_estimated_delivery_date AS INTEGER) END AS y_t2,
               CASE WHEN review_score IN (1, 2) THEN 1 WHEN review_score IN (4, 5) THEN 0 END AS y_t3
        FROM c_orders o LEFT JOIN c_customers c USING (customer_id) LEFT JOIN item_agg i USING (order_id)
        LEFT JOIN pay_agg p USING (order_id) LEFT JOIN first_review r USING (order_id)
        LEFT JOIN split_orders s USING (order_id)""",
    "order_features": "SELECT " + ", ".join(
        ["order_id", "split", *LABEL_COLS, *T2_FEATURE_COLS, *T1_EXTRA_FEATURE_COLS, *TEXT_COLS]) + " FROM of_wide",
}


def sql(body: str, **extra: str) -> str:
    """``body`` over the canonical tables; ``extra`` adds further named subqueries in order."""
    parts = {**CTES, **extra}
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in parts.items()) + "\n" + body
