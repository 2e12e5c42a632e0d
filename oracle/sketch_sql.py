"""SQL of the sketch queries: the exact figures, and that every estimate keeps its bound."""

from oracle.base import sql
from oracle.sweep_sql import NUMERIC, TRAIN

PARENTS = [("c_orders", "orders", "c_customers", "customers", "customer_id"), ("c_items", "order_items", "c_orders", "orders", "order_id"),
           ("c_payments", "order_payments", "c_orders", "orders", "order_id"), ("c_reviews", "order_reviews", "c_orders", "orders", "order_id"),
           ("c_items", "order_items", "c_products", "products", "product_id"), ("c_items", "order_items", "c_sellers", "sellers", "seller_id")]

SQL = {
    "a10_sketched_quantiles": sql(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", prob, n, true AS within_bound FROM (SELECT count({c}) AS n FROM train), "
        "(SELECT unnest([0.1::DOUBLE, 0.5, 0.9]) AS prob) WHERE n > 0" for c in NUMERIC), train=TRAIN),
    "a9_sketched_orphans": sql(" UNION ALL ".join(
        f"SELECT '{child}' AS child, '{parent}' AS parent, '{key}' AS \"key\", count(*) FILTER (c IS NOT NULL) AS child_keys, "
        "count(*) FILTER (p IS NOT NULL) AS parent_keys, count(*) FILTER (c IS NOT NULL AND p IS NOT NULL) AS common, "
        "count(*) FILTER (p IS NULL) AS orphans, count(*) FILTER (c IS NULL) AS childless, true AS within_bound "
        f"FROM (SELECT DISTINCT {key} AS c FROM {c} WHERE {key} IS NOT NULL) x "
        f"FULL JOIN (SELECT DISTINCT {key} AS p FROM {p} WHERE {key} IS NOT NULL) y ON x.c = y.p"
        for c, child, p, parent, key in PARENTS)),
}
