"""Maps the star-schema test tables to the nine canonical tables.

Every rule is a plain column expression, so the adapter adds no step a real bronze
layer would not have; the oracle states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.fixed_values import TAXONOMY_VARIANTS

# The 25 brands stand for 17 known labels, 6 unknown ones, one accented, one missing.
BRAND_CATEGORIES = list(TAXONOMY_VARIANTS) + [
    "livros_tecnicos", "pet_shop", "cool_stuff", "malas_acessorios", "consoles_games", "artes",
    "alimentação", None,
]
TRAIN_END = "1999-06-01 00:00:00"
VAL_END = "2000-05-01 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ships = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("l_shipdate").alias("_first"), F.max("l_shipdate").alias("_last"))
    )
    day0 = "TIMESTAMP_NTZ'1995-01-01 00:00:00'"
    purchase = "timestampadd(SECOND, o_orderkey * 7919 % 86400, o_orderdate)"
    return (
        read_table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderstatus", F.expr(purchase).alias("_p"))
        .join(ships, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("_p").alias("order_purchase_timestamp"),
            F.expr("if(o_orderkey % 50 = 0, null, timestampadd(HOUR, o_orderkey % 97, _p))").alias("order_approved_at"),
            F.expr(f"timestampadd(DAY, timestampdiff(DAY, {day0}, _first) % 10, _p)").alias(
                "order_delivered_carrier_date"),
            F.expr(f"timestampadd(DAY, timestampdiff(DAY, {day0}, _last) % 40, _p)").alias(
                "order_delivered_customer_date"),
            F.expr("timestampadd(DAY, 20 + o_orderkey % 15, _p)").alias("order_estimated_delivery_date"),
        )
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("bigint").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        F.expr("floor(l_extendedprice * l_tax * 100.0D + 0.5D) / 100.0D").alias("freight_value"),
    )


def order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("bigint").alias("payment_sequential"),
        F.expr("case l_returnflag when 'A' then 'boleto' when 'N' then 'credit_card' when 'R' then 'voucher' end")
        .alias("payment_type"),
        F.col("l_quantity").cast("bigint").alias("payment_installments"),
        F.expr("l_extendedprice * (1.0D + l_tax)").alias("payment_value"),
    )


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a review; one without labels has no score. The title is the whole first line."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return docs.join(read_table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("review_id"),
        F.col("doc_id").alias("order_id"),
        F.expr("cast(case when quality is null and toxic is null then null when quality = 1 and toxic = 0 then 5 when quality = 1 then 3 "
               "when toxic = 0 then 2 else 1 end as bigint)").alias("review_score"),
        F.substring_index("text", "\n", 1).alias("review_comment_title"),
        F.col("text").alias("review_comment_message"),
        F.expr("timestampadd(DAY, n_chars % 365, TIMESTAMP_NTZ'2001-09-01 00:00:00')").alias("review_creation_date"),
        F.expr("timestampadd(DAY, 3 + n_chars % 365, TIMESTAMP_NTZ'2001-09-01 00:00:00')").alias(
            "review_answer_timestamp"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return read_table(spark, sf_dir, "customer").join(nation, "c_nationkey", "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_unique_id"),
        (F.col("c_custkey") % 100000).alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return read_table(spark, sf_dir, "supplier").join(nation, "s_nationkey", "left").select(
        F.col("s_suppkey").alias("seller_id"),
        (F.col("s_suppkey") % 100000).alias("seller_zip_code_prefix"),
        F.col("s_name").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in BRAND_CATEGORIES])
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.element_at(names, F.expr("cast(substring(p_brand, 7) as int)")).alias("product_category_name"),
        F.length("p_name").cast("bigint").alias("product_name_lenght"),
        F.length("p_type").cast("bigint").alias("product_description_lenght"),
        (F.col("p_partkey") % 5).alias("product_photos_qty"),
        F.col("p_size").cast("bigint").alias("product_weight_g"),
        F.col("p_size").cast("bigint").alias("product_length_cm"),
        (F.col("p_size").cast("bigint") % 7 + 1).alias("product_height_cm"),
        (F.col("p_size").cast("bigint") % 5 + 1).alias("product_width_cm"),
    )


#: The test tables that the canonical ones are made of.
SOURCES = ("orders", "lineitem", "documents", "labels", "customer", "nation", "supplier", "part")

TABLES = {
    "orders": orders,
    "order_items": order_items,
    "order_payments": order_payments,
    "order_reviews": order_reviews,
    "customers": customers,
    "products": products,
    "sellers": sellers,
}


def canonical_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: make(spark, sf_dir) for name, make in TABLES.items()}
