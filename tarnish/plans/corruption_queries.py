"""Registered queries: corruption families, audit and samples, over the whole feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnish import fixed_values as fv
from tarnish.functions import scalars as S
from tarnish.operators import audit, corruption as C, sampling as W
from tarnish.sources.silver import silver

SEVERITY, SEED = 0.20, 42


def family(name):
    return lambda spark, sf: C.apply(silver(spark, sf), name, SEVERITY, SEED)


def c2_columns(of, out):
    """The flipped columns as numbers, and whether each arrived as text."""
    numeric = S.numeric_columns(of)
    return out.selectExpr(
        "order_id", *[f"{S.number_sql(out, c)} as {c}" for c in numeric],
        *[f"schema_of_variant({c}) = 'STRING' as {c}_is_text" for c in numeric])


def c2(spark, sf):
    of = silver(spark, sf)
    return c2_columns(of, C.apply(of, "type_flip", SEVERITY, SEED))


def c3_many(spark, sf):
    """Level swaps alone, against a table of levels indexed beforehand, as a sweep gives them."""
    of = silver(spark, sf)
    columns = S.categorical_columns(of)
    return C.apply(of, "label_noise_categorical", SEVERITY, SEED, levels=C.indexed_levels(of, columns)).select(
        "order_id", *columns)


def c4_twice(spark, sf):
    """Copies of copies: the second pass meets repeated keys, and still adds the exact number."""
    once = C.apply(silver(spark, sf), "duplicate_rows", 0.5, SEED)
    twice = C.apply(once, "duplicate_rows", 0.5, SEED + 1)
    return twice.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("split").alias("n_splits"))


def c4(spark, sf):
    return C.apply(silver(spark, sf), "duplicate_rows", SEVERITY, SEED, copy_column="copy_no").select(
        "order_id", "copy_no", "split", *fv.T2_FEATURE_COLS)


def c10(spark, sf):
    """Every registered family through the dispatcher: how many rows and nulls come out."""
    from tarnish.operators.reports import union_all

    of = silver(spark, sf)
    rows = []
    for name in ["clean", *C.list_families()]:
        out = C.apply(of, name, SEVERITY, SEED)
        rows.append(out.agg(F.count(F.lit(1)).alias("n_rows"), F.count("y_t2").alias("n_labelled")).select(
            F.lit(name).alias("family"), "n_rows", "n_labelled"))
    return union_all(rows)


def a21(spark, sf):
    of = silver(spark, sf)
    return audit.audit(of, C.list_families(), SEVERITY, SEED, S.feature_columns(of))


def pool(spark, sf, label):
    return silver(spark, sf).filter("split = 'test'").select("order_id", label)


def w6(spark, sf):
    of = silver(spark, sf)
    return W.rows_of(of, W.simple_sample(of, 1000, 0)).select("order_id", "split", *fv.T2_FEATURE_COLS)


QUERIES = {
    "c1_missing_injection": family("missing_injection"),
    "c2_type_flip": c2,
    "c3_label_noise_categorical": family("label_noise_categorical"),
    "c3_label_noise_many_levels": c3_many,
    "c4_duplicate_rows": c4,
    "c4_duplicate_rows_twice": c4_twice,
    "c5_schema_drift": lambda s, d: C.apply(silver(s, d), "schema_drift", SEVERITY, SEED),
    "c6_currency_unit_drift": family("currency_unit_drift"),
    "c7_timezone_collapse": family("timezone_collapse"),
    "c8_category_taxonomy_drift": family("category_taxonomy_drift"),
    "c9_mojibake_roundtrip": family("mojibake_roundtrip"),
    "c10_c11_dispatch": c10,
    "a21_corruption_audit": a21,
    "w3_strict_sample": lambda s, d: W.stratified_samples(pool(s, d, "y_t2"), "y_t2", 200, fv.SEEDS, mode="strict"),
    "w4_capped_sample": lambda s, d: W.stratified_samples(pool(s, d, "y_t3"), "y_t3", 1000, fv.SEEDS, mode="capped"),
    "w4_pool_sample": lambda s, d: W.stratified_samples(pool(s, d, "y_t2"), "y_t2", None, [13], mode="pool"),
    "w5_seeded_shuffle": lambda s, d: pool(s, d, "y_t2").orderBy(*W.seeded_order(pool(s, d, "y_t2"), 13)),
    "w6_simple_sample": w6,
}
