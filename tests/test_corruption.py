"""Properties of the corruption families, on the whole feature table."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tarnish import fixed_values as fv
from tarnish.functions import keyed_hash as K
from tarnish.functions import scalars as S
from tarnish.operators import audit
from tarnish.operators import corruption as C

FAMILIES = C.list_families()
ROW_LOCAL = [f for f in FAMILIES if f not in ("duplicate_rows", "schema_drift")]


def plain(df):
    """Variants as JSON text, so frames can be compared."""
    return df.select(*[F.to_json(c).alias(c) if t == "variant" else F.col(c) for c, t in df.dtypes])


def same(a, b, *order):
    return rows(plain(a), *order) == rows(plain(b), *order)


@pytest.mark.parametrize("family", FAMILIES)
def test_same_call_twice_is_equal(features, family):
    assert same(C.apply(features, family, 0.2, 13), C.apply(features, family, 0.2, 13), "order_id")


@pytest.mark.parametrize("family", FAMILIES)
def test_partitioning_and_order_do_not_matter(features, family):
    moved = features.orderBy(F.desc("total_price")).repartition(7, "customer_state")
    assert same(C.apply(features, family, 0.2, 13), C.apply(moved, family, 0.2, 13), "order_id")


@pytest.mark.parametrize("family", FAMILIES)
def test_labels_key_and_split_stay(features, family):
    kept = ["order_id", "split", "y_t1", "y_t2", "y_t3"]
    out = C.apply(features, family, 0.3, 17)
    if family == "duplicate_rows":
        out = out.distinct()
    assert same(features.select(*kept), out.select(*kept), "order_id")


@pytest.mark.parametrize("family", FAMILIES)
def test_severity_zero_changes_nothing(features, family):
    out = C.apply(features, family, 0.0, 0)
    assert out.columns == features.columns
    before = features.withColumns({c: F.col(c).cast("variant") for c in S.numeric_columns(features)}) \
        if family == "type_flip" else features
    assert same(before, out, "order_id")


@pytest.mark.parametrize("family", [f for f in FAMILIES if f != "duplicate_rows"])
def test_row_and_column_count_stay(features, family):
    out = C.apply(features, family, 0.3, 23)
    assert out.count() == features.count() and len(out.columns) == len(features.columns)


@pytest.mark.parametrize("severity", [0.2, 1.0])
def test_duplicate_rows_growth_is_exact(features, severity):
    n = features.count()
    out = C.apply(features, "duplicate_rows", severity, 23, copy_column="copy")
    assert out.count() == n + round(severity * n)
    originals = out.filter("copy = 0").drop("copy")
    assert same(originals, features, "order_id")
    assert out.filter("copy > 0").select("copy").distinct().count() == round(severity * n)
    # every copy is one of the rows
    assert out.drop("copy").join(features.select("order_id"), "order_id", "left_anti").count() == 0


def test_duplicate_rows_of_an_empty_frame(features):
    assert C.apply(features.filter("false"), "duplicate_rows", 0.5, 1).count() == 0


def test_schema_drift_renames_exactly(features):
    out = C.apply(features, "schema_drift", 0.3, 23)
    renamed = sorted(c for c in out.columns if c.startswith("col_23_"))
    assert renamed == [f"col_23_{i:03d}" for i in range(round(0.3 * 28))]


def null_cells(df):
    return sum(df.select([F.count_if(F.col(c).isNull()).alias(c) for c in S.feature_columns(df)]).first())


def test_missing_injection_adds_nulls_at_the_stated_rate(features):
    c, n = "purchase_hour", features.count()
    gone = C.apply(features, "missing_injection", 0.25, 31).filter(F.col(c).isNull()).count()
    assert abs(gone - 0.25 * n) < 4 * math.sqrt(n * 0.25 * 0.75)
    assert null_cells(C.apply(features, "missing_injection", 0.25, 31)) > null_cells(features)


def test_masks_are_nested_and_independent_between_columns(features):
    hit = lambda sev, c: {r[0] for r in C.apply(features, "missing_injection", sev, 5).filter(
        F.col(c).isNull()).select("order_id").collect()}
    assert hit(0.1, "purchase_hour") < hit(0.2, "purchase_hour") < hit(0.9, "purchase_hour")
    n = features.count()
    both = len(hit(0.2, "purchase_hour") & hit(0.2, "purchase_dow"))
    assert abs(both - 0.04 * n) < 4 * math.sqrt(n * 0.04)


def test_type_flip_keeps_values_and_marks_text(features):
    out = C.apply(features, "type_flip", 0.5, 3).select(
        "order_id", F.schema_of_variant("total_price").alias("kind"),
        S.lenient_number("total_price").alias("after"))
    joined = out.join(features.select("order_id", "total_price"), "order_id")
    assert joined.filter(~F.col("after").eqNullSafe(F.col("total_price"))).count() == 0
    kinds = {r["kind"]: r["count"] for r in joined.groupBy("kind").count().collect()}
    assert kinds["STRING"] > 0 and kinds["DOUBLE"] > 0


def test_label_noise_changes_hit_values_and_fills_nulls(features):
    out = C.apply(features, "label_noise_categorical", 1.0, 3).select("order_id", F.col("dominant_category").alias("b"))
    joined = features.select("order_id", "dominant_category").join(out, "order_id")
    assert joined.filter("b is null").count() == 0
    assert joined.filter("b = dominant_category").count() == 0


@pytest.mark.parametrize("n_levels", [2, 10, 5000])
def test_label_noise_equals_brute_force_whatever_the_number_of_levels(spark, n_levels):
    """Read from the frame, given as a table, given as lists: one rule."""
    name = lambda i: f"é{i % n_levels}" if i % 3 else f"'{i % n_levels}\\"
    data = [(i, None if i % 11 == 0 else name(i)) for i in range(3 * n_levels + 40)]
    df = spark.createDataFrame(data, "order_id bigint, customer_state string").repartition(5)
    levels = sorted({v for _, v in data if v is not None})
    p, family, column = K.PRIME, "label_noise_categorical", "customer_state"
    mix = lambda h, salt: (h * K.affine_constants(family, column, salt)[0] + K.affine_constants(family, column, salt)[1]) % p

    def expected(key, value):
        h = int(hashlib.md5(f"7|{key}".encode()).hexdigest()[:8], 16) % p
        if mix(h, "hit") / p >= 0.4:
            return value
        at = mix(h, "pick") % len(levels)
        return levels[(at + 1) % len(levels)] if levels[at] == value else levels[at]

    want = [(k, expected(k, v)) for k, v in data]
    for given in (None, C.indexed_levels(df, [column]), {column: levels}):
        assert rows(C.apply(df, family, 0.4, 7, levels=given), "order_id") == want


def test_label_noise_with_a_list_of_keys(spark):
    df = spark.createDataFrame([(i % 4, i, "abc"[i % 3]) for i in range(60)], "k bigint, order_id bigint, customer_state string")
    out = C.apply(df, "label_noise_categorical", 1.0, 7, key=["k", "order_id"])
    assert out.count() == 60 and all(a[2] != b[2] for a, b in zip(rows(df, "order_id"), rows(out, "order_id")))


def test_duplicate_rows_of_repeated_and_missing_keys(spark, features):
    n = features.count()
    twice = C.apply(C.apply(features, "duplicate_rows", 0.5, 1), "duplicate_rows", 0.5, 2)
    once = n + round(0.5 * n)
    assert twice.count() == once + round(0.5 * once)
    assert twice.join(features, "order_id", "left_anti").count() == 0
    # one key, equal rows and rows that differ, rows without a key
    odd = spark.createDataFrame([(1, "a")] * 30 + [(1, str(i)) for i in range(30)] + [(None, None)] * 20 + [(2, None)] * 20,
                                "order_id bigint, t string")
    out = C.apply(odd, "duplicate_rows", 1.0, 3, copy_column="copy")
    assert out.count() == 200 and out.where("copy > 0").select("copy").distinct().count() == 100
    assert out.drop("copy").distinct().count() == odd.distinct().count()
    share = out.where("copy > 0 and order_id = 1 and t = 'a'").count()
    assert 10 <= share <= 50


def test_audit_of_copies_moves_counts_only(spark, monkeypatch):
    data = [(i % 40 if i % 9 else None, None if i % 3 else float(i % 5), i % 2 or None, "x" * (i % 4) or None) for i in range(200)]
    df = spark.createDataFrame(data, f"{C.KEY} bigint, total_price double, n_items int, customer_state string").repartition(5)
    features = df.columns[1:]
    copied = C.duplicate_rows(df.selectExpr("*", *[f"`{c}` as `_b_{c}`" for c in features]), 0.5, 42)
    wanted = sum(v is None for r in copied.select(*features).collect() for v in r)
    moved = []
    monkeypatch.setitem(C.REGISTRY, "duplicate_rows", lambda d, *a, **o: moved.append(d.columns) or C.duplicate_rows(d, *a, **o))
    got = audit.audit(df, ["duplicate_rows"], 0.5, 42, features).first()
    assert tuple(got) == ("duplicate_rows", 300, 4, wanted, 0)
    assert not {c for c in moved[0] if "price" in c or "state" in c}


def test_label_noise_leaves_a_single_level_alone(spark):
    df = spark.createDataFrame([(i, "x") for i in range(20)], "order_id bigint, order_status string")
    assert {r[0] for r in C.apply(df, "label_noise_categorical", 1.0, 1).select("order_status").collect()} == {"x"}


def test_currency_multiplies_by_hundred(features):
    out = C.apply(features, "currency_unit_drift", 0.3, 31)
    for c in fv.MONETARY_COLS:
        ratio = out.select("order_id", F.col(c).alias("b")).join(features.select("order_id", c), "order_id").filter(
            F.col(c) > 0).select(F.round(F.col("b") / F.col(c), 6)).distinct().collect()
        assert {r[0] for r in ratio} == {1.0, 100.0}


def test_timezone_moves_hours_and_days(features):
    out = C.apply(features, "timezone_collapse", 0.5, 31)
    pairs = out.select("order_id", F.col("purchase_hour").alias("b"), F.col("days_to_estimated").alias("d")).join(
        features.select("order_id", "purchase_hour", "days_to_estimated"), "order_id")
    moved = {r[0] for r in pairs.select(F.pmod(F.col("b") - F.col("purchase_hour"), F.lit(24))).distinct().collect()}
    assert moved == {0, 3, 21}
    assert {r[0] for r in pairs.select(F.round(F.col("d") - F.col("days_to_estimated"), 6)).distinct().collect()} == {
        0.0, 0.125, -0.125}


def test_taxonomy_cases(spark):
    df = spark.createDataFrame(
        [(1, "bebes"), (2, "artes_casa"), (3, "pet_shop"), (4, None)], "order_id bigint, dominant_category string")
    got = dict(rows(C.apply(df, "category_taxonomy_drift", 1.0, 1).select("order_id", "dominant_category")))
    assert got[1] in fv.TAXONOMY_VARIANTS["bebes"]
    assert (got[2], got[3], got[4]) == ("ártes_casa", "pet_shop_drift", None)


def test_mojibake_cases(spark):
    words = ["plain", "não", "😀 ok", "", None]
    df = spark.createDataFrame(list(enumerate(words)), "order_id bigint, review_comment_title string")
    got = dict(rows(C.apply(df, "mojibake_roundtrip", 1.0, 1).select("order_id", "review_comment_title")))
    assert [got[i] for i in range(5)] == [None if w is None else w.encode().decode("latin-1") for w in words]


def test_dispatch(features):
    assert FAMILIES == fv.FAMILIES
    assert C.apply(features, "clean", 0.5, 1) is features and C.apply_clean(features) is features
    with pytest.raises(KeyError):
        C.apply(features, "nothing", 0.1, 1)
    with pytest.raises(ValueError):
        C.apply(features, "type_flip", 1.1, 1)


@pytest.mark.parametrize("family", FAMILIES)
def test_empty_frame(features, family):
    assert C.apply(features.filter("false"), family, 0.5, 1).count() == 0


def test_row_local_families_run_on_a_stream(spark, features, tmp_path):
    source = str(tmp_path / "in")
    features.write.parquet(source)
    stream = spark.readStream.schema(features.schema).parquet(source)
    out = C.apply(stream, "currency_unit_drift", 0.3, 7)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert same(spark.read.schema(features.schema).parquet(str(tmp_path / "out")),
                C.apply(features, "currency_unit_drift", 0.3, 7), "order_id")
