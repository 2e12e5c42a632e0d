"""Feature table pieces on small edge frames, against plain Python."""

from collections import Counter
from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F
from tarnish.functions import scalars as S
from tarnish.operators import features as X


def test_modal_value_ties_nulls_and_a_hot_key(spark):
    data = [(1, "b"), (1, "a"), (2, None), (3, "z"), (3, "z"), (3, "a"), (3, None)] + [(9, f"v{i % 7}") for i in range(700)]
    df = spark.createDataFrame(data, "k bigint, v string").repartition(5)
    assert dict(rows(X.modal_value(df, "k", "v", "m"))) == {1: "a", 2: None, 3: "z", 9: "v0"}


def test_item_aggregates_against_python(spark):
    items = [(o, i, f"p{(o * 7 + i * i) % 5}", f"s{(o + i) % 3}", 10.25 * (i + 1), 1.1 * i)
             for o in range(20) for i in range(1 + o % 6)]
    items += [(500, i, f"p{i % 5}", f"s{i % 3}", 0.01, 0.0) for i in range(3000)]  # one order holds most rows
    items.append((501, 1, "unknown", None, None, None))
    products = {"p0": ("x", 5, 2, 3, 4), "p1": ("x", None, 1, 1, 1), "p2": ("y", 7, None, 2, 2), "p3": (None, 9, 1, 2, 3),
                "p4": ("a", 2, 2, 2, 2)}
    sellers = {"s0": "SP", "s1": "RJ", "s2": "SP"}
    got = {r["order_id"]: r for r in X.item_aggregates(
        spark.createDataFrame(items, "order_id bigint, order_item_id bigint, product_id string, seller_id string, "
                                     "price double, freight_value double").repartition(6),
        spark.createDataFrame([(k, *v) for k, v in products.items()],
                              "product_id string, product_category_name string, product_weight_g bigint, "
                              "product_length_cm bigint, product_height_cm bigint, product_width_cm bigint"),
        spark.createDataFrame(list(sellers.items()), "seller_id string, seller_state string")).collect()}
    for order in {r[0] for r in items}:
        mine = [r for r in items if r[0] == order]
        known = [products[r[2]] for r in mine if r[2] in products]
        prices = [r[4] for r in mine if r[4] is not None]
        total = round(sum(prices), 4)
        weights = [p[1] for p in known if p[1] is not None]
        volumes = [p[2] * p[3] * p[4] for p in known if None not in p[2:]]
        cats = Counter(p[0] for p in known if p[0])
        r = got[order]
        assert r["n_items"] == len(mine)
        assert r["total_price"] == total
        assert r["max_price"] == max(prices, default=None)
        assert r["mean_price"] == (None if not prices else total / len(prices))
        assert r["n_unique_products"] == len({x[2] for x in mine})
        assert r["n_unique_sellers"] == len({x[3] for x in mine} - {None})
        assert r["n_seller_states"] == len({sellers.get(x[3]) for x in mine} - {None})
        assert r["mean_product_weight_g"] == (sum(weights) / len(weights) if weights else None)
        assert r["mean_product_volume_cm3"] == (sum(volumes) / len(volumes) if volumes else None)
        assert r["dominant_category"] == (min(cats, key=lambda c: (-cats[c], c)) if cats else None)
        assert abs(r["freight_ratio"] - r["total_freight"] / (total + 1e-6)) < 1e-12


def test_null_dates(spark):
    t = datetime(2018, 3, 31, 23, 0)
    df = spark.createDataFrame(
        [(1, t, t, None), (2, None, t, t), (3, datetime(2018, 4, 1), None, t), (4, datetime(2018, 6, 1), t, t)],
        "id bigint, ts timestamp_ntz, d timestamp_ntz, e timestamp_ntz")
    out = df.select("id", S.temporal_split(F.col("ts"), "2018-04-01 00:00:00", "2018-06-01 00:00:00"),
                    S.label_late(F.col("d"), F.col("e")), S.days_between("ts", "e"))
    assert rows(out, "id") == [
        (1, "train", None, None), (2, "drop", 0, None), (3, "val", None, (datetime(2018, 4, 1) - t).total_seconds() / 86400),
        (4, "test", 0, (datetime(2018, 6, 1) - t).total_seconds() / 86400)]


def test_dates_parts_and_lenient_numbers(spark):
    df = spark.createDataFrame([(datetime(2018, 1, 1, 5), "1d"), (datetime(2018, 1, 7, 23), " 2.5e1 ")],
                               "ts timestamp_ntz, x string")
    got = df.select(S.hour_of_day("ts"), S.day_of_week("ts"), S.month_of_year("ts"), S.lenient_number("x"))
    assert rows(got) == [(5, 0, 1, None), (23, 6, 1, 25.0)]


def test_first_review_is_by_date_then_id(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 1), (2, "z", 9)], "k bigint, id string, d bigint")
    assert rows(X.dedup_first(df, ["k"], ["d", "id"]), "k") == [(1, "c", 1), (2, "z", 9)]


def test_table_has_the_33_columns_with_comments(features):
    assert features.columns == X.feature_table_columns() and len(features.columns) == 33


def test_stored_split_is_used(spark):
    from tarnish.sources import adapter as A
    from conftest import SF

    tables = A.canonical_tables(spark, SF)
    tables["split_orders"] = tables["orders"].select("order_id", F.lit("val").alias("split"))
    of = X.build_order_features(tables)
    assert {r[0] for r in of.select("split").distinct().collect()} == {"val"}
    assert of.schema["n_items"].metadata["comment"] == "Number of items in the order."


def test_small_and_large_orders_alike(spark, monkeypatch):
    """Orders taken together by one task give what the step-by-step way gives, also with repeated keys of dimensions and null keys."""
    items = spark.createDataFrame(
        [(o if o % 9 else None, (o * 7 + i * i) % 6 if i % 4 else None, (o + i) % 4 if i % 3 else None, 10.25 * (i + 1) if i % 5 else None, 1.5 * i)
         for o in range(40) for i in range(1 + o % 7)],
        "order_id bigint, product_id bigint, seller_id bigint, price double, freight_value double").repartition(3)
    products = spark.createDataFrame(
        [(0, "x", 5, 2, 3, 4), (0, "x", None, 1, 1, 1), (0, "y", 7, None, 2, 2), (1, None, 9, 1, 2, 3), (1, None, 9, 1, 2, 3),
         (2, "a", 2, 2, 2, 2), (None, "b", 1, 1, 1, 1), (3, "y", None, None, 1, 1)],
        "product_id bigint, product_category_name string, product_weight_g bigint, product_length_cm bigint, "
        "product_height_cm bigint, product_width_cm bigint")
    sellers = spark.createDataFrame([(0, "SP"), (0, "RJ"), (1, "SP"), (1, "SP"), (2, None), (None, "MG")], "seller_id bigint, seller_state string")
    payments = items.selectExpr("order_id", "if(seller_id = 1, null, concat('t', product_id % 3)) payment_type", "price payment_value",
                                "product_id payment_installments")

    def made():
        return rows(X.item_aggregates(items, products, sellers), "order_id"), rows(X.payment_aggregates(payments), "order_id")

    small = made()
    assert len(small[0]) == 35 and len(small[1]) == 36
    for most in (0, 3):
        monkeypatch.setattr(X, "MOST_ROWS", most)
        assert made() == small


def test_items_are_shuffled_once_a_side(spark):
    """The groupings within an order of items and payments need no shuffle of their own."""
    items = spark.range(10).selectExpr("id order_id", "id payment_sequential", "'x' payment_type", "id payment_installments", "1.0D payment_value")
    small, _ = X._by_size(items)
    plan = X.payment_aggregates(items)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [order_id" in plan and small.columns == items.columns


def test_items_of_an_order_are_sorted_once_for_each_side(spark, monkeypatch):
    monkeypatch.setattr(X, "_by_size", lambda rows: (rows, rows.limit(0)))
    items = spark.createDataFrame([(o, f"p{i % 3}", f"s{i % 4}", 1.0 * i, 0.5) for o in range(9) for i in range(o)] + [(9, None, None, None, None)],
                                  "order_id bigint, product_id string, seller_id string, price double, freight_value double").cache()
    products = spark.createDataFrame([("p0", "x", 5, 8), ("p0", "y", 5, 8), ("p1", None, None, 2)],
                                     "product_id string, product_category_name string, product_weight_g bigint, product_volume_cm3 bigint")
    monkeypatch.setattr(X, "_product_dimensions", lambda dims: dims)
    sellers = spark.createDataFrame([("s0", "SP"), ("s1", "SP"), ("s1", "RJ"), ("s2", None)], "seller_id string, seller_state string")
    for small, large in ((X._small_product_side(items, products), X._product_side(items, products)),
                         (X._small_seller_side(items, sellers), X._seller_side(items, sellers))):
        assert rows(small, "order_id") == rows(large.select(*small.columns), "order_id")
        plan = small._jdf.queryExecution().executedPlan().toString()
        order = [line for line in plan.splitlines() if "Sort [order_id" in line]
        assert len(order) == 1 and "HashAggregate(keys=[order_id" not in plan.replace("`", ""), plan
