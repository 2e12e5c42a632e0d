"""Plan, resume, paired evaluation, gate, summaries."""

import pytest
from pyspark.sql import functions as F

from tarnish import fixed_values as fv
from tarnish.functions import scalars as S
from tarnish.operators import corruption as C
from tarnish.operators import ml
from tarnish.operators import scoring as SC
from tarnish.operators import text_features as TF
from tarnish.plans import sweep as W
from tarnish.sources.stores import read_sweep

CELL = ["task", "family", "severity_label", "seed"]


def small_plan():
    return [c for c in W.sweep_plan(["t2"], ["missing_injection", "schema_drift", "type_flip"]) if c.seed in (13, 17)]


def test_plan_size():
    assert len(W.sweep_plan(["t3"])) == 90 and len(W.sweep_plan(["t1"])) == 54
    assert all(bool(c.drifted) == (c.family == "schema_drift") for c in W.sweep_plan(["t2"]))


def test_cells_equal_the_single_family_transform(spark, features):
    cells = [c for c in W.sweep_plan(["t2"], fv.FAMILIES) if c.seed == 13 and c.severity_label == "high"]
    got = W.cell_rows(features, cells, "t2", 60, "capped").cache()
    keys = got.select("order_id").distinct()
    columns = fv.T2_FEATURE_COLS
    for c in cells:
        mine = got.filter(F.col("family") == c.family).select("order_id", *columns)
        if c.family in ("duplicate_rows", "type_flip"):
            want = features  # as values: rows of the sample are never copies
        else:
            want = C.apply(features, c.family, c.severity, c.seed)
        aligned = S.align_columns(want, [(x, features.schema[x].dataType.simpleString()) for x in columns], ["order_id"])
        assert sorted(map(str, mine.collect())) == sorted(map(str, aligned.join(keys, "order_id", "left_semi").collect()))
    flipped = got.filter("family = 'type_flip'").select(F.sum(F.size("_flipped"))).first()[0]
    assert flipped > 0 and got.filter("family <> 'type_flip' and size(_flipped) > 0").count() == 0


def test_every_cell_of_a_seed_sees_the_same_rows(features):
    rows = W.cell_rows(features, small_plan(), "t2", 40, "capped")
    sets = rows.groupBy(*CELL).agg(F.sort_array(F.collect_list("order_id")).alias("ids")).collect()
    assert len(sets) == len(small_plan())
    assert len({(r["seed"], tuple(r["ids"])) for r in sets}) == 2


def test_resume_runs_only_what_is_missing(spark, features, tmp_path):
    path, plan = str(tmp_path / "sweep"), small_plan()
    run = lambda cells: W.resume_sweep(features, cells, 40, W.closed_form_ml, W.closed_form_agent, path)
    assert read_sweep(spark, path).count() == 0
    assert run(plan[:5]) == 5 and run(plan) == len(plan) - 5 and run(plan) == 0
    stored = read_sweep(spark, path)
    assert stored.count() == len(plan) == stored.select(*CELL).distinct().count()
    direct = {tuple(r[c] for c in CELL): r["ml_delta"]
              for r in W.run_sweep(features, plan, 40, W.closed_form_ml, W.closed_form_agent).collect()}
    assert direct == {tuple(r[c] for c in CELL): r["ml_delta"] for r in stored.collect()}


def test_gate_decision_modes(spark):
    df = spark.createDataFrame([("a", float("inf"), "both_zero"), ("a", 1.5, "finite"), ("b", float("inf"), "ml_zero")],
                               "task string, abs_ratio_max double, ratio_status string")
    got = {(s, r["task"]): r["passed"] for s in (False, True)
           for r in W.gate_decision(df, ["task"], strict_reference=s).collect()}
    assert got == {(False, "a"): False, (False, "b"): True, (True, "a"): True, (True, "b"): True}


def test_bootstrap_of_equal_deltas(spark):
    df = spark.createDataFrame([("t", "f", "low", s, 0.25) for s in fv.SEEDS],
                               "task string, family string, severity_label string, seed bigint, ml_delta double")
    r = W.bootstrap_intervals(df, "ml_delta", 50).first()
    assert (r["low"], r["high"], r["n_seeds"]) == (0.25, 0.25, 5)


def test_prompt_agent_in_a_sweep(features):
    cells = small_plan()[:2]
    agent = SC.prompt_agent(SC.stub_scorer, {"t2": "profile"}, [*CELL, "severity", "sample_seed", "order_id"])
    out = W.run_sweep(features, cells, 20, W.closed_form_ml, agent).collect()
    assert len(out) == 2 and all(0 <= r["agent_auc"] <= 1 and 0 < r["parse_ok"] <= 20 for r in out)


def test_trained_consumers(spark, features):
    runs = ml.fit_eval(features, "t2", [13, 17], ("lr", "xgb"), trees=3).collect()
    assert len(runs) == 4 and all(0.5 < r["auroc"] <= 1 and 0 <= r["brier"] <= 1 for r in runs)
    summary = {r["model"]: r for r in ml.summarize_fits(spark.createDataFrame(runs)).collect()}
    assert summary["lr"]["auroc_std"] == 0.0  # the linear fit does not depend on the seed
    consumer = ml.train_consumer(features, "t2", "lr")
    rows = W.cell_rows(features, small_plan(), "t2", 40, "capped")
    scored = consumer(rows, "t2")
    assert set(rows.columns) < set(scored.columns) and scored.filter("ml_score is null").count() == 0
    # numbers arriving as text read as the same numbers
    flips = scored.groupBy("family").agg(F.count("*").alias("n")).collect()
    assert len(flips) == 3
    test = features.filter("split = 'test'").withColumn("y", F.col("y_t2"))
    clean = {r["order_id"]: r["ml_score"] for r in consumer(test, "t2").collect()}
    text = {r["order_id"]: r["ml_score"] for r in consumer(C.apply(test, "type_flip", 0.5, 1), "t2").collect()}
    assert clean == pytest.approx(text)
    gone = consumer(test.drop("total_price", "customer_state"), "t2")
    assert gone.filter("ml_score is null").count() == 0
    with pytest.raises(ValueError):
        consumer(rows, "t3")


def test_preprocessor_text_modes(features):
    rows = features.filter("y_t3 is not null")
    pre = ml.Preprocessor.fit(rows, "t3")
    assert [m.text for m in pre.vocab] == fv.TEXT_COLS and pre.vocab[1].words
    assert ml.Preprocessor.fit(rows, "t3", text_as_numeric=True).vocab == []
    assert pre.transform(rows, True).select("features").first()[0].size > 100


def test_sparse_assembly_is_saved_and_read_back(spark, features, tmp_path):
    rows = features.filter("y_t3 is not null")
    pre = ml.Preprocessor.fit(rows.filter("split = 'train'"), "t3")
    pre.save(str(tmp_path / "pre"))
    again = ml.Preprocessor.load(spark, str(tmp_path / "pre"))
    pick = lambda p, df: {r["order_id"]: r["features"] for r in p.transform(df, True).select("order_id", "features").collect()}
    first = pick(pre, rows)
    assert pick(again, rows) == first and len(first) == rows.count()
    assert any(hasattr(v, "indices") for v in first.values())  # sparse where that is smaller
    # the one of each level stands at its slot, an unseen level has none
    slots = {(r["column"], r["level"]): r["slot"] for r in pre.slots.collect()}
    for r in rows.limit(200).collect():
        v, start = first[r["order_id"]].toArray(), len(pre.numeric)
        for c in pre.categorical:
            part = v[start:start + pre.widths[c]]
            slot = slots.get((c, fv.MISSING_LEVEL if r[c] is None else str(r[c])))
            assert [i for i, x in enumerate(part) if x] == ([] if slot is None else [slot])
            start += pre.widths[c]
    unseen = rows.limit(5).withColumn("customer_state", F.lit("nowhere"))
    at = len(pre.numeric) + sum(pre.widths[c] for c in pre.categorical[:pre.categorical.index("customer_state")])
    assert all(not v.toArray()[at:at + pre.widths["customer_state"]].any() for v in pick(pre, unseen).values())


def test_level_slots(spark):
    df = spark.createDataFrame([("b",)] * 20 + [("a",)] * 25 + [("rare",)] * 3 + [(None,)] * 21, "customer_state string")
    got = {r["level"]: r["slot"] for r in ml.level_slots(df, ["customer_state"]).collect()}
    assert got == {"__missing__": 0, "a": 1, "b": 2, "rare": 3}


@pytest.mark.parametrize("top", [12, 100])
def test_tfidf_against_python(spark, top):
    import math
    import re
    import unicodedata
    from collections import Counter

    docs = [f"Não {w} coração ok_{i % 3} a {'bom ' * (i % 4)}Ótimo!" for i, w in enumerate("xy yz xy zz yy xy zz xy".split())]
    docs += ["", None, "b", "1ª opção 2º ﬁm Ĳssel Việt Nam йод ｆｕｌｌ café ok", "1a opcao 2o fim ijssel Viet Nam иод full Cafe\u0301 cafe cafe cafe ok", "a\u0301\u0323b ab ab"]

    def grams(text):
        plain = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
        words = re.findall(r"\b\w\w+\b", plain)
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    counts = [Counter(grams(d)) for d in docs]
    df_, total = Counter(), Counter()
    for c in counts:
        df_.update(c.keys())
        total.update(c)
    vocab = sorted((t for t in df_ if df_[t] >= 2), key=lambda t: (-total[t], t))[:top]
    idf = {t: math.log((1 + len(docs)) / (1 + df_[t])) + 1 for t in vocab}
    want = {}
    for i, c in enumerate(counts):
        w = {t: (1 + math.log(c[t])) * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, t): x / norm for t, x in w.items()}
    frame = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    got = {(r["id"], r["term"]): r["weight"] for r in TF.tfidf(frame, ["id"], "text", top, 2).collect()}
    assert got == pytest.approx(want)
    assert top == 12 or {"1a", "2o", "fim", "ijssel", "viet", "иод", "full", "cafe"} <= {t for _, t in got}
    model = TF.TfidfModel.fit(frame, "text", top, 2)
    vectors = {r["id"]: r["v"] for r in model.transform(frame, "v").collect()}
    assert {(i, model.words[j]): x for i, v in vectors.items() for j, x in zip(v.indices, v.values)} == pytest.approx(want)


def test_texts_are_dealt_out_before_they_are_cut_into_terms(spark):
    frame = spark.createDataFrame([("a b cc dd",)] * 5, "text string")
    assert "RebalancePartitions" in TF.vocabulary(frame, "text", 10, 1)._jdf.queryExecution().analyzed().toString()


def test_terms_are_shuffled_as_numbers(spark):
    frame = spark.createDataFrame([(i % 3, "aa bb cc aa " * (i + 1)) for i in range(6)], "id int, text string")
    plan = TF.tfidf(frame, ["id"], "text", 10, 1)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [" in line or "Window [" in line]
    assert len(grouped) == 2 and not any("term" in line or "idf" in line.split("windowspec")[0].split("AS _w")[0] for line in grouped)
