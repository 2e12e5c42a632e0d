"""Prompts, answers, scoring with retry, stores."""

import hashlib
import json
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from tarnish import fixed_values as fv
from tarnish.functions import prompts as P
from tarnish.functions.responses import parse_answer
from tarnish.operators import profile as PR
from tarnish.operators import scoring as C
from tarnish.sources import ingest, stores


def test_float_text_is_pythons(spark):
    r = random.Random(1)
    xs = [0.0, -0.0, 1.0, 15.0, 0.1, 1e-3, 1.5e-4, 9.9e-5, 1e-5, 2.5e-12, 1e7, 12345678.5, 1e15, 1e16, 1.5e22, -3.25e-7, -1e7]
    xs += [round(r.uniform(-1e9, 1e9), 2) for _ in range(300)] + [round(r.uniform(0, 1), 4) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [t[0] for t in rows(df.select(F.expr(P.float_text("x"))))]
    assert got == [repr(x) for x in xs]


def test_row_json_is_pythons(spark):
    data = [(3, 2.5, "não \"x\"\n\t\\ / 😀", "", 7), (None, 1e7, None, "y" * 801, 1)]
    df = spark.createDataFrame(data, "a bigint, b double, c string, d string, e int").withColumn(
        "_flipped", F.when(F.col("a").isNotNull(), F.array(F.lit("b"), F.lit("e"))).otherwise(F.array().cast("array<string>")))
    got = [t[0] for t in rows(df.select(P.row_json(df, ["a", "b", "c", "d", "e", "absent"])))]
    first = {"a": 3, "b": "2.5", "c": data[0][2], "d": None, "e": "7", "absent": None}
    second = {"a": None, "b": 1e7, "c": None, "d": "y" * 800 + "…", "e": 1, "absent": None}
    assert got == [json.dumps(first, ensure_ascii=False), json.dumps(second, ensure_ascii=False)]


def test_prompt_blocks(features):
    text = features.limit(1).select(P.prompt(features, "t3", "PROFILE HERE")).first()[0]
    blocks = text.split("\n\n")
    assert blocks[0].startswith("TASK: predict_review_low\nGOAL: Read")
    assert "- review_comment_title: Free-form review title" in text
    assert "TRAINING-SET PROFILE (compact summary):\nPROFILE HERE" in text and text.endswith(fv.OUTPUT_CONTRACT)
    row = json.loads(text.split("ROW:\n")[1].split("\n\nOUTPUT")[0])
    assert list(row) == fv.T2_FEATURE_COLS + fv.TEXT_COLS
    m = features.limit(1).select(P.messages(F.lit("u"))).first()[0]
    assert [(x["role"], x["content"]) for x in m] == [("system", fv.SYSTEM_MESSAGE), ("user", "u")]


CASES = [
    ('{"prediction": 1, "confidence": 0.75, "rationale": "r"}', (1, 0.75, "r", True)),
    ('```json\n{"prediction": 0, "confidence": 1}\n```', (0, 1.0, "", True)),
    ('```\n{"prediction": 0, "confidence": 0}```', (0, 0.0, "", True)),
    ('So: {"prediction": 1, "confidence": 0.5} ok', (1, 0.5, "", True)),
    ('So: {"a": {"prediction": 1, "confidence": 0.5}} ok', (1, 0.5, "", True)),
    ('{"prediction": "1", "confidence": "0.25"}', (1, 0.25, "", True)),
    ('{"prediction": " 1 ", "confidence": 0.25}', (1, 0.25, "", True)),
    ('{"prediction": 1.9, "confidence": 0.25}', (1, 0.25, "", True)),
    ('{"prediction": -0.5, "confidence": 0.25}', (0, 0.25, "", True)),
    ('{"prediction": true, "confidence": false}', (1, 0.0, "", True)),
    ('{"prediction": 1, "confidence": 1e-1, "rationale": 12}', (1, 0.1, "12", True)),
    ('1 {"prediction": 1, "confidence": 0.9}', (1, 0.9, "", True)),
    ('true\n{"prediction": 0, "confidence": 0.9}', (0, 0.9, "", True)),
    ('"late" {"prediction": 1, "confidence": 0.9}', (1, 0.9, "", True)),
    ('{"prediction": 1, "confidence": 0.9, "in": {"prediction": 0, "confidence": 0.25}} so', (0, 0.25, "", True)),
    ('{"prediction": 1, "confidence": 0.5},{"prediction": 0, "confidence": 0.5}', (1, 0.5, "", True)),
    ('{"prediction": 1, "confidence": 0.5, "rationale": null}', (1, 0.5, "None", True)),
    ('{"prediction": 1, "confidence": 0.5, "rationale": false}', (1, 0.5, "False", True)),
    ('{"prediction": 1, "confidence": 0.1, "rationale": "' + "z" * 500 + '"}', (1, 0.1, "z" * 400, True)),
] + [(bad, (-1, 0.0, "", False)) for bad in [
    '{"prediction": "1.9", "confidence": 0.5}', '{"prediction": 2, "confidence": 0.5}', '{"prediction": 1}',
    '{"prediction": 1, "confidence": 1.2}', '{"prediction": null, "confidence": 0.5}', "", "nothing", "[1, 2]", "5", "null",
    '[{"prediction": 1, "confidence": 0.5}]', "], [", '{"prediction": 1, "confidence": [0.5]}', '{"prediction": 1, "confidence": "high"}', "{broken", None]]


#: A value, its closing sign, and an object after it: only the object can be read.
CLOSED = [f"{v} {{\"prediction\": 1, \"confidence\": 0.9, \"rationale\": \"r\"}}"
          for v in ("0]", '"x"]', "0}", "null]", "[1]]", '{"a": 1}]x', "0],[1", '0],"w":[')]


def test_a_closing_sign_is_no_whole_answer(spark):
    df = spark.createDataFrame([(raw,) for raw in CLOSED if not raw.startswith("{")], "raw string")
    assert {(r["prediction"], r["confidence"], r["rationale"], r["ok"]) for r in parse_answer(df, "raw").collect()} == {(1, 0.9, "r", True)}
    first = spark.createDataFrame([(raw,) for raw in CLOSED if raw.startswith("{")], "raw string")  # its first flat object lacks the keys
    assert {r["error"] for r in parse_answer(first, "raw").collect()} == {"missing keys"}


def test_answers(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, raw string")
    got = {r["i"]: r for r in parse_answer(df, "raw").collect()}
    for i, (raw, want) in enumerate(CASES):
        r = got[i]
        assert (r["prediction"], r["confidence"], r["rationale"], r["ok"]) == want, raw
        assert (r["error"] is None) == want[3]


def test_retry_only_asks_again_about_failures(spark):
    df = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(40)], "id bigint, prompt string").repartition(3)
    calls = C.score_prompts(df, ["id"], C.stub_scorer).cache()
    assert calls.filter("attempt = 0").count() == 40
    assert {r["id"] + 1 for r in calls.filter("attempt = 1").collect()} == set(range(5, 41, 5))
    final = {r["id"] + 1: r for r in C.final_answers(calls, ["id"]).collect()}
    assert len(final) == 40
    assert final[10]["prediction"] == -1 and final[10]["agent_score"] == 0.5
    assert final[10]["rationale"].startswith("PARSE_FAIL: ") and final[10]["n_calls"] == 2
    assert final[5]["ok"] and final[5]["n_calls"] == 2 and final[7]["n_calls"] == 1


def test_call_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc"), (2, "x" * 10)], "id bigint, prompt string")
    records = C.call_records(C.score_prompts(df, ["id"], C.stub_scorer), "t2")
    path = str(tmp_path / "log")
    stores.append_calls(records, path)
    stores.append_calls(records, path)
    back = stores.read_calls(spark, path)
    assert back.count() == 2 * records.count()
    assert back.filter("ok").select("parsed.prediction").distinct().first()[0] == 1


def test_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * 3_000_000)
    (tmp_path / "b.csv").write_bytes(b"")
    (tmp_path / "other.csv").write_bytes(b"1")
    got = {r["file"]: r for r in stores.manifest(spark, str(tmp_path), ["a.csv", "b.csv", "c.csv"]).collect()}
    assert set(got) == {"a.csv", "b.csv", "c.csv"}
    assert got["a.csv"]["sha256_16"] == hashlib.sha256(b"x" * 3_000_000).hexdigest()[:16]
    assert [got[f]["present"] for f in ("a.csv", "b.csv", "c.csv")] == [True, False, False]
    assert got["a.csv"]["length"] == 3_000_000 and got["c.csv"]["length"] is None


def test_typed_csv(spark, tmp_path):
    columns = next(c for _, n, c, _ in fv.RAW_TABLES if n == "order_reviews")
    path = tmp_path / "r.csv"
    path.write_text('"review_id","order_id","review_score","review_comment_title","review_comment_message",'
                    '"review_creation_date","review_answer_timestamp"\n'
                    'a,1,5,,"two\nlines, ""quoted""",2018-01-02 00:00:00,2018-01-03 10:11:12\n'
                    'b,2,1,t,,2018-01-02 00:00:00,\n', encoding="utf-8")
    got = rows(ingest.read_raw_csv(spark, str(path), columns, True), "review_id")
    assert got == [("a", "1", 5, None, 'two\nlines, "quoted"', datetime(2018, 1, 2), datetime(2018, 1, 3, 10, 11, 12)),
                   ("b", "2", 1, "t", None, datetime(2018, 1, 2), None)]
    path.write_text("review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,"
                    "review_answer_timestamp\na,1,five,,,,\n")
    with pytest.raises(Exception):
        ingest.read_raw_csv(spark, str(path), columns, True).collect()


def test_raw_tables_need_every_file(spark, tmp_path):
    with pytest.raises(Exception):
        ingest.read_raw_tables(spark, str(tmp_path))
    for file, name, columns, _ in fv.RAW_TABLES:
        lead = "" if name == "category_translation" else "shop_"
        (tmp_path / (lead + file)).write_text(",".join(c for c, _ in columns) + "\n")
    tables = ingest.read_raw_tables(spark, str(tmp_path), "shop_")
    report = {r["table_name"]: r["n_rows"] for r in ingest.write_bronze(tables, str(tmp_path / "bronze")).collect()}
    assert len(report) == 10 and report["TOTAL"] == 0


def test_profile_text_and_cache(spark, features, tmp_path):
    lines = PR.profile_lines(features, "t2", fv.T2_FEATURE_COLS, "y_t2")
    pdf = features.filter("split = 'train' and y_t2 is not null").select(*fv.T2_FEATURE_COLS, "y_t2").toPandas()
    assert lines[0] == f"Training-set profile for task=t2  n_train={len(pdf):,}  prevalence(y=1)={pdf.y_t2.mean():.4f}\n"
    s = pdf["total_price"].dropna()
    want = fv.NUMERIC_PROFILE_LINE.format(
        col="total_price", n=len(s), miss=pdf["total_price"].isna().mean(), mean=s.mean(), std=s.std(), p10=s.quantile(.1),
        p50=s.quantile(.5), p90=s.quantile(.9), mn=s.min(), mx=s.max(), corr=s.corr(pdf.loc[s.index, "y_t2"]))
    assert lines[1 + fv.T2_FEATURE_COLS.index("total_price")] == want
    vc = pdf["customer_state"].value_counts()
    top = sorted(vc.index, key=lambda k: (-vc[k], k))[:3]
    assert lines[1 + fv.T2_FEATURE_COLS.index("customer_state")] == fv.CATEGORICAL_PROFILE_LINE.format(
        col="customer_state", n=int(vc.sum()), miss=pdf["customer_state"].isna().mean(), uniq=len(vc),
        top=", ".join(f"{k}={vc[k]}" for k in top), py=pdf[pdf.customer_state == top[0]].y_t2.mean())
    path = str(tmp_path / "profile")
    made = PR.get_or_make_profile(features, "t2", fv.T2_FEATURE_COLS, "y_t2", path)
    assert made == "\n".join(lines)
    assert PR.get_or_make_profile(features.filter("false"), "t2", [], "y_t2", path) == made
    assert PR.get_or_make_profile(features, "t2", ["n_items"], "y_t2", path, rebuild=True) != made


def test_profile_of_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(i, "train", i % 2, None, 4.0, None) for i in range(6)],
                               "order_id bigint, split string, y_t2 int, a double, b double, s string")
    lines = PR.profile_lines(df, "t2", ["a", "b", "s"], "y_t2")
    assert lines[1] == "a: numeric  n=0  miss=100%  (empty)" and "corr_y=+0.000" in lines[2]
    assert lines[3] == "s: categorical  n=0  miss=100%  (empty)"
    assert not math.isnan(0.0)


def test_a_scorer_is_handed_few_prompts_at_a_time(spark):
    """However many rows a batch holds, only those of one call become Python texts."""
    def counted(prompts, attempt):
        return [(f'{{"prediction": 1, "confidence": 0.5, "rationale": "{len(prompts)}"}}', 1, 1) for _ in prompts]

    df = spark.range(1, 1302, 1, 1).selectExpr("id", "cast(id as string) as prompt", "timestamp'2020-01-01' as at")
    calls = C.score_prompts(df, ["id", "at"], counted).collect()
    assert sorted(r["id"] for r in calls) == list(range(1, 1302)) and all(r["ok"] for r in calls)
    assert {int(r["rationale"]) for r in calls} == {500, 301}


def test_prompts_asked_through_a_store_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return "x" * (i % 50)

    prompts = spark.range(100).select("id", F.udf(text, "string").asNondeterministic()("id").alias("prompt"))
    store = stores.AnswerStore(str(tmp_path / "answers"), "stub", "t2")
    C.score_prompts(prompts, ["id"], C.stub_scorer, store=store)
    asked = {(r["attempt"], r["n"]) for r in store.calls(spark).groupBy("attempt").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert asked == {(0, 50), (1, 10)}
    assert made.value == 100
