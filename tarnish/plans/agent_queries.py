"""Registered queries: prompts, answers, call logs, stores and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnish import fixed_values as fv
from tarnish.functions import prompts as P
from tarnish.functions import scalars as S
from tarnish.functions.responses import parse_answer
from tarnish.operators import metrics as M
from tarnish.operators import profile as PR
from tarnish.operators import reports as R
from tarnish.operators import scoring as C
from tarnish.operators.order_statistics import auroc
from tarnish.operators.sampling import stratified_samples
from tarnish.session import scratch_path
from tarnish.sources import adapter as A
from tarnish.sources import ingest, stores
from tarnish.sources.silver import silver, write_silver, read_silver

ROW_COLUMNS = ["purchase_hour", "purchase_dow", "n_items", "n_payments", "max_installments", "payment_type_modal",
               "customer_state", "dominant_category", "review_comment_title", "review_comment_message"]


def p15(spark, sf):
    of = silver(spark, sf)
    return of.select("order_id", P.row_json(of, ROW_COLUMNS).alias("row"))


def p15_numbers(spark, sf):
    of = silver(spark, sf)
    return of.select("order_id", P.row_json(of, ["total_price", "total_freight", "days_to_estimated",
                                                 "mean_product_weight_g", "days_to_approved"]).alias("row"))


def test_pool(spark, sf):
    return silver(spark, sf).filter("split = 'test' and y_t2 is not null")


def t2_profile(spark, sf):
    return "\n".join(PR.profile_lines(silver(spark, sf), "t2", fv.T2_FEATURE_COLS, "y_t2"))


def prompts(spark, sf):
    pool = test_pool(spark, sf)
    return pool.select("order_id", F.col("y_t2").alias("y"), P.prompt(pool, "t2", t2_profile(spark, sf)).alias("prompt"))


def g1(spark, sf):
    m = prompts(spark, sf).select("order_id", P.messages(F.col("prompt")).alias("m"))
    return m.select("order_id", *[
        F.col("m")[i][k].alias(f"{k}_{i}") for i in (0, 1) for k in ("role", "content")])


def raw_answers(spark, sf):
    """One answer per event, of twenty-one shapes, from well-formed to unusable."""
    k = F.get_json_object("props", "$.k")
    conf = F.concat(F.lit("0."), F.lpad(k, 2, "0"))
    good = lambda p, c=conf: F.concat(
        F.lit('{"prediction": '), F.lit(p), F.lit(', "confidence": '), c, F.lit(', "rationale": "'),
        F.col("event_type"), F.lit('"}'))
    shapes = [
        good("1"), F.concat(F.lit("```json\n"), good("0"), F.lit("\n```")),
        F.concat(F.lit("My answer: "), good("1"), F.lit(" I hope it helps.")),
        F.lit('see {"a": {"prediction": 1}} there'), F.lit('{"prediction": 1}'), good("2"), good("1", F.lit("1.2")),
        good('"1"'), good('"1.9"'), good("1.9"), good("true"), F.lit(""), F.lit("[1, 2]"), F.lit(None).cast("string"),
        F.concat(F.lit('  {"confidence": "0.5", "prediction": 0, "rationale": "'), F.repeat(F.col("event_type"), 150),
                 F.lit('"}\n')),
        F.lit('{"prediction": null, "confidence": 0.5}'),
        F.concat(F.lit("1 "), good("1")), F.concat(F.lit("true\n"), good("0")), F.concat(F.lit('"late" '), good("1")),
        F.lit('{"prediction": 1, "confidence": 0.9, "inner": {"prediction": 0, "confidence": 0.25, "rationale": "in"}} so'),
        F.lit('{"prediction": 1, "confidence": 0.5, "rationale": null}'),
    ]
    raw = F.element_at(F.array(*shapes), (F.col("event_id") % 21 + 1).cast("int"))
    return A.read_table(spark, sf, "events").withColumn("raw", raw)


def g2(spark, sf):
    return parse_answer(raw_answers(spark, sf).select("event_id", "raw"), "raw").select(
        "event_id", "prediction", "confidence", "rationale", "ok", "error")


def calls(spark, sf):
    return C.score_prompts(prompts(spark, sf).select("order_id", "prompt"), ["order_id"], C.stub_scorer)


def g3(spark, sf):
    return C.final_answers(calls(spark, sf), ["order_id"])


def stored_answers(spark, sf):
    """The prompts of the test pool, asked through a store of answers; its calls and the store."""
    store = stores.AnswerStore(scratch_path(spark, "answers"), "stub", "t2")
    asked = prompts(spark, sf).select("order_id", "prompt")
    return C.score_prompts(asked, ["order_id"], C.stub_scorer, store=store), store


def g3_stored(spark, sf):
    """Asked twice; the second time all answers come from the store."""
    _, store = stored_answers(spark, sf)

    def closed(prompts, attempt):
        raise RuntimeError("a stored answer was asked for again")

    again = C.score_prompts(prompts(spark, sf).select("order_id", "prompt"), ["order_id"], closed, store=store)
    return C.final_answers(again, ["order_id"])


def a15_stored(spark, sf):
    """What the stored answers cost: each prompt and attempt once, however many rows share the prompt."""
    _, store = stored_answers(spark, sf)
    return R.token_costs(store.calls(spark), ["scorer", "task", "attempt"])


def g4(spark, sf):
    r = C.call_records(calls(spark, sf), "t2")
    return r.select("task", "mode", "attempt", "ok", "error", "prompt_tokens", "completion_tokens", "total_tokens",
                    "raw", F.col("parsed.prediction").alias("prediction"), F.col("parsed.confidence").alias("confidence"))


def g5(spark, sf):
    """The clean-baseline report over the whole test pool."""
    of = silver(spark, sf)
    sample = stratified_samples(of.filter("split = 'test'"), "y_t2", None, [13], mode="pool")
    asked = prompts(spark, sf).join(sample.select("order_id"), "order_id", "left_semi")
    made = C.score_prompts(asked.select("order_id", "prompt"), ["order_id"], C.stub_scorer)
    answers = C.final_answers(made, ["order_id"]).join(asked.select("order_id", "y"), "order_id")
    one = F.lit("t2").alias("task")
    areas = auroc(answers.select(one, "y", "agent_score"), ["task"], "y", "agent_score").select("task", "auroc")
    stats = M.classification_metrics(answers.select(one, "y", "prediction", "ok"), ["task"], "y", "prediction", ok="ok")
    costs = R.token_costs(C.call_records(made, "t2"), ["task"])
    return areas.join(stats, "task").join(costs, "task").select(
        "task", "n", "n_pos", "n_neg", "parse_ok", "prompt_tokens", "completion_tokens", "total_tokens", "cost",
        *[F.round(c, 6).alias(c) for c in ("auroc", "f1", "tpr", "tnr", "parse_ok_rate")])


def event_calls(spark, sf):
    """Call records made from the event table."""
    e = parse_answer(raw_answers(spark, sf), "raw")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.element_at(F.array(F.lit("t1"), F.lit("t2"), F.lit("t3")), (F.col("user_id") % 3 + 1).cast("int")).alias("task"),
        F.lit("a1").alias("mode"), (F.col("event_id") % 2).cast("int").alias("attempt"), "ok", "error",
        F.round(F.col("value") / 10, 3).alias("latency_s"),
        (F.col("user_id") * 7 + 100).alias("prompt_tokens"), F.length("event_type").cast("bigint").alias(
            "completion_tokens"),
        (F.col("user_id") * 7 + 100 + F.length("event_type")).alias("total_tokens"), "raw",
        F.struct("prediction", "confidence", "rationale").alias("parsed"))


def stored_calls(spark, sf):
    path = scratch_path(spark, "call-log")
    stores.append_calls(event_calls(spark, sf), path)
    return stores.read_calls(spark, path)


def s6(spark, sf):
    return stored_calls(spark, sf).select(
        "ts", "task", "mode", "attempt", "ok", "error", "prompt_tokens", "completion_tokens", "total_tokens", "raw",
        "parsed.prediction", "parsed.confidence", "parsed.rationale")


def a16(spark, sf):
    e = parse_answer(raw_answers(spark, sf), "raw").withColumn("y", (F.col("user_id") % 2).cast("int"))
    return R.pilot_report(e, "y", ["event_type"])


def s1(spark, sf):
    """Reviews through CSV: written as an export, read back with declared types."""
    path = scratch_path(spark, "raw-reviews")
    columns = next(c for _, name, c, _ in fv.RAW_TABLES if name == "order_reviews")
    reviews = A.order_reviews(spark, sf).select([F.col(n).cast(t).alias(n) for n, t in columns])
    reviews.write.options(header=True, escape='"', timestampNTZFormat="yyyy-MM-dd HH:mm:ss",
                          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return ingest.read_raw_csv(spark, path, columns, line_breaks=True)


def s1_rejects(spark, sf):
    """Lines as CSV, one in 97 with a price that is no number and one in 89 cut short: what is stored and what is rejected."""
    raw, folder = scratch_path(spark, "raw-lines"), scratch_path(spark, "bronze")
    text = lambda c: F.col(c).cast("string")
    bad = F.when(F.col("l_orderkey") % 97 == 0, F.lit("n/a")).otherwise(text("l_extendedprice"))
    whole = F.concat_ws(",", text("l_orderkey"), text("l_partkey"), text("l_linenumber"), bad)
    line = F.when(F.col("l_orderkey") % 89 == 0, text("l_orderkey")).otherwise(whole)
    A.read_table(spark, sf, "lineitem").select(line.alias("value")).write.text(raw)
    columns = [("order_key", "bigint"), ("part_key", "bigint"), ("line_no", "int"), ("price", "double")]
    report = ingest.ingest_csv(spark, raw, "lines", columns, False, folder, limit=0.1, header=False)
    name = F.lit("lines").alias("table_name")
    kept = spark.read.parquet(f"{folder}/lines").groupBy(name).agg(
        F.sum("order_key").alias("kept_keys"), F.sum(F.col("price").cast("decimal(20,2)")).cast("double").alias("kept_price"))
    rejects = spark.read.parquet(f"{folder}/quarantine/lines").groupBy(name).agg(F.sum(F.length("record")).alias("rejected_chars"))
    return report.join(kept, "table_name").join(rejects, "table_name")


def s2(spark, sf):
    return ingest.write_bronze(A.canonical_tables(spark, sf), scratch_path(spark, "bronze"))


def s3(spark, sf):
    """All stored tables by name: rows of each, and two groupings, in SQL."""
    path, tables = scratch_path(spark, "bronze"), A.canonical_tables(spark, sf)
    ingest.write_bronze(tables, path)
    ingest.read_tables(spark, path, list(tables), views=True)
    counts = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in tables)
    return spark.sql(f"""{counts} UNION ALL SELECT seller_state, count(*) FROM sellers GROUP BY 1
        UNION ALL SELECT product_category_name, count(*) FROM products GROUP BY 1""")


def s4(spark, sf):
    path = scratch_path(spark, "silver")
    write_silver(silver(spark, sf), path)
    return read_silver(spark, path)


def s7(spark, sf):
    """Two appends of sweep rows, made from events, read back as one store."""
    from tarnish.plans.sweep import results_from_events

    path = scratch_path(spark, "sweep-store")
    keys = ["task", "family", "severity_label", "seed"]
    rows = results_from_events(spark, sf).dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    known = {"n", *keys}
    full = rows.select(*[
        F.col(f.split()[0]) if f.split()[0] in known else F.lit(None).cast(f.split()[1]).alias(f.split()[0])
        for f in fv.SWEEP_SCHEMA.split(", ")])
    for task in (["t1"], ["t2", "t3"]):
        stores.append_sweep(full.filter(F.col("task").isin(task)), path)
    return stores.read_sweep(spark, path).select(*keys, "n")


def s8(spark, sf):
    path = scratch_path(spark, "split-report")
    from tarnish.operators.features import split_labels

    stores.write_json_report(R.split_summary(split_labels(A.orders(spark, sf), A.TRAIN_END, A.VAL_END)), path)
    return spark.read.schema("n_total bigint, n_train bigint, n_val bigint, n_test bigint, n_drop bigint, "
                             "frac_train double, frac_val double, frac_test double").json(path)


def s9(spark, sf):
    path = scratch_path(spark, "summary")
    rows = A.read_table(spark, sf, "events").groupBy("event_type").agg(
        F.avg("value").alias("value_mean"), F.stddev_samp("value").alias("value_std"))
    stores.write_csv_summary(rows, path)
    return spark.read.schema("event_type string, value_mean double, value_std double").option("header", True).csv(path)


def s10(spark, sf):
    names = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
             "labels conversations").split()
    return stores.manifest(spark, sf, [f"{n}.parquet" for n in names])


def s11(spark, sf):
    path = scratch_path(spark, "profile")
    of = silver(spark, sf)
    made = [PR.get_or_make_profile(of, "t2", fv.T2_FEATURE_COLS, "y_t2", path) for _ in range(2)]
    return spark.createDataFrame([(i, s) for i, s in enumerate(made[1].split("\n"))], "line_no int, line string")


def j12(spark, sf):
    of = silver(spark, sf)
    described = F.create_map(*[F.lit(x) for kv in fv.COLUMN_DESCRIPTIONS.items() for x in kv])
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("filled")) for c in of.columns])).alias("c")
    counts = of.select(cells).groupBy("c.column").agg(F.count_if("c.filled").alias("n"))
    return counts.withColumn("description", F.coalesce(F.element_at(described, F.col("column")), F.lit(fv.NO_DESCRIPTION)))


QUERIES = {
    "s1_typed_csv": s1,
    "s1_rejected_records": s1_rejects,
    "s2_bronze_report": s2,
    "s3_named_tables": s3,
    "s4_silver_store": s4,
    "s5_s6_call_log": s6,
    "s7_sweep_store": s7,
    "s8_json_report": s8,
    "s9_csv_summary": s9,
    "s10_manifest": s10,
    "s11_cached_profile": s11,
    "j12_column_descriptions": j12,
    "p15_row_json": p15,
    "p15_row_json_numbers": p15_numbers,
    "g1_prompts": g1,
    "g2_parse_answers": g2,
    "g3_batch_scoring": g3,
    "g3_stored_answers": g3_stored,
    "a15_stored_answer_costs": a15_stored,
    "g4_call_records": g4,
    "g5_agent_baseline": g5,
    "a15_token_costs": lambda s, d: R.token_costs(stored_calls(s, d), ["task"]),
    "a16_pilot_report": a16,
}
