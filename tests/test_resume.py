"""Sweeps that are killed and resumed, and answers that are asked for once."""

import pytest
from pyspark.sql import functions as F

from tarnish.operators import reports as R
from tarnish.operators import scoring as SC
from tarnish.plans import sweep as W
from tarnish.sources.stores import AnswerStore, SweepStore, read_sweep

CELL = ["task", "family", "severity_label", "seed"]
KEYS = [*CELL, "severity", "sample_seed", "order_id"]


def plan(families):
    return [c for c in W.sweep_plan(["t2"], families) if c.seed in (13, 17)]


def stored(spark, path):
    rows = read_sweep(spark, path).collect()
    found = {tuple(r[c] for c in CELL): (r["ml_delta"], r["agent_delta"], r["abs_ratio_max"], r["parse_ok"]) for r in rows}
    assert len(found) == len(rows)  # no duplicate
    return found


def test_a_killed_sweep_does_only_the_rest(spark, features, tmp_path, monkeypatch):
    path, cells = str(tmp_path / "sweep"), plan(["missing_injection", "schema_drift", "type_flip"])
    asked = []

    def agent(rows, task):
        asked.append(sorted({r["family"] for r in rows.select("family").distinct().collect()}))
        return W.closed_form_agent(rows, task)

    def dying(rows, task):
        if len(asked) == 3:  # the clean conditions and two groups are through
            raise KeyboardInterrupt
        return agent(rows, task)

    with pytest.raises(KeyboardInterrupt):
        W.resume_sweep(features, cells, 40, W.closed_form_ml, dying, path)
    assert asked == [["clean"], ["missing_injection"], ["schema_drift"]]
    before = stored(spark, path)
    assert {k[1] for k in before} == {"missing_injection", "schema_drift"}
    files = set(map(str, (tmp_path / "sweep").rglob("*.parquet")))

    # killed between the results and the ledger: the cells are there, but not named
    with monkeypatch.context() as m:
        m.setattr(SweepStore, "finish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            W.resume_sweep(features, cells, 40, W.closed_form_ml, agent, path)
    assert set(stored(spark, path)) == {(c.task, c.family, c.severity_label, c.seed) for c in cells}

    asked.clear()
    assert W.resume_sweep(features, cells, 40, W.closed_form_ml, agent, path) == 6 and asked == [["type_flip"]]
    assert W.resume_sweep(features, cells, 40, W.closed_form_ml, agent, path) == 0 and asked == [["type_flip"]]
    assert files <= set(map(str, (tmp_path / "sweep").rglob("*.parquet")))  # finished cells were never rewritten
    direct = {tuple(r[c] for c in CELL): (r["ml_delta"], r["agent_delta"], r["abs_ratio_max"], r["parse_ok"])
              for r in W.run_sweep(features, cells, 40, W.closed_form_ml, W.closed_form_agent).collect()}
    assert stored(spark, path) == direct
    ledger = SweepStore(path).ledger(spark)
    assert ledger.count() == len(cells) and ledger.select("run").distinct().count() == 3

    # another sample size is another sweep of the same cells
    assert W.resume_sweep(features, cells[:2], 20, W.closed_form_ml, agent, path) == 2
    assert set(stored(spark, path)) == set(direct) and read_sweep(spark, path).where("n = 20").count() == 2


def refusing():
    def no_calls(prompts, attempt):
        raise AssertionError("asked again")

    return no_calls


def test_a_repeated_sweep_asks_nothing(spark, features, tmp_path):
    cells, answers = plan(["missing_injection"])[:2], str(tmp_path / "answers")
    run = lambda scorer: W.run_sweep(
        features, cells, 20, W.closed_form_ml, SC.prompt_agent(scorer, {"t2": "profile"}, KEYS, answers, "stub-1"))
    first = sorted(map(str, run(SC.stub_scorer).collect()))
    log = AnswerStore(answers, "stub-1", "t2").calls(spark)
    assert log.groupBy("prompt_sha256", "attempt").count().where("count > 1").count() == 0
    assert sorted(map(str, run(refusing()).collect())) == first
    plain = W.run_sweep(features, cells, 20, W.closed_form_ml, SC.prompt_agent(SC.stub_scorer, {"t2": "profile"}, KEYS))
    assert sorted(map(str, plain.collect())) == first
    # the log prices what was really asked
    costs = R.token_costs(log, ["task"]).first()
    sums = log.agg(F.sum("prompt_tokens"), F.sum("completion_tokens")).first()
    assert (costs["task"], costs["prompt_tokens"], costs["completion_tokens"]) == ("t2", *sums)


def test_shared_prompts_are_asked_once(spark, tmp_path):
    path = str(tmp_path / "answers")
    rows = spark.createDataFrame([(i, "p" * (i % 7 + 8)) for i in range(60)] + [(60, None)], "id int, prompt string").where("id < 60")
    store = AnswerStore(path, "stub", "t1")
    with_store = SC.score_prompts(rows, ["id"], SC.stub_scorer, store=store).collect()
    without = SC.score_prompts(rows, ["id"], SC.stub_scorer).collect()
    pick = lambda calls: sorted((r["id"], r["attempt"], r["raw"], r["ok"], r["prediction"], r["confidence"]) for r in calls)
    assert pick(with_store) == pick(without)
    log = store.calls(spark).collect()
    # lengths 8 to 14; the first attempt fails for 10 only, the second asks for it again
    assert sorted((r["attempt"], r["prompt_tokens"]) for r in log) == sorted([(0, n // 4) for n in range(8, 15)] + [(1, 2)])
    # another scorer's answers are its own
    other = AnswerStore(path, "other", "t1")
    assert other.answers(spark, 0).count() == 0
    SC.score_prompts(rows, ["id"], SC.stub_scorer, store=other).collect()
    assert store.calls(spark).count() == 2 * len(log)


def test_the_earliest_of_two_answers_counts(spark, tmp_path):
    store = AnswerStore(str(tmp_path / "answers"), "stub", "t1")
    rows = spark.createDataFrame([(1, "p" * 9)], "id int, prompt string")
    first = SC.score_prompts(rows, ["id"], SC.stub_scorer, store=store).first()
    store.append(store.calls(spark).withColumn("ts", F.lit("9999-01-01T00:00:00+00:00")).withColumn("raw", F.lit("late")))
    again = SC.score_prompts(rows, ["id"], refusing(), store=store).collect()
    assert [r["raw"] for r in again] == [first["raw"]]


def test_distinct_prompts_are_not_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SC, "scratch_path", lambda spark, name: str(tmp_path / name))
    rows = spark.createDataFrame([(i, f"the same start {i % 3} the same end") for i in range(30)], "id int, prompt string")
    calls = SC.score_prompts(rows, ["id"], SC.stub_scorer, store=AnswerStore(str(tmp_path / "answers"), "stub", "t1"))
    assert not (tmp_path / "distinct-prompts").exists() and calls.select("id").distinct().count() == 30
