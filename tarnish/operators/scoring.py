"""Batch scoring of prompts by a pluggable scorer, with one retry of malformed answers.

The scorer is the only Python in the path. Each attempt's answers are stored before the
next step reads them, so a lost executor never asks for the same answer twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.functions import scalars as S
from tarnish.functions.responses import FAIL_RATIONALE, parse_answer
from tarnish.operators.reports import union_all
from tarnish.session import discard, materialize, scratch_path, ship_package
from tarnish.sources.stores import AnswerStore

#: Prompts that are handed to the scorer together.
CALL_PROMPTS = 500

# prompts and attempt number in; (raw answer, prompt tokens, completion tokens) per prompt out
PromptScorer = Callable[[list[str], int], list[tuple[str, int, int]]]


def _ask(prompts: DataFrame, scorer: PromptScorer, attempt: int) -> DataFrame:
    ship_package(prompts.sparkSession)

    names = [c for c in prompts.columns if c != "prompt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a batch may hold thousands of long prompts; only those of one call become Python texts
            for part in (batch.slice(at, CALL_PROMPTS) for at in range(0, batch.num_rows, CALL_PROMPTS)):
                t0 = time.time()
                answers = scorer(part.column("prompt").to_pylist(), attempt)
                spent, now, n = round((time.time() - t0) / part.num_rows, 3), datetime.now(timezone.utc).isoformat(), part.num_rows
                made = {"ts": pa.array([now] * n, pa.string()), "latency_s": pa.array([spent] * n, pa.float64()),
                        "raw": pa.array([a[0] for a in answers], pa.string()),
                        "prompt_tokens": pa.array([a[1] for a in answers], pa.int64()),
                        "completion_tokens": pa.array([a[2] for a in answers], pa.int64())}
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + list(made.values()), names=names + list(made))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields if f.name != "prompt")
    schema = kept + ", ts string, latency_s double, raw string, prompt_tokens bigint, completion_tokens bigint"
    return parse_answer(prompts.mapInArrow(run, schema), "raw").withColumn("attempt", F.lit(attempt))


def score_prompts(prompts: DataFrame, keys: list[str], scorer: PromptScorer, retries: int = 1,
                  store: AnswerStore | None = None) -> DataFrame:
    """One row per call: keys…, attempt, answer, tokens, ok, error. ``prompts`` has keys… and prompt.

    With a store only prompts that it has no answer to are asked, each once however many rows share it, and a row's calls are
    those that gave it its answers, made now or earlier.
    """
    if store is not None:
        return _stored_answers(prompts, keys, scorer, retries, store)
    waiting, calls = prompts.select(*keys, "prompt"), []
    for attempt in range(retries + 1):
        asked = materialize(_ask(waiting, scorer, attempt), f"calls-{attempt}")
        calls.append(asked)
        waiting = waiting.join(asked.filter(~F.col("ok")).select(*keys), keys, "left_semi")
    return union_all(calls)


def _stored_answers(prompts: DataFrame, keys: list[str], scorer: PromptScorer, retries: int, store: AnswerStore) -> DataFrame:
    spark, digest, calls = prompts.sparkSession, "prompt_sha256", []
    waiting, path = prompts.select(*keys, F.sha2("prompt", 256).alias(digest), "prompt"), scratch_path(prompts.sparkSession, "distinct-prompts")
    # equal prompts are merged before the shuffle, so a prompt that many rows share is no hot key; they are made and merged once
    # for all attempts, and a later attempt finds those it asks about by their digests. They share much text, which zstd packs
    distinct = materialize(waiting.select(digest, "prompt").dropDuplicates([digest]), "distinct-prompts", path, "zstd")
    for attempt in range(retries + 1):
        fresh = distinct.join(store.answers(spark, attempt).select(digest), digest, "left_anti")
        store.append(call_records(_ask(fresh, scorer, attempt), store.task, store.mode, digest))
        known = store.answers(spark, attempt)  # read anew: what was there and what was just stored
        calls.append(waiting.drop("prompt").join(known, digest).drop(digest))
        failed = known.where(~F.col("ok")).select(digest)
        waiting, distinct = waiting.join(failed, digest, "left_semi"), distinct.join(failed, digest, "left_semi")
    discard(spark, path)  # the calls are read from the store
    return union_all(calls)


def final_answers(calls: DataFrame, keys: list[str]) -> DataFrame:
    """The accepted answer per prompt, or the failure mark with the last error."""
    accepted = lambda c: F.max(F.when(F.col("ok"), F.col(c)))
    last = F.max_by("error", F.when(~F.col("ok"), F.col("attempt")))
    answers = calls.groupBy(*keys).agg(
        F.coalesce(accepted("prediction"), F.lit(-1)).alias("prediction"),
        F.coalesce(accepted("confidence"), F.lit(0.0)).alias("confidence"),
        F.coalesce(accepted("rationale"), F.concat(F.lit(FAIL_RATIONALE), last)).alias("rationale"),
        F.max("ok").alias("ok"), F.count(F.lit(1)).alias("n_calls"))
    return answers.withColumn("agent_score", S.positive_score(F.col("prediction"), F.col("confidence")))


def call_records(calls: DataFrame, task: str, mode: str = "a1", *keep: str) -> DataFrame:
    """The stored form of calls, after the columns to keep."""
    return calls.select(
        *keep, "ts", F.lit(task).alias("task"), F.lit(mode).alias("mode"), F.col("attempt").cast("int").alias("attempt"),
        "ok", "error", "latency_s", "prompt_tokens", "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), "raw",
        F.struct("prediction", "confidence", "rationale").alias("parsed"))


def prompt_agent(scorer: PromptScorer, profiles: dict[str, str], keys: list[str], answers: str | None = None,
                 name: str = "scorer"):
    """A sweep consumer that asks ``scorer`` about the prompt of every row.

    ``answers`` is the path of a store of answers: rows whose prompt the corruption left alone, and repeated sweeps, cost no call.
    ``name`` stands for the scorer and its settings there.
    """
    from tarnish.functions.prompts import prompt

    def agent(rows: DataFrame, task: str) -> DataFrame:
        stored = materialize(rows, "cell-rows")
        prompts = stored.select(*keys, prompt(stored, task, profiles[task]).alias("prompt"))
        store = AnswerStore(answers, name, task) if answers else None
        return stored.join(final_answers(score_prompts(prompts, keys, scorer, store=store), keys), keys)

    return agent


def stub_scorer(prompts: list[str], attempt: int) -> list[tuple[str, int, int]]:
    """Deterministic stand-in for a model: the answer depends on the length of the prompt only."""
    out = []
    for p in prompts:
        n = len(p)
        if n % (5 * (attempt + 1)) == 0:
            raw = "cannot say"
        else:
            raw = f'{{"prediction": {n % 2}, "confidence": 0.{n % 100:02d}, "rationale": "length"}}'
        out.append((raw, n // 4, len(raw) // 4))
    return out
