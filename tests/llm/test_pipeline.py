"""The stages of the pipeline carry every further column, whatever its name."""

import random

import pytest

pytest.importorskip("tarnish.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tarnish.llm.common import importable  # noqa: E402

NAMES = ["_bucket", "_hash", "_source", "_b", "_place", "_phase", "_k", "_i", "_before", "_plan", "_key", "_passed", "_tk0", "_id0", "_id",
         "_tk", "_ranges", "carried", "a.b", "c0"]


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(900)) for _ in range(n))
    rows = [(i, prose(120), ["en", "de", None][i % 3], ["a", None][i % 2], i) for i in range(24)]
    rows += [(30, rows[3][1], "en", "a", 30), (3, rows[3][1], "de", "a", 3), (None, prose(90), "en", "a", 31), (32, None, "en", "a", 32)]
    kinds = ", ".join(f"`{n}` string" for n in NAMES)
    frame = spark.createDataFrame([(*r, *[f"{n}-{r[4]}" for n in NAMES]) for r in rows],
                                  f"doc_id bigint, text string, lang string, source string, n_chars bigint, {kinds}")
    return frame.repartition(3)


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "repeated_strings", "mixed"])
def test_further_columns_stay(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "")
    assert out.columns == docs.columns + (["mix_position"] if name == "mixed" else [])
    plain = stage(spark, docs.select(*corpus_pipeline.COLUMNS), "")
    mark = {(r["doc_id"], r["text"]): r["n_chars"] for r in docs.collect()}
    found = out.collect()
    assert len(found) == plain.count() > 0
    for r in found:
        i = r[NAMES[0]].split("-")[1]
        assert [r[n] for n in NAMES] == [f"{n}-{i}" for n in NAMES]
        if name != "repeated_strings":  # which recounts n_chars and cuts texts
            assert mark[r["doc_id"], r["text"]] == r["n_chars"] == int(i)


def test_an_empty_table_stays_empty(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "mixed":
            assert stage(spark, docs.limit(0), "").count() == 0
