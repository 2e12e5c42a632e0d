"""From raw documents to token digests of a training corpus, in five stages that are each stored.

Quality rules drop outliers; of near-duplicates one document stays; repeated byte strings are cut out of texts; sources are
interleaved to their target weights, which adds mix_position; the last stage encodes the texts and keeps that place.

Defined results of all stages: a null text counts as empty (and stays null); null ids, languages and sources are values of their own; long
texts are handled whole; an empty table stays empty. Further columns, whatever their names, are carried through every stage but the
last; a column named mix_position is replaced by the place in the mix. Equal rows: the rules judge them alike, of near-duplicates
and rows of equal id and text one stays (any one, if their further columns differ).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.llm import op2_mixing, op5_sentencepiece, op7_bagminhash, op8_suffix_dedup, op10_quality_rules
from tarnish.llm.common import importable, table
from tarnish.session import materialize


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(stage: Stage) -> Stage:
    """The stage with all further columns packed into one, so that none meets a name that an operator uses."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        further = [n for n in names if n not in COLUMNS]
        if not further:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*[n for n in names if n in COLUMNS],
                             F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(further)]).alias("carried"))
        out = stage(spark, packed, sf_dir)
        added = [n for n in out.columns if n not in packed.columns]
        place = {n: F.col(f"carried.c{i}").alias(n) for i, n in enumerate(further)}
        return out.select(*[place.get(n, n) for n in names if n not in added], *added)

    return run


@carrying
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep. Equal rows have equal verdicts, so rows are matched by a hash of what is judged."""
    key = F.xxhash64("doc_id", "text", "lang", "source")
    verdicts = op10_quality_rules.judged(docs.withColumn("_key", key), "_key")
    passed = verdicts.where("kept").select(F.col("_key").alias("_passed")).distinct()
    return docs.withColumn("_key", key).join(passed, F.col("_key") == F.col("_passed"), "left_semi").drop("_key")


@carrying
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_bagminhash.kept_documents(docs)


@carrying
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op8_suffix_dedup.removed(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


@carrying
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_mixing.in_order(op2_mixing.interleaved(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document: its place in the mix and the digests of its ids."""
    return op5_sentencepiece.digests(docs, op5_sentencepiece.model_path(), "mix_position")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixed", mixed),
    ("encoded", encoded),
]

#: No SQL: bag signatures, covariance steps, the schedule and the encoder can't be stated in it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
