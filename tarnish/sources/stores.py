"""Result stores, logs, reports and manifests: what goes in and out besides the feature table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tarnish import fixed_values as fv
from tarnish.session import shuffles_removed


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e)


# ---- append-only stores ----

def append_calls(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").json(path)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(fv.CALL_RECORD_SCHEMA).json(path)


def append_sweep(rows: DataFrame, path: str) -> None:
    """Appends new cells; finished files are never rewritten."""
    rows.write.mode("append").partitionBy("task", "family").parquet(path)


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A stored frame, or an empty one when nothing is stored yet."""
    empty = spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(path).select(*empty.columns)
    except AnalysisException as e:
        if _missing(e):
            return empty
        raise


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """The stored cells, or an empty frame when nothing is stored yet."""
    return _read(spark, fv.SWEEP_SCHEMA, path)


# ---- resumable sweeps ----

CELL_KEYS = ["task", "family", "severity_label", "seed"]
LEDGER_SCHEMA = "run string, task string, family string, severity_label string, seed bigint, n bigint, ts string"
CLEAN_SCHEMA = ("task string, sample_seed bigint, n bigint, family string, severity_label string, seed bigint, severity double, "
                "ml_auc double, agent_auc double, n_rows bigint, tpr double, tnr double, parse_ok bigint")


@dataclass(frozen=True)
class SweepStore:
    """Cells, clean conditions and the ledger of runs of one sweep, side by side.

    A cell is a partition of its own and is written by overwriting just that partition, so writing it again replaces it. The ledger is
    appended after the cells it names are stored: a run that ends in between leaves cells that the next run simply replaces,
    never a duplicate and never a named cell without its result.
    """

    path: str

    def _replace(self, rows: DataFrame, path: str, *keys: str) -> None:
        (rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*keys).parquet(path))

    def write_cells(self, rows: DataFrame) -> None:
        self._replace(rows, self.path, *CELL_KEYS)

    def write_clean(self, rows: DataFrame) -> None:
        columns = rows.sparkSession.createDataFrame([], CLEAN_SCHEMA).columns
        self._replace(rows.select(*columns), f"{self.path}-clean", "task", "sample_seed", "n")

    def clean(self, spark: SparkSession) -> DataFrame:
        return _read(spark, CLEAN_SCHEMA, f"{self.path}-clean")

    def finish(self, cells: DataFrame, n: int) -> None:
        """Names cells (one row each, whose results are stored) as done by one run."""
        cells.select(
            F.lit(uuid.uuid4().hex).alias("run"), *CELL_KEYS, F.lit(n).cast("bigint").alias("n"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"),
        ).coalesce(1).write.mode("append").parquet(f"{self.path}-ledger")

    def ledger(self, spark: SparkSession) -> DataFrame:
        return _read(spark, LEDGER_SCHEMA, f"{self.path}-ledger")


# ---- answers by content ----

@dataclass(frozen=True)
class AnswerStore:
    """Every answer a scorer has given, found again by the digest of its prompt, the scorer's name and the attempt.

    The rows are call records, so the store is the call log of what was really asked and can be priced as such.
    """

    path: str
    scorer: str
    task: str
    mode: str = "a1"

    SCHEMA = f"prompt_sha256 string, scorer string, {fv.CALL_RECORD_SCHEMA}"

    def calls(self, spark: SparkSession) -> DataFrame:
        """The call records of all scorers and tasks."""
        return _read(spark, self.SCHEMA, self.path)

    def answers(self, spark: SparkSession, attempt: int) -> DataFrame:
        """One record for each prompt: the earliest, should two runs have asked at the same time."""
        mine = self.calls(spark).where((F.col("scorer") == self.scorer) & (F.col("attempt") == attempt))
        record = F.struct("ts", "latency_s", "raw", "prompt_tokens", "completion_tokens", "parsed.*", "ok", "error", "attempt")
        return mine.groupBy("prompt_sha256").agg(F.min_by(record, F.struct("ts", "raw")).alias("r")).select("prompt_sha256", "r.*")

    def append(self, records: DataFrame) -> None:
        """Stores call records that carry prompt_sha256."""
        rows = records.withColumn("scorer", F.lit(self.scorer))
        columns = [f.name for f in rows.sparkSession.createDataFrame([], self.SCHEMA).schema]
        with shuffles_removed(rows.sparkSession):
            rows.select(*columns).write.mode("append").partitionBy("scorer", "attempt").parquet(self.path)


# ---- reports ----

def write_json_report(report: DataFrame, path: str) -> None:
    """A report is one row (or one per condition), so one file is its natural form."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_csv_summary(summary: DataFrame, path: str, places: int = 4) -> None:
    rounded = summary.select(*[
        F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in summary.dtypes])
    rounded.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# ---- manifest ----

def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """name, path and size of every file; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        digests = []
        for path in batch["path"]:
            files, inside = fs.FileSystem.from_uri(path)
            h = hashlib.sha256()
            with files.open_input_stream(inside) as stream:
                while chunk := stream.read(1 << 20):
                    h.update(chunk)
            digests.append(h.hexdigest()[:16])
        yield batch.assign(sha256_16=digests)


def manifest(spark: SparkSession, folder: str, expected: list[str]) -> DataFrame:
    """Per expected file: present and not empty, size, first 16 hex digits of its sha256.

    Files are hashed in parallel, each as a stream of small chunks.
    """
    present = file_listing(spark, folder).filter(F.col("file").isin(expected))
    spread = present.repartition(max(1, len(expected)), "file")
    hashed = spread.mapInPandas(_digests, "file string, path string, length bigint, sha256_16 string")
    wanted = spark.createDataFrame([(name,) for name in expected], "file string")
    return wanted.join(hashed.drop("path"), "file", "left").select(
        "file", (F.coalesce(F.col("length"), F.lit(0)) > 0).alias("present"), "length", "sha256_16")
