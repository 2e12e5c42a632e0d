"""Typed reading of the raw CSV tables and writing of the bronze layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish import fixed_values as fv
from tarnish.operators.reports import ingest_report, union_all
from tarnish.session import materialize

REJECTED = "_rejected"


def table_schema(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns)


def read_raw_csv(spark: SparkSession, path: str, columns: list[tuple[str, str]], line_breaks: bool,
                 rejects: bool = False, header: bool = True) -> DataFrame:
    """Declared types, no inference. A record that does not fit fails the read, or is kept as text in ``_rejected``.

    Only tables whose text may hold line breaks give up splitting their files.
    """
    schema = table_schema([*columns, (REJECTED, "string")] if rejects else columns)
    return (
        spark.read.schema(schema)
        .option("header", header).option("mode", "PERMISSIVE" if rejects else "FAILFAST").option("enforceSchema", rejects)
        .option("columnNameOfCorruptRecord", REJECTED)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("quote", '"').option("escape", '"').option("multiLine", line_breaks)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def read_raw_tables(spark: SparkSession, folder: str, prefix: str = "") -> dict[str, DataFrame]:
    """The nine raw tables; ``prefix`` is the export's file-name prefix. A missing file fails here."""
    tables = {}
    for file, name, columns, line_breaks in fv.RAW_TABLES:
        lead = "" if name == "category_translation" else prefix
        tables[name] = read_raw_csv(spark, f"{folder}/{lead}{file}", columns, line_breaks)
    return tables


class TooManyRejects(ValueError):
    """More records of a table were rejected than its limit allows."""


def ingest_csv(spark: SparkSession, path: str, name: str, columns: list[tuple[str, str]], line_breaks: bool, folder: str,
               limit: float = 0.0, header: bool = True) -> DataFrame:
    """Stores the records of a raw table that fit its types as bronze and the others, as they came, beside it in ``quarantine``.

    One scan of the files; the report has the exact counts. If more than ``limit`` of the records are rejected, the quarantine is
    written and the bronze table is left as it was. Returns (table_name, n_read, n_rejected, n_rows).
    """
    read = read_raw_csv(spark, path, columns, line_breaks, rejects=True, header=header)
    staged = materialize(read.withColumn("_file", F.col("_metadata.file_path")), f"ingest-{name}")
    report = staged.agg(F.count(F.lit(1)).alias("n_read"), F.count(REJECTED).alias("n_rejected")).select(
        F.lit(name).alias("table_name"), "n_read", "n_rejected", (F.col("n_read") - F.col("n_rejected")).alias("n_rows"))
    counts = report.first()
    staged.where(F.col(REJECTED).isNotNull()).select("_file", F.col(REJECTED).alias("record")).write.mode("overwrite").parquet(
        f"{folder}/quarantine/{name}")
    if counts["n_rejected"] > limit * counts["n_read"]:
        raise TooManyRejects(f"{name}: {counts['n_rejected']} of {counts['n_read']} records rejected, limit {limit}")
    staged.where(F.col(REJECTED).isNull()).select(*[c for c, _ in columns]).write.mode("overwrite").parquet(f"{folder}/{name}")
    return report


def ingest_raw_tables(spark: SparkSession, raw: str, folder: str, prefix: str = "", limit: float = 0.0) -> DataFrame:
    """All nine raw tables to bronze, with a row of the report for each and one for all."""
    reports = [ingest_csv(spark, f"{raw}/{'' if name == 'category_translation' else prefix}{file}", name, columns, line_breaks, folder, limit)
               for file, name, columns, line_breaks in fv.RAW_TABLES]
    tables = union_all(reports)
    total = tables.agg(*[F.sum(c).alias(c) for c in ("n_read", "n_rejected", "n_rows")])
    return tables.unionByName(total.withColumn("table_name", F.lit("TOTAL")))


def write_bronze(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Stores every table and reports rows and columns as stored."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return ingest_report(read_tables(next(iter(tables.values())).sparkSession, folder, list(tables)))


def read_tables(spark: SparkSession, folder: str, names: list[str], views: bool = False) -> dict[str, DataFrame]:
    """Named tables of a folder, on request also as SQL views."""
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables
