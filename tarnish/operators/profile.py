"""Column profiles of a labelled slice, and their text form.

All numeric columns share one pass over an unpivoted slice, all categorical ones another;
quantiles are exact and split by range, levels are counted before anything is ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnish import fixed_values as fv
from tarnish.functions import scalars as S
from tarnish.functions.shapes import unpivot
from tarnish.operators.order_statistics import WAYS, exact_quantiles

QUANTILES = [0.1, 0.5, 0.9]


def numeric_profile(df: DataFrame, columns: list[str], label: str, approx: bool = False, ways: int = WAYS) -> DataFrame:
    """One row per column: n, miss, mean, std, p10/p50/p90, min, max, correlation with the label (0 if undefined)."""
    long = unpivot(df, columns, "double", keep={"y": label})
    x, y = F.col("value"), F.when(F.col("value").isNotNull(), F.col("y").cast("double"))
    basics = long.groupBy("column").agg(
        F.count("value").alias("n"),
        (1 - F.count("value") / F.count(F.lit(1))).alias("miss"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.coalesce(F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)), F.lit(0.0)).alias("corr"),
        *([F.percentile_approx("value", QUANTILES).alias("_q")] if approx else []),
    )
    if approx:
        names = zip(("p10", "p50", "p90"), range(3))
        return basics.select("*", *[F.col("_q")[i].alias(n) for n, i in names]).drop("_q")
    wide = exact_quantiles(long, ["column"], "value", QUANTILES, ways).groupBy("column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"p{round(100 * p)}") for p in QUANTILES])
    return basics.join(wide, "column", "left")


def categorical_profile(df: DataFrame, columns: list[str], label: str, max_levels: int = 3) -> DataFrame:
    """One row per column: n, miss, distinct levels, the most frequent ones, label share in the top one."""
    levels = unpivot(df, columns, "string", keep={"y": label}).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("prev"))
    present = F.col("value").isNotNull()
    totals = levels.groupBy("column").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("n"),
        (1 - F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)) / F.sum("n")).alias("miss"),
        F.count_if(present).alias("unique"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = levels.filter(present).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_levels)
    listed = top.groupBy("column").agg(
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "value", "n"))),
            lambda t: F.concat(t["value"], F.lit("="), t["n"].cast("string"))), ", ").alias("top"),
        F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("prev"))), F.lit(0.0)).alias("prev_y_top"))
    return totals.join(listed, "column", "left")


def top_levels(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent levels, ties by level."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


def profile_lines(df: DataFrame, task: str, features: list[str], label: str) -> list[str]:
    """The profile of the labelled training rows as text lines; at most one row per column is fetched."""
    train = df.filter((F.col("split") == "train") & F.col(label).isNotNull())
    strings = set(S.string_columns(df))
    numeric = [c for c in features if c not in strings and c in df.columns]
    textual = [c for c in features if c in strings]
    head = train.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("prev")).first()
    rows = {}
    if numeric:
        rows |= {r["column"]: r for r in numeric_profile(train, numeric, label).collect()}
    if textual:
        rows |= {r["column"]: r for r in categorical_profile(train, textual, label).collect()}
    lines = [fv.PROFILE_HEADER.format(task=task, n=head["n"], prev=head["prev"] or 0.0)]
    for c in features:
        if c not in rows:
            continue
        r = rows[c]
        kind = "categorical" if c in textual else "numeric"
        if r["n"] == 0:
            lines.append(f"{c}: {kind}  n=0  miss=100%  (empty)")
        elif kind == "numeric":
            lines.append(fv.NUMERIC_PROFILE_LINE.format(
                col=c, n=r["n"], miss=r["miss"], mean=r["mean"],
                std=float("nan") if r["std"] is None else r["std"],
                p10=r["p10"], p50=r["p50"], p90=r["p90"], mn=r["min"], mx=r["max"], corr=r["corr"]))
        else:
            lines.append(fv.CATEGORICAL_PROFILE_LINE.format(
                col=c, n=r["n"], miss=r["miss"], uniq=r["unique"], top=r["top"], py=r["prev_y_top"]))
    return lines


def get_or_make_profile(df: DataFrame, task: str, features: list[str], label: str, path: str,
                        rebuild: bool = False) -> str:
    """The stored profile text under ``path``, built and stored first when absent or on ``rebuild``."""
    spark = df.sparkSession
    if not rebuild:
        try:
            return spark.read.text(path, wholetext=True).first()["value"].removesuffix("\n")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    text = "\n".join(profile_lines(df, task, features, label))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text
