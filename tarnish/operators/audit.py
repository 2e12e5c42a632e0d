"""Before/after report of a corruption: rows, columns, nulls and changed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnish.operators import corruption as C
from tarnish.operators.reports import union_all


def _changed(c: str, kind: T.DataType | None) -> str:
    """Whether a cell differs from the value kept beside it; a flipped number differs by being text."""
    if kind is None:
        return f"`_b_{c}` is not null"
    if isinstance(kind, T.VariantType):
        return f"coalesce(schema_of_variant(`{c}`) = 'STRING', `_b_{c}` is not null)"
    return f"not (`{c}` <=> `_b_{c}`)"


def audit(df: DataFrame, families: list[str], severity: float, seed: int, features: list[str]) -> DataFrame:
    """One row per family: row count, columns, null cells and cells that differ from before.

    The values before travel beside the row under names no family touches, so before and
    after meet without a join. A copied row has the cells of its row: these are counted before
    rows are copied, so only keys, digests and counts move.
    """
    wide = df.selectExpr("*", *[f"`{c}` as `_b_{c}`" for c in features])
    reports = []
    for family in families:
        copies = family == "duplicate_rows"
        out = wide if copies else C.apply(wide, family, severity, seed)
        kinds = {f.name: f.dataType for f in out.schema.fields}
        nulls = [f"int(`{c}` is null)" if c in kinds else "1" for c in features]
        changes = [f"int({_changed(c, kinds.get(c))})" for c in features]
        counts = [F.expr(" + ".join(nulls)).alias("nulls"), F.expr(" + ".join(changes)).alias("changed")]
        if copies:
            per_row = C.apply(wide.select(C.KEY, C.row_digest(wide).alias("_digest"), *counts), family, severity, seed, digest="_digest")
        else:
            per_row = out.select(*counts)
        reports.append(per_row.agg(
            F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_cells"),
            F.coalesce(F.sum("changed"), F.lit(0)).alias("changed_cells"),
        ).select(
            F.lit(family).alias("family"), "n_rows",
            F.lit(len([c for c in out.columns if not c.startswith("_")])).cast("bigint").alias("n_cols"),
            "null_cells", "changed_cells"))
    return union_all(reports)
