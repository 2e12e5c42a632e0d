"""Reshaping many columns with one expression."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unpivot(df: DataFrame, columns: list[str], kind: str, keep: dict[str, str] | None = None,
            values: dict[str, str] | None = None) -> DataFrame:
    """(kept…, column, value): one row per row and column, every value cast to ``kind``.

    ``keep`` names kept SQL expressions; ``values`` gives a SQL expression for a column instead of its cast.
    """
    values = values or {}
    cells = ", ".join(
        f"struct('{c}' as column, {values.get(c, f'cast(`{c}` as {kind})')} as value)" for c in columns)
    kept = [f"{e} as `{name}`" for name, e in (keep or {}).items()]
    return df.selectExpr(*kept, f"inline(array({cells}))")
