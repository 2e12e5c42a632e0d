"""Prompt text per row, as column expressions.

The row block follows the text form of a Python JSON dump: ", " and ": " as separators,
non-ASCII kept, floats in their shortest decimal form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnish import fixed_values as fv
from tarnish.functions import scalars as S


def float_text(x: str) -> str:
    """SQL: a double as Python prints it: plain digits between 1e-4 and 1e16, else a two-digit exponent."""
    java = f"cast({x} as string)"
    plain = f"regexp_replace(cast(cast({java} as decimal(38, 20)) as string), r'(\\.\\d+?)0+$', '$1')"
    scientific = (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({java}, r'\\.0E', 'E'), "
                  f"r'E(\\d)', 'e+$1'), 'E-', 'e-'), r'e([+-])(\\d)$', 'e$10$2')")
    return (f"case when {x} = 0 or abs({x}) >= 1e-3D and abs({x}) < 1e7D then {java} "
            f"when abs({x}) >= 1e-4D and abs({x}) < 1e16D then {plain} else {scientific} end")


def json_value(c: str, kind: T.DataType, may_flip: bool = False) -> str:
    """SQL: the JSON text of one value: null for NULL and "", numbers bare unless they arrive as text."""
    if isinstance(kind, T.StringType):
        n = fv.PROMPT_TEXT_CHARS
        clipped = f"if(length(`{c}`) > {n}, concat(substring(`{c}`, 1, {n}), '…'), `{c}`)"
        return f"coalesce(to_json(cast(nullif({clipped}, '') as variant)), 'null')"
    number = float_text(f"`{c}`") if isinstance(kind, T.DoubleType) else f"cast(`{c}` as string)"
    if may_flip:
        number = f"if(array_contains(_flipped, '{c}'), concat('\"', {number}, '\"'), {number})"
    return f"coalesce({number}, 'null')"


def row_json(df: DataFrame, features: list[str]) -> Column:
    """One JSON object in feature order; a feature the frame lacks reads null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for i, c in enumerate(features):
        value = json_value(c, kinds[c], "_flipped" in kinds) if c in kinds else "'null'"
        parts += ["'" + ("{" if i == 0 else ", ") + f"\"{c}\": '", value]
    return F.expr(f"concat({', '.join(parts)}, '}}')")


def task_block(task: str) -> str:
    name, goal, label = fv.TASK_TEXTS[task]
    return f"TASK: {name}\nGOAL: {goal}\nLABEL: {label}\n"


def schema_block(features: list[str]) -> str:
    described = [f"- {c}: {fv.COLUMN_DESCRIPTIONS.get(c, fv.NO_DESCRIPTION)}" for c in features]
    return "\n".join(["COLUMNS:", *described])


def prompt(df: DataFrame, task: str, profile: str) -> Column:
    """The user message: everything but the row is the same text for all rows of a task."""
    features = S.task_features(task)
    head = "\n\n".join([task_block(task), schema_block(features),
                        "TRAINING-SET PROFILE (compact summary):\n" + profile, "ROW:\n"])
    return F.concat(F.lit(head), row_json(df, features), F.lit("\n\n" + fv.OUTPUT_CONTRACT))


def messages(user: Column) -> Column:
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(say("system", F.lit(fv.SYSTEM_MESSAGE)), say("user", user))
