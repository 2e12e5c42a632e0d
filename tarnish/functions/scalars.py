"""Column expressions of the feature layer; every one stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnish.fixed_values import CATEGORICAL_COLS, NON_FEATURE_COLS, T1_EXTRA_FEATURE_COLS, T2_FEATURE_COLS, TEXT_COLS

MONEY_SCALE = 10000
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def hour_of_day(ts: str) -> Column:
    return F.hour(ts).cast("bigint")


def day_of_week(ts: str) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(F.col(ts)).cast("bigint")


def month_of_year(ts: str) -> Column:
    return F.month(ts).cast("bigint")


def days_between(end: str, start: str) -> Column:
    """Fractional days from ``start`` to ``end``; NULL when either is NULL."""
    return F.expr(f"timestampdiff(MICROSECOND, `{start}`, `{end}`)") / F.lit(86400000000.0)


def box_volume(length: str, height: str, width: str) -> Column:
    return F.col(length).cast("double") * F.col(height).cast("double") * F.col(width).cast("double")


def freight_ratio(freight: Column, price: Column) -> Column:
    return freight / (price + F.lit(1e-6))


def money_units(amount: Column) -> Column:
    """Amount in ten-thousandths as a whole number, so sums do not depend on the order of addition."""
    return F.floor(amount * F.lit(float(MONEY_SCALE)) + F.lit(0.5)).cast("bigint")


def money(units: Column) -> Column:
    return units.cast("double") / F.lit(float(MONEY_SCALE))


def binary_label(value: Column, ones: list[int], zeros: list[int]) -> Column:
    return F.when(value.isin(ones), F.lit(1)).when(value.isin(zeros), F.lit(0))


def label_high_review(score: Column) -> Column:
    return binary_label(score, [4, 5], [1, 2])


def label_low_review(score: Column) -> Column:
    return binary_label(score, [1, 2], [4, 5])


def label_late(delivered: Column, estimated: Column) -> Column:
    return F.when(delivered.isNotNull() & estimated.isNotNull(), (delivered > estimated).cast("int"))


def temporal_split(ts: Column, train_end: str, val_end: str) -> Column:
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    return (
        F.when(ts.isNull(), F.lit("drop"))
        .when(ts < at(train_end), F.lit("train"))
        .when(ts < at(val_end), F.lit("val"))
        .otherwise(F.lit("test"))
    )


def lenient_number_sql(value: str) -> str:
    """SQL: text to double; anything that is not a plain number becomes NULL."""
    return f"if({value} rlike r'{NUMBER_PATTERN}', try_cast(trim({value}) as double), null)"


def lenient_number(value: str) -> Column:
    return F.expr(lenient_number_sql(f"cast({value} as string)"))


def number_sql(df: DataFrame, c: str) -> str:
    """SQL: a column of any type as double: numbers as they are, text leniently, mixed columns value by value."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.NumericType):
        return f"cast(`{c}` as double)"
    if isinstance(kind, T.VariantType):
        text = lenient_number_sql(f"try_cast(`{c}` as string)")
        return f"if(schema_of_variant(`{c}`) = 'STRING', {text}, try_cast(`{c}` as double))"
    return lenient_number_sql(f"cast(`{c}` as string)")


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def clip_text(value: Column, chars: int) -> Column:
    return F.when(F.length(value) > chars, F.concat(F.substring(value, 1, chars), F.lit("…"))).otherwise(value)


def at_threshold(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def positive_score(prediction: Column, confidence: Column) -> Column:
    """Confidence in the predicted class, turned into a score of class 1; 0.5 when there is no valid answer."""
    return (
        F.when(prediction == 1, confidence)
        .when(prediction == 0, F.lit(1.0) - confidence)
        .otherwise(F.lit(0.5))
    )


def valid_prediction(prediction: Column) -> Column:
    return F.coalesce(prediction.isin(0, 1), F.lit(False))


def align_columns(df: DataFrame, wanted: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """``keep`` plus exactly the wanted (name, type) columns: missing ones NULL, extra ones gone."""
    have = set(df.columns)
    return df.select(
        *keep,
        *[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in wanted],
    )


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NON_FEATURE_COLS and not c.startswith("_")]


def numeric_columns(df: DataFrame) -> list[str]:
    wanted = set(feature_columns(df))
    return [f.name for f in df.schema.fields if f.name in wanted and isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    wanted = set(feature_columns(df))
    return [f.name for f in df.schema.fields if f.name in wanted and isinstance(f.dataType, T.StringType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [c for c in string_columns(df) if c not in TEXT_COLS]


def task_features(task: str) -> list[str]:
    if task == "t1":
        return T2_FEATURE_COLS + T1_EXTRA_FEATURE_COLS
    if task == "t3":
        return T2_FEATURE_COLS + TEXT_COLS
    return list(T2_FEATURE_COLS)


def task_numeric(task: str) -> list[str]:
    return [c for c in task_features(task) if c not in CATEGORICAL_COLS and c not in TEXT_COLS]


def task_label(task: str) -> str:
    return {"t1": "y_t1", "t2": "y_t2", "t3": "y_t3"}[task]
