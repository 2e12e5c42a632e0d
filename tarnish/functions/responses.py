"""Strict reading of raw answers, as column expressions.

An answer must be a JSON object, bare, fenced, or the first flat ``{…}`` inside prose, with
a prediction of 0 or 1 and a confidence in [0, 1]. Values are coerced as the contract
allows: 1.9 and true read as 1, "1" reads as 1, "1.9" does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.fixed_values import RATIONALE_CHARS

FAIL_RATIONALE = "PARSE_FAIL: "


def unfenced(raw: Column) -> Column:
    text = F.trim(F.coalesce(raw, F.lit("")), F.lit(" \t\n\r\f\x0b"))
    bare = F.trim(F.regexp_replace(text, "(?m)^```[a-zA-Z]*\\n?|```$", ""), F.lit(" \t\n\r\f\x0b"))
    return F.when(text.startswith("```"), bare).otherwise(text)


def _field(v: Column, name: str) -> Column:
    return F.variant_get(v, f"$.{name}", "variant")


def _as_int(v: Column) -> Column:
    """Numbers are cut to whole ones, booleans are 0/1, text must spell a whole number."""
    kind = F.schema_of_variant(v)
    text = F.trim(v.try_cast("string"))
    return (
        F.when(kind == "BOOLEAN", v.try_cast("boolean").cast("int").cast("double"))
        .when(kind == "STRING", F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("double")))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), _cut(v.try_cast("double")))
    )


def _cut(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def _as_number(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    text = F.trim(v.try_cast("string"))
    return (
        F.when(kind == "BOOLEAN", v.try_cast("boolean").cast("int").cast("double"))
        .when(kind == "STRING", F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double")))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), v.try_cast("double"))
    )


def complete_json(text: Column) -> Column:
    """The JSON value that the whole text spells; NULL if anything stands before or after it.

    The parser itself reads one value and ignores the rest, so the text is read as the only item of a list and as the only
    value of an object: a bracket or brace that closes one of them early leaves the other one broken.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    alone = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when((F.size(items) == 1) & alone, F.get(items, F.lit(0)))


def _as_text(v: Column) -> Column:
    """Missing is empty; null and truth values are spelled as the contract's reader prints them."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(""))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(v.try_cast("string")))
        .otherwise(F.coalesce(v.try_cast("string"), F.to_json(v)))
    )


def parse_answer(df: DataFrame, raw: str) -> DataFrame:
    """Adds prediction (-1 when unusable), confidence, rationale, ok, error."""
    kept = df.columns
    text = df.select("*", unfenced(F.col(raw)).alias("_text"))
    # the first flat object is only looked for where the whole text is no answer
    part = complete_json(F.regexp_extract("_text", r"\{[^{}]*\}", 0))
    parsed = text.select(*kept, F.coalesce(complete_json(F.col("_text")), part).alias("_json"))
    read = parsed.select(
        *kept, "_json", F.schema_of_variant("_json").startswith("OBJECT").alias("_object"),
        _field(F.col("_json"), "prediction").alias("_p"), _field(F.col("_json"), "confidence").alias("_c"))
    values = read.select("*", _as_int(F.col("_p")).alias("_pi"), _as_number(F.col("_c")).alias("_cf"))
    error = (
        F.when(F.col("_json").isNull(), F.lit("no JSON object"))
        .when(~F.col("_object"), F.lit("not an object"))
        .when(F.col("_p").isNull() | F.col("_c").isNull(), F.lit("missing keys"))
        .when(F.col("_pi").isNull(), F.lit("prediction is not a number"))
        .when(F.col("_cf").isNull(), F.lit("confidence is not a number"))
        .when(~F.col("_pi").isin(0.0, 1.0), F.lit("prediction must be 0 or 1"))
        .when(~F.col("_cf").between(0.0, 1.0), F.lit("confidence out of [0,1]"))
    )
    rationale = F.when(F.col("_object"), _as_text(_field(F.col("_json"), "rationale")))
    checked = values.select("*", error.alias("error"))
    ok = F.col("error").isNull()
    return checked.select(
        *kept,
        F.when(ok, F.col("_pi").cast("int")).otherwise(F.lit(-1)).alias("prediction"),
        F.when(ok, F.col("_cf")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, F.substring(rationale, 1, RATIONALE_CHARS)).otherwise(F.lit("")).alias("rationale"),
        ok.alias("ok"), "error")
