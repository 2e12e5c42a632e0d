"""Nine families of seeded, severity-controlled corruption, as DataFrame transforms.

Row-local families are one ``select`` over the feature columns. Labels, split and key are
never touched. Severity and seed may be columns, so one plan can corrupt the same rows for
many (family, severity, seed) cells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnish import fixed_values as fv
from tarnish.functions import scalars as S
from tarnish.functions.keyed_hash import hit, pick, row_hash
from tarnish.functions.shapes import unpivot
from tarnish.operators.dense_index import dense_index, sorted_index
from tarnish.session import materialize

KEY = "order_id"
SWAP = "label_noise_categorical"


# ---- column expressions as SQL text, shared by the single-cell and the many-cell form ----
# ``h`` names the column of the row hash; ``severity`` is a number or names a column.

def missing_value(c: str, h: str, severity) -> str:
    return f"if({hit(h, 'missing_injection', c, severity)}, null, `{c}`)"


def times_hundred(c: str, h: str, severity) -> str:
    x = f"cast(`{c}` as double)"
    return f"if({hit(h, 'currency_unit_drift', c, severity)}, {x} * 100.0D, {x})"


def shifted_hour(c: str, h: str, severity) -> str:
    hour, shift = f"cast(`{c}` as bigint)", f"if({pick(h, 'timezone_collapse', c, 2)} = 0, -3L, 3L)"
    return f"if({hit(h, 'timezone_collapse', c, severity)}, pmod({hour} + {shift}, 24L), {hour})"


def shifted_days(c: str, h: str, severity) -> str:
    x, shift = f"cast(`{c}` as double)", f"if({pick(h, 'timezone_collapse', c, 2)} = 0, -0.125D, 0.125D)"
    return f"if({hit(h, 'timezone_collapse', c, severity)}, {x} + {shift}, {x})"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def drifted_category(c: str, h: str, severity) -> str:
    labels = ", ".join(
        f"{_text(label)}, array({', '.join(map(_text, names))})" for label, names in fv.TAXONOMY_VARIANTS.items())
    variants = f"element_at(map({labels}), `{c}`)"
    variant = f"element_at({variants}, cast({pick(h, 'category_taxonomy_drift', c, 3)} + 1 as int))"
    other = f"if(contains(`{c}`, 'a'), regexp_replace(`{c}`, '^([^a]*)a', '$1á'), concat(`{c}`, '_drift'))"
    return f"if({hit(h, 'category_taxonomy_drift', c, severity)}, coalesce({variant}, {other}), `{c}`)"


def misread_text(c: str, h: str, severity) -> str:
    garbled = f"decode(encode(`{c}`, 'UTF-8'), 'ISO-8859-1')"
    return f"if({hit(h, 'mojibake_roundtrip', c, severity)}, {garbled}, `{c}`)"


def flipped_value(c: str, h: str, severity) -> str:
    """Variant: text for hit values, the number itself otherwise."""
    text = f"cast(cast(`{c}` as string) as variant)"
    return f"if({hit(h, 'type_flip', c, severity)}, {text}, cast(`{c}` as variant))"


def is_flipped(c: str, h: str, severity) -> str:
    return f"({hit(h, 'type_flip', c, severity)} and `{c}` is not null)"


# ---- families ----

def _replace(df: DataFrame, seed, key: str | list[str], columns: list[str], make: Callable, severity) -> DataFrame:
    """Replace ``columns`` in one select over a row hash computed once."""
    todo = set(columns)
    keys = [key] if isinstance(key, str) else key
    hashed = df.select("*", row_hash(seed, *[F.col(k) for k in keys]).alias("_h"))
    severity = float(severity)
    return hashed.selectExpr(*[f"{make(c, '_h', severity)} as `{c}`" if c in todo else f"`{c}`" for c in df.columns])


def missing_injection(df, severity, seed, key=KEY):
    return _replace(df, seed, key, S.feature_columns(df), missing_value, severity)


def type_flip(df, severity, seed, key=KEY):
    return _replace(df, seed, key, S.numeric_columns(df), flipped_value, severity)


def currency_unit_drift(df, severity, seed, key=KEY):
    numeric = set(S.numeric_columns(df))
    return _replace(df, seed, key, [c for c in fv.MONETARY_COLS if c in numeric], times_hundred, severity)


def timezone_collapse(df, severity, seed, key=KEY):
    numeric = set(S.numeric_columns(df))
    make = lambda c, h, s: shifted_hour(c, h, s) if c == "purchase_hour" else shifted_days(c, h, s)
    return _replace(df, seed, key, [c for c in ["purchase_hour", *fv.TIME_DAY_COLS] if c in numeric], make, severity)


def category_taxonomy_drift(df, severity, seed, key=KEY):
    return _replace(df, seed, key, [c for c in fv.TAXONOMY_COLS if c in df.columns], drifted_category, severity)


def mojibake_roundtrip(df, severity, seed, key=KEY):
    columns = [c for c in [*fv.TEXT_COLS, *fv.TAXONOMY_COLS] if c in df.columns]
    return _replace(df, seed, key, columns, misread_text, severity)


def level_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null (column, level) pairs of the named columns, from one pass."""
    return unpivot(df, columns, "string").filter("value is not null").select(
        "column", F.col("value").alias("level")).distinct()


@dataclass
class Levels:
    """The levels of some columns in ascending order: rows (column, at, level, following), and how many each column has."""

    rows: DataFrame
    n: dict[str, int]


def indexed_levels(df: DataFrame, columns: list[str]) -> Levels:
    """Levels of ``df`` numbered by sorting in ranges; they stay a table, however many they are.

    One position and one count per column reach the driver.
    """
    found = sorted_index(level_table(df, columns), ["column", "level"], "level-order")
    firsts = {r["column"]: (r["first"], r["n"]) for r in found.groupBy("column").agg(
        F.min("_idx").alias("first"), F.count(F.lit(1)).alias("n")).collect()}
    n = {c: firsts.get(c, (0, 0))[1] for c in columns}
    bounds = " ".join(f"when '{c}' then {first}L" for c, (first, _) in firsts.items())
    sizes = " ".join(f"when '{c}' then {size}L" for c, (_, size) in firsts.items())
    if not firsts:
        return Levels(found.selectExpr("`column`", "_idx as at", "level", "level as following"), n)
    placed = found.selectExpr("`column`", f"_idx - case `column` {bounds} end as at", "level")
    before = placed.selectExpr("`column`", f"pmod(at - 1, case `column` {sizes} end) as at", "level as following")
    return Levels(materialize(placed.join(before, ["column", "at"]), "levels"), n)


def swapped_level(c: str, h: str, severity, levels: list[str]) -> str:
    """A uniformly drawn level; the next one (cyclic) when the draw equals the value. NULLs are filled too."""
    n = len(levels)
    if n < 2:
        return f"`{c}`"
    array, at = f"array({', '.join(map(_text, levels))})", pick(h, SWAP, c, n)
    drawn = f"element_at({array}, cast({at} + 1 as int))"
    following = f"element_at({array}, cast(({at} + 1) % {n} + 1 as int))"
    changed = f"if({drawn} <=> `{c}`, {following}, {drawn})"
    return f"if({hit(h, SWAP, c, severity)}, {changed}, `{c}`)"


def swap_levels(df: DataFrame, columns: list[str], levels: Levels, severity, h: str = "_h", only: str = "true") -> DataFrame:
    """``swapped_level`` against a table of levels, for the rows that satisfy ``only``.

    A hit row joins the level at its drawn place. Rows that are not hit carry spread-out negative
    places, so no join key is hot; Spark broadcasts the levels when their files are small.
    """
    for c in columns:
        n = levels.n.get(c, 0)
        if n < 2:
            continue
        at = f"if({only} and {hit(h, SWAP, c, severity)}, {pick(h, SWAP, c, n)}, -1L - {h}) as _at"
        mine = levels.rows.where(F.col("column") == c).selectExpr("at as _at", "level as _level", "following as _next")
        value = f"case when _level is null then `{c}` when _level <=> `{c}` then _next else _level end as `{c}`"
        df = df.selectExpr("*", at).join(mine, "_at", "left").selectExpr(
            *[value if x == c else f"`{x}`" for x in df.columns])
    return df


def label_noise_categorical(df, severity, seed, key=KEY, levels: Levels | dict[str, list[str]] | None = None):
    """``levels`` fixes the levels, as a table or (as a stream needs) as sorted lists; else they are read from ``df``.

    Both forms give the same values for the same levels.
    """
    columns = S.categorical_columns(df)
    if not columns:
        return df
    if isinstance(levels, dict):
        return _replace(df, seed, key, columns, lambda c, h, s: swapped_level(c, h, s, sorted(levels[c])), severity)
    levels = indexed_levels(df, columns) if levels is None else levels
    keys = [key] if isinstance(key, str) else key
    hashed = df.select("*", row_hash(seed, *[F.col(k) for k in keys]).alias("_h"))
    return swap_levels(hashed, columns, levels, float(severity)).select(*df.columns)


def round_half_even(x: float) -> int:
    return int(round(x))


def duplicate_draws(n: int, k: int, seed: int, spark) -> DataFrame:
    """k draws with replacement from 0 … n-1, one row each; generated in parallel."""
    draws = spark.range(k).select(F.col("id").alias("_copy_no"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("dup"), F.col("_copy_no").cast("string")))
    return draws.select(
        (F.col("_copy_no") + 1).alias("_copy_no"),
        (F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(n)).alias("_idx"))


def row_digest(df: DataFrame) -> Column:
    """128 bits of hash of all values of a row and of which of them are null: equal for equal rows."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    values = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields]
    cells = [F.array(*[F.col(f"`{c}`").isNull() for c in df.columns]), *values]
    return F.concat_ws("-", F.hex(F.xxhash64(*cells)), F.hex(F.xxhash64(F.lit(1), *cells)))


def duplicate_rows(df, severity, seed, key=KEY, copy_column: str | None = None, digest: str | None = None):
    """Appends exactly round(severity · n) rows drawn with replacement, on any frame.

    Only keys are numbered and drawn; the wide rows move once, to meet the drawn keys. Keys may repeat: rows are then
    told apart by a digest of their values, and equal rows, which no draw can tell apart, are numbered by their count.
    ``copy_column`` names an optional column that is 0 for originals and tells copies apart. ``digest`` names a column that already
    holds the digest, on a frame that has only some columns of its rows: the same rows are drawn as from the whole ones.
    """
    numbered = [F.lit(0).cast("bigint").alias(copy_column)] if copy_column else []
    originals = df.select("*", *numbered)
    if severity <= 0:
        return originals
    digested = df.withColumn("_row", F.col(digest) if digest else row_digest(df))
    distinct = digested.groupBy(key, "_row").agg(F.count(F.lit(1)).alias("_count"))
    index = dense_index(distinct, key, tie="_row", weight="_count")
    k = round_half_even(severity * index.n)
    if k == 0:
        return originals
    places = index.rows.select(key, "_row", F.explode(F.sequence("_idx", F.col("_idx") + F.col("_count") - 1)).alias("_idx"))
    drawn = duplicate_draws(index.n, k, seed, df.sparkSession).join(places, "_idx").select(
        F.col(key).alias("_key"), F.col("_row").alias("_drawn"), "_copy_no")
    one_each = digested if index.largest <= 1 else digested.dropDuplicates([key, "_row"])
    # keys may be NULL
    copies = one_each.join(drawn, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_row") == F.col("_drawn"))).select(
        *df.columns, *([F.col("_copy_no").alias(copy_column)] if copy_column else []))
    return originals.unionByName(copies)


def drifted_names(features: list[str], severity: float, seed: int) -> dict[str, str]:
    """The round(severity · #features) renamed columns, ranked by a hash of (seed, name)."""
    m = round_half_even(severity * len(features))
    ranked = sorted(features, key=lambda c: (hashlib.md5(f"{seed}|schema_drift|{c}".encode()).hexdigest(), c))
    return {c: f"col_{seed}_{i:03d}" for i, c in enumerate(ranked[:m])}


def schema_drift(df, severity, seed, key=KEY):
    return df.withColumnsRenamed(drifted_names(S.feature_columns(df), severity, seed))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "missing_injection": missing_injection,
    "type_flip": type_flip,
    "label_noise_categorical": label_noise_categorical,
    "duplicate_rows": duplicate_rows,
    "schema_drift": schema_drift,
    "currency_unit_drift": currency_unit_drift,
    "timezone_collapse": timezone_collapse,
    "category_taxonomy_drift": category_taxonomy_drift,
    "mojibake_roundtrip": mojibake_roundtrip,
}


def list_families() -> list[str]:
    return list(REGISTRY)


def apply_clean(df: DataFrame) -> DataFrame:
    return df


def apply(df: DataFrame, family: str, severity: float, seed: int, **options) -> DataFrame:
    if family == "clean":
        return apply_clean(df)
    if family not in REGISTRY:
        raise KeyError(f"unknown corruption family {family!r}; known: {list_families()}")
    if not 0.0 <= severity <= 1.0:
        raise ValueError(f"severity must lie in [0, 1], not {severity}")
    return REGISTRY[family](df, severity, seed, **options)


# ---- many cells in one plan ----

def corrupt_cells(df: DataFrame, features: list[str], key: str = KEY,
                  levels: Levels | None = None) -> DataFrame:
    """Corrupt rows that already carry their cell as columns family, severity, seed, drifted.

    ``drifted`` names the columns a schema_drift cell hides. Duplicated rows do not occur
    here, as they never enter a paired sample. Level swaps need ``levels`` of the full
    frame; such a cell without them is an error. ``_flipped`` lists the columns whose value arrives as text.
    """
    numeric, h, severity = set(S.numeric_columns(df)), "_h", "severity"
    swapped = [c for c in S.categorical_columns(df) if c in features]

    def cell_value(c: str) -> str:
        cases = {"missing_injection": missing_value(c, h, severity),
                 "schema_drift": f"if(array_contains(drifted, '{c}'), null, `{c}`)"}
        if c in fv.MONETARY_COLS and c in numeric:
            cases["currency_unit_drift"] = times_hundred(c, h, severity)
        if c in numeric and c == "purchase_hour":
            cases["timezone_collapse"] = shifted_hour(c, h, severity)
        elif c in numeric and c in fv.TIME_DAY_COLS:
            cases["timezone_collapse"] = shifted_days(c, h, severity)
        if c in fv.TAXONOMY_COLS:
            cases["category_taxonomy_drift"] = drifted_category(c, h, severity)
        if c in fv.TAXONOMY_COLS or c in fv.TEXT_COLS:
            cases["mojibake_roundtrip"] = misread_text(c, h, severity)
        if c in swapped and levels is None:
            cases[SWAP] = "raise_error('level swaps need the levels of the full frame')"
        whens = " ".join(f"when '{family}' then {value}" for family, value in cases.items())
        return f"case family {whens} else `{c}` end as `{c}`"

    todo = set(features)
    flips = ", ".join(f"if({is_flipped(c, h, severity)}, '{c}', null)" for c in features if c in numeric)
    flipped = f"if(family = 'type_flip', array_compact(array({flips})), cast(array() as array<string>)) as _flipped"
    hashed = df.select("*", row_hash(F.col("seed"), F.col(key)).alias("_h"))
    changed = hashed.selectExpr(*[cell_value(c) if c in todo else f"`{c}`" for c in df.columns], flipped, h)
    if levels is not None:
        changed = swap_levels(changed, swapped, levels, severity, h, f"family = '{SWAP}'")
    return changed.drop(h)
