"""SQL of the corruption families and the samples."""

from oracle.base import quoted, sql
from tarnish.fixed_values import (CATEGORICAL_COLS, FAMILIES, MONETARY_COLS, SEEDS, T1_EXTRA_FEATURE_COLS,
                                  T2_FEATURE_COLS, TAXONOMY_VARIANTS, TEXT_COLS, TIME_DAY_COLS)
from tarnish.functions.keyed_hash import affine_constants
from tarnish.operators.corruption import drifted_names

FEATURES = T2_FEATURE_COLS + T1_EXTRA_FEATURE_COLS + TEXT_COLS
NUMERIC = [c for c in FEATURES if c not in CATEGORICAL_COLS and c not in TEXT_COLS]
ALL = ["order_id", "split", "y_t1", "y_t2", "y_t3", *FEATURES]
P = 2147483647
SEVERITY, SEED = 0.20, 42


def hash_of(seed, key="order_id"):
    return f"(('0x' || substr(md5(concat_ws('|', {seed}, CAST({key} AS VARCHAR))), 1, 8))::BIGINT % {P})"


def mixed(family, column, salt, h="h"):
    a, b = affine_constants(family, column, salt)
    return f"(({h} * {a} + {b}) % {P})"


def hit(family, column, severity=SEVERITY, h="h"):
    return f"{mixed(family, column, 'hit', h)} / {P}.0::DOUBLE < {severity}"


def pick(family, column, n, h="h"):
    return f"({mixed(family, column, 'pick', h)} % {n})"


HASHED = f"SELECT *, {hash_of(SEED)} AS h FROM order_features"


def missing(c, s=SEVERITY):
    return f"CASE WHEN {hit('missing_injection', c, s)} THEN NULL ELSE {c} END"


def currency(c, s=SEVERITY):
    return f"CASE WHEN {hit('currency_unit_drift', c, s)} THEN {c} * 100.0 ELSE {c} END"


def hour(c, s=SEVERITY):
    shift = f"CASE WHEN {pick('timezone_collapse', c, 2)} = 0 THEN -3 ELSE 3 END"
    return f"CASE WHEN {hit('timezone_collapse', c, s)} THEN (({c} + {shift}) % 24 + 24) % 24 ELSE {c} END"


def days(c, s=SEVERITY):
    shift = f"CASE WHEN {pick('timezone_collapse', c, 2)} = 0 THEN -0.125::DOUBLE ELSE 0.125::DOUBLE END"
    return f"CASE WHEN {hit('timezone_collapse', c, s)} THEN {c} + {shift} ELSE {c} END"


def taxonomy(c, s=SEVERITY):
    keys = "[" + ", ".join(quoted(k) for k in TAXONOMY_VARIANTS) + "]"
    flat = "[" + ", ".join("[" + ", ".join(quoted(x) for x in v) + "]" for v in TAXONOMY_VARIANTS.values()) + "]"
    return f"""CASE WHEN NOT ({hit('category_taxonomy_drift', c, s)}) OR {c} IS NULL THEN {c}
        WHEN list_contains({keys}, {c})
        THEN ({flat})[list_position({keys}, {c})][{pick('category_taxonomy_drift', c, 3)} + 1]
        WHEN contains({c}, 'a') THEN regexp_replace({c}, 'a', 'á') ELSE {c} || '_drift' END"""


def misread(c):
    """Each byte of the UTF-8 form as one character."""
    return (f"(SELECT string_agg(chr(('0x' || substr(hx, 2 * i - 1, 2))::INTEGER), '' ORDER BY i) "
            f"FROM (SELECT hex(encode({c})) AS hx), range(1, octet_length(encode({c})) + 1) t(i))")


def mojibake(c, s=SEVERITY):
    return (f"CASE WHEN {hit('mojibake_roundtrip', c, s)} AND {c} IS NOT NULL "
            f"THEN coalesce({misread(c)}, '') ELSE {c} END")


def frame(changed, hashed=HASHED, columns=ALL):
    body = ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in columns)
    return sql(f"SELECT {body} FROM cf", cf=hashed)


def _noise(columns_out):
    """Levels sorted per column; draw by index, the next one on a collision."""
    changed = {}
    for c in CATEGORICAL_COLS:
        n = f"(SELECT len(l) FROM lv_{c})"
        at = pick("label_noise_categorical", c, n)
        lv = f"(SELECT l FROM lv_{c})"
        changed[c] = (f"CASE WHEN {hit('label_noise_categorical', c)} AND {n} >= 2 THEN "
                      f"CASE WHEN {lv}[{at} + 1] IS NOT DISTINCT FROM {c} THEN {lv}[({at} + 1) % {n} + 1] "
                      f"ELSE {lv}[{at} + 1] END ELSE {c} END")
    extra = {f"lv_{c}": f"SELECT list(DISTINCT {c} ORDER BY {c}) FILTER ({c} IS NOT NULL) AS l FROM order_features"
             for c in CATEGORICAL_COLS}
    body = ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in columns_out)
    return sql(f"SELECT {body} FROM cf", **extra, cf=HASHED)


def _flip():
    values = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)
    flags = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {hit('type_flip', c)} END AS {c}_is_text" for c in NUMERIC)
    return sql(f"SELECT order_id, {values}, {flags} FROM cf", cf=HASHED)


COPIES = {
    "n_rows": "SELECT count(*) AS n, CAST(round_even(0.2 * count(*), 0) AS BIGINT) AS k FROM order_features",
    "idx": f"""SELECT *, row_number() OVER (ORDER BY {hash_of("'0'")} % 4096, order_id) - 1 AS idx FROM order_features""",
    "draws": f"""SELECT i + 1 AS copy_no,
        ('0x' || substr(md5('{SEED}|dup|' || CAST(i AS VARCHAR)), 1, 15))::BIGINT % (SELECT n FROM n_rows) AS idx
        FROM range((SELECT k FROM n_rows)) t(i)""",
}


def _copies():
    columns = ", ".join(["order_id", "split", *T2_FEATURE_COLS])
    return sql(f"""SELECT 0::BIGINT AS copy_no, {columns} FROM order_features
        UNION ALL SELECT copy_no, {columns} FROM draws JOIN idx USING (idx)""", **COPIES)


def _dispatch():
    rows = [f"SELECT '{f}' AS family, count(*) AS n_rows, count(y_t2) AS n_labelled FROM order_features"
            for f in ["clean", *FAMILIES] if f != "duplicate_rows"]
    rows.append("""SELECT 'duplicate_rows', count(*), count(y_t2) FROM (SELECT y_t2 FROM order_features
        UNION ALL SELECT y_t2 FROM draws JOIN idx USING (idx))""")
    return sql(" UNION ALL ".join(rows), **COPIES)


def _audit():
    def summed(parts):
        return " + ".join(f"count_if({p})" for p in parts)

    plain = {
        "missing_injection": {c: missing(c) for c in FEATURES},
        "currency_unit_drift": {c: currency(c) for c in MONETARY_COLS},
        "timezone_collapse": {"purchase_hour": hour("purchase_hour"), **{c: days(c) for c in TIME_DAY_COLS}},
        "category_taxonomy_drift": {"dominant_category": taxonomy("dominant_category")},
        "mojibake_roundtrip": {c: mojibake(c) for c in [*TEXT_COLS, "dominant_category"]},
    }
    rows, extra = [], {"cf": HASHED}
    for f, changed in plain.items():
        extra[f"a_{f}"] = "SELECT " + ", ".join(
            f"{c} AS b_{c}, {changed.get(c, c)} AS {c}" for c in FEATURES) + " FROM cf"
        rows.append(f"""SELECT '{f}' AS family, count(*) AS n_rows, 33::BIGINT AS n_cols,
            {summed(f'{c} IS NULL' for c in FEATURES)} AS null_cells,
            {summed(f'{c} IS DISTINCT FROM b_{c}' for c in FEATURES)} AS changed_cells FROM a_{f}""")
    nulls = summed(f"{c} IS NULL" for c in FEATURES)
    rows.append(f"""SELECT 'type_flip', count(*), 33, {nulls},
        {summed(f'{c} IS NOT NULL AND {hit("type_flip", c)}' for c in NUMERIC)} FROM cf""")
    gone = set(drifted_names(FEATURES, SEVERITY, SEED))
    rows.append(f"""SELECT 'schema_drift', count(*), 33,
        {summed('TRUE' if c in gone else f'{c} IS NULL' for c in FEATURES)},
        {summed(f'{c} IS NOT NULL' if c in gone else 'FALSE' for c in FEATURES)} FROM cf""")
    rows.append(f"""SELECT 'duplicate_rows', count(*), 33, {nulls}, 0 FROM (SELECT * FROM order_features
        UNION ALL SELECT {', '.join(ALL)} FROM draws JOIN idx USING (idx))""")
    noise = {}
    for c in CATEGORICAL_COLS:
        extra[f"lv_{c}"] = f"SELECT list(DISTINCT {c} ORDER BY {c}) FILTER ({c} IS NOT NULL) AS l FROM order_features"
        noise[c] = f"{hit('label_noise_categorical', c)} AND (SELECT len(l) FROM lv_{c}) >= 2"
    rows.append(f"""SELECT 'label_noise_categorical', count(*), 33,
        {summed(f'{c} IS NULL AND NOT ({noise[c]})' if c in noise else f'{c} IS NULL' for c in FEATURES)},
        {summed(noise.values())} FROM cf""")
    return sql(" UNION ALL ".join(rows), **extra, **COPIES)


def drawn(label, seeds, quota_pos, quota_neg, split="test"):
    """Sampled rows per seed: lowest (hash, key) first, by class."""
    return " UNION ALL ".join(f"""
        SELECT order_id, {label}, {s}::INTEGER AS seed FROM (
            SELECT order_id, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {hash_of(s)}, order_id) AS rn,
                   count(*) FILTER ({label} = 1) OVER () AS p, count(*) FILTER ({label} = 0) OVER () AS q
            FROM order_features WHERE split = '{split}' AND {label} IS NOT NULL)
        WHERE rn <= CASE {label} WHEN 1 THEN {quota_pos} ELSE {quota_neg} END""" for s in seeds)


SQL = {
    "c1_missing_injection": frame({c: missing(c) for c in FEATURES}),
    "c2_type_flip": _flip(),
    "c3_label_noise_categorical": _noise(ALL),
    "c3_label_noise_many_levels": _noise(["order_id", *CATEGORICAL_COLS]),
    "c4_duplicate_rows": _copies(),
    "c4_duplicate_rows_twice": sql("""SELECT n1 + CAST(round_even(0.5 * n1, 0) AS BIGINT) AS n_rows, n_splits FROM (
        SELECT n + CAST(round_even(0.5 * n, 0) AS BIGINT) AS n1, n_splits FROM (
            SELECT count(*) AS n, count(DISTINCT split) AS n_splits FROM order_features))"""),
    "c5_schema_drift": sql("SELECT " + ", ".join(
        f"{c} AS {drifted_names(FEATURES, SEVERITY, SEED).get(c, c)}" for c in ALL) + " FROM order_features"),
    "c6_currency_unit_drift": frame({c: currency(c) for c in MONETARY_COLS}),
    "c7_timezone_collapse": frame({"purchase_hour": hour("purchase_hour"), **{c: days(c) for c in TIME_DAY_COLS}}),
    "c8_category_taxonomy_drift": frame({"dominant_category": taxonomy("dominant_category")}),
    "c9_mojibake_roundtrip": frame({c: mojibake(c) for c in [*TEXT_COLS, "dominant_category"]}),
    "c10_c11_dispatch": _dispatch(),
    "a21_corruption_audit": _audit(),
    "w3_strict_sample": sql(drawn("y_t2", SEEDS, "100", "100")),
    "w4_capped_sample": sql(drawn("y_t3", SEEDS, "least(500, p)", "least(1000 - least(500, p), q)")),
    "w4_pool_sample": sql("SELECT order_id, y_t2, 13::INTEGER AS seed FROM order_features "
                          "WHERE split = 'test' AND y_t2 IS NOT NULL"),
    "w5_seeded_shuffle": sql("SELECT order_id, y_t2 FROM order_features WHERE split = 'test'"),
    "w6_simple_sample": sql(f"""SELECT {', '.join(['order_id', 'split', *T2_FEATURE_COLS])} FROM order_features
        ORDER BY {hash_of("'0'")}, order_id LIMIT 1000"""),
}

# a stream that is stopped and resumed gives what the batch gives
SQL |= {
    "c1_streamed": SQL["c1_missing_injection"],
    "c2_streamed": SQL["c2_type_flip"],
    "c6_streamed": SQL["c6_currency_unit_drift"],
    "c7_streamed": SQL["c7_timezone_collapse"],
    "c8_streamed": SQL["c8_category_taxonomy_drift"],
    "c9_streamed": SQL["c9_mojibake_roundtrip"],
    "c4_copies_undone": "SELECT * FROM events WHERE ts IS NOT NULL",
}
