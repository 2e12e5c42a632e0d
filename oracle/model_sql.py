"""SQL of the preprocessing and text-feature queries."""

from oracle.base import sql
from tarnish.fixed_values import CATEGORICAL_COLS, T2_FEATURE_COLS, TEXT_COLS

NUMERIC = [c for c in T2_FEATURE_COLS if c not in CATEGORICAL_COLS and c not in TEXT_COLS]
FIT = "SELECT * FROM order_features WHERE split IN ('train', 'val') AND y_t2 IS NOT NULL"
SCALED = ["days_to_estimated", "purchase_hour", "max_installments"]


def terms(table, key, text):
    """(key, term, tf) of words and word pairs."""
    return {
        "words": f"""SELECT {key} AS k, regexp_extract_all(lower(strip_accents(coalesce({text}, ''))),
            '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {table}""",
        "counts": """SELECT k, term, count(*) AS tf FROM (
            SELECT k, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS term FROM words)
            GROUP BY 1, 2""",
        "vocab": f"""SELECT term, df, ln((1.0 + (SELECT count(*) FROM {table})) / (1 + df)) + 1 AS idf FROM (
            SELECT term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY 1) WHERE df >= 5
            ORDER BY total DESC, term LIMIT 5000""",
    }


def _levels():
    cats = [c for c in T2_FEATURE_COLS if c in CATEGORICAL_COLS]
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", coalesce({c}, '__missing__') AS level, count(*) AS n FROM fit GROUP BY ALL"
        for c in cats)
    return sql("""SELECT "column", level, n, CAST(CASE WHEN n >= 20
            THEN row_number() OVER (PARTITION BY "column", n >= 20 ORDER BY level) - 1
            ELSE count(*) FILTER (n >= 20) OVER (PARTITION BY "column") END AS INTEGER) AS slot FROM lv""",
               fit=FIT, lv=counts)


SQL = {
    "ml1_medians": sql(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median FROM fit" for c in NUMERIC),
        fit=FIT),
    "ml1_median_impute": sql("""SELECT order_id, round(coalesce(days_to_approved,
        (SELECT quantile_cont(days_to_approved, 0.5) FROM fit)), 6) AS days_to_approved FROM order_features""", fit=FIT),
    "ml2_constant_impute": sql("SELECT order_id, " + ", ".join(
        f"coalesce({c}, '__missing__') AS {c}" for c in CATEGORICAL_COLS) + " FROM order_features"),
    "ml3_standard_scale": sql("SELECT order_id, " + ", ".join(
        f"""round((coalesce({c}::DOUBLE, (SELECT m_{c} FROM med)) - (SELECT avg(coalesce({c}::DOUBLE,
            (SELECT m_{c} FROM med))) FROM fit)) / (SELECT stddev_pop(coalesce({c}::DOUBLE,
            (SELECT m_{c} FROM med))) FROM fit), 6) AS {c}""" for c in SCALED) + " FROM order_features",
        fit=FIT, med="SELECT " + ", ".join(f"quantile_cont({c}::DOUBLE, 0.5) AS m_{c}" for c in SCALED) + " FROM fit"),
    "ml4_level_slots": _levels(),
    "ml5_tfidf_reviews": sql("""SELECT k AS review_id, term,
        round(w / sqrt(sum(w * w) OVER (PARTITION BY k)), 6) AS weight
        FROM (SELECT k, term, (1 + ln(tf)) * idf AS w FROM counts JOIN vocab USING (term))""",
                             **terms("c_reviews", "review_id", "review_comment_message")),
    "ml5_vocabulary_documents": sql("SELECT term, df, round(idf, 6) AS idf FROM vocab",
                                    **terms("documents", "doc_id", "text")),
}
