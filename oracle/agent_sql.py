"""SQL of prompts, answers, call logs, stores."""

from oracle.base import quoted, sql
from oracle.feature_sql import SQL as FEATURE_SQL
from oracle.sweep_sql import EXISTING, SQL as SWEEP_SQL, TRAIN, area, cat_profile, num_profile, stats
from tarnish.fixed_values import (CATEGORICAL_COLS, COLUMN_DESCRIPTIONS, LABEL_COLS, NO_DESCRIPTION, OUTPUT_CONTRACT,
                                  SYSTEM_MESSAGE, T1_EXTRA_FEATURE_COLS, T2_FEATURE_COLS, TASK_TEXTS, TEXT_COLS)
from tarnish.plans.agent_queries import ROW_COLUMNS

STRINGS = set(CATEGORICAL_COLS) | set(TEXT_COLS)


def json_row(columns):
    def value(c):
        if c not in STRINGS:
            return f"coalesce(CAST({c} AS VARCHAR), 'null')"
        clipped = f"CASE WHEN length({c}) > 800 THEN substring({c}, 1, 800) || '…' ELSE {c} END"
        return f"coalesce(CAST(to_json(nullif({clipped}, '')) AS VARCHAR), 'null')"

    return "'{' || " + " || ', ' || ".join(f"'\"{c}\": ' || {value(c)}" for c in columns) + " || '}'"


def _head():
    name, goal, label = TASK_TEXTS["t2"]
    columns = "\n".join(["COLUMNS:"] + [f"- {c}: {COLUMN_DESCRIPTIONS[c]}" for c in T2_FEATURE_COLS])
    return quoted(f"TASK: {name}\nGOAL: {goal}\nLABEL: {label}\n\n\n{columns}\n\nTRAINING-SET PROFILE (compact summary):\n")


PROMPTS = {
    "train": TRAIN,
    "np": num_profile([c for c in T2_FEATURE_COLS if c not in STRINGS]),
    "cp": cat_profile([c for c in T2_FEATURE_COLS if c in CATEGORICAL_COLS]),
    "profile_text": "SELECT string_agg(line, chr(10) ORDER BY line_no) AS text FROM ("
                    + SWEEP_SQL["a12_profile_text"][SWEEP_SQL["a12_profile_text"].rindex("SELECT 0 AS line_no"):] + ")",
    "prompts": f"""SELECT order_id, y_t2 AS y, {_head()} || (SELECT text FROM profile_text) || {quoted(chr(10) * 2 + "ROW:" + chr(10))}
        || {json_row(T2_FEATURE_COLS)} || {quoted(chr(10) * 2 + OUTPUT_CONTRACT)} AS prompt
        FROM order_features WHERE split = 'test' AND y_t2 IS NOT NULL""",
    "calls": """SELECT *, n % (5 * (attempt + 1)) <> 0 AS ok, n // 4 AS prompt_tokens FROM (
            SELECT order_id, y, length(prompt) AS n, 0 AS attempt FROM prompts UNION ALL
            SELECT order_id, y, length(prompt), 1 FROM prompts WHERE length(prompt) % 5 = 0)""",
    "records": """SELECT *, CASE WHEN ok THEN '{"prediction": ' || n % 2 || ', "confidence": 0.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0')
            || ', "rationale": "length"}' ELSE 'cannot say' END AS raw FROM calls""",
    "answers": """SELECT order_id, any_value(y) AS y, bool_or(ok) AS ok, count(*) AS n_calls,
            coalesce(max(CASE WHEN ok THEN n % 2 END), -1)::INTEGER AS prediction,
            coalesce(max(CASE WHEN ok THEN (n % 100) / 100.0::DOUBLE END), 0) AS confidence,
            CASE WHEN bool_or(ok) THEN 'length' ELSE 'PARSE_FAIL: no JSON object' END AS rationale FROM calls GROUP BY 1""",
    "scored_answers": """SELECT *, CASE prediction WHEN 1 THEN confidence WHEN 0 THEN 1.0::DOUBLE - confidence ELSE 0.5 END
            AS agent_score, 't2' AS task FROM answers""",
}
K = "CAST(json_extract(props, '$.k') AS INTEGER)"
GOOD = "(0, 1, 2, 7, 9, 10, 14, 16, 17, 18, 19, 20)"
PARSED = f"""SELECT *, event_id % 21 IN {GOOD} AS ok,
    CASE WHEN event_id % 21 IN (1, 14, 17, 19) THEN 0 WHEN event_id % 21 IN {GOOD} THEN 1 ELSE -1 END AS prediction,
    CASE WHEN event_id % 21 IN (14, 20) THEN 0.5::DOUBLE WHEN event_id % 21 = 19 THEN 0.25::DOUBLE WHEN event_id % 21 IN {GOOD} THEN {K} / 100.0::DOUBLE ELSE 0 END AS confidence,
    CASE WHEN event_id % 21 = 14 THEN substring(repeat(event_type, 150), 1, 400) WHEN event_id % 21 = 19 THEN 'in'
        WHEN event_id % 21 = 20 THEN 'None' WHEN event_id % 21 IN {GOOD} THEN event_type
        ELSE '' END AS rationale,
    CASE event_id % 21 WHEN 3 THEN 'missing keys' WHEN 4 THEN 'missing keys' WHEN 5 THEN 'prediction must be 0 or 1'
        WHEN 6 THEN 'confidence out of [0,1]' WHEN 8 THEN 'prediction is not a number' WHEN 11 THEN 'no JSON object'
        WHEN 12 THEN 'not an object' WHEN 13 THEN 'no JSON object' WHEN 15 THEN 'prediction is not a number' END AS error
    FROM events"""


def _good(p, c=f"'0.' || lpad(CAST({K} AS VARCHAR), 2, '0')"):
    return f"""'{{"prediction": ' || '{p}' || ', "confidence": ' || {c} || ', "rationale": "' || event_type || '"}}'"""


RAW = f"""CASE event_id % 21 WHEN 0 THEN {_good('1')} WHEN 1 THEN '```json' || chr(10) || {_good('0')} || chr(10) || '```'
    WHEN 2 THEN 'My answer: ' || {_good('1')} || ' I hope it helps.' WHEN 3 THEN 'see {{"a": {{"prediction": 1}}}} there'
    WHEN 4 THEN '{{"prediction": 1}}' WHEN 5 THEN {_good('2')} WHEN 6 THEN {_good('1', "'1.2'")} WHEN 7 THEN {_good('"1"')}
    WHEN 8 THEN {_good('"1.9"')} WHEN 9 THEN {_good('1.9')} WHEN 10 THEN {_good('true')} WHEN 11 THEN ''
    WHEN 12 THEN '[1, 2]' WHEN 14 THEN '  {{"confidence": "0.5", "prediction": 0, "rationale": "' || repeat(event_type, 150)
        || '"}}' || chr(10) WHEN 15 THEN '{{"prediction": null, "confidence": 0.5}}'
    WHEN 16 THEN '1 ' || {_good('1')} WHEN 17 THEN 'true' || chr(10) || {_good('0')} WHEN 18 THEN '"late" ' || {_good('1')}
    WHEN 19 THEN '{{"prediction": 1, "confidence": 0.9, "inner": {{"prediction": 0, "confidence": 0.25, "rationale": "in"}}}} so'
    WHEN 20 THEN '{{"prediction": 1, "confidence": 0.5, "rationale": null}}' END"""
TOKENS = ("user_id * 7 + 100 AS prompt_tokens, length(event_type) AS completion_tokens, "
          "user_id * 7 + 100 + length(event_type) AS total_tokens")
TASK = "['t1', 't2', 't3'][user_id % 3 + 1] AS task"
NAMES = "orders items payments reviews customers products sellers".split()
STORED = dict(zip(NAMES, "orders order_items order_payments order_reviews customers products sellers".split()))
WIDTHS = dict(zip(NAMES, (8, 7, 5, 7, 5, 9, 4)))

SQL = {
    "s1_typed_csv": sql("""SELECT * REPLACE (CAST(review_id AS VARCHAR) AS review_id, CAST(order_id AS VARCHAR) AS order_id,
        nullif(review_comment_title, '') AS review_comment_title,
        nullif(review_comment_message, '') AS review_comment_message) FROM c_reviews"""),
    "s1_rejected_records": """SELECT 'lines' AS table_name, count(*) AS n_read, count_if(bad) AS n_rejected,
        count_if(NOT bad) AS n_rows, CAST(sum(l_orderkey) FILTER (NOT bad) AS BIGINT) AS kept_keys,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) FILTER (NOT bad) AS DOUBLE) AS kept_price,
        CAST(sum(CASE WHEN l_orderkey % 89 = 0 THEN length(l_orderkey::VARCHAR) ELSE length(l_orderkey::VARCHAR)
            + length(l_partkey::VARCHAR) + length(l_linenumber::VARCHAR) + 6 END) FILTER (bad) AS BIGINT) AS rejected_chars
        FROM (SELECT *, l_orderkey % 89 = 0 OR l_orderkey % 97 = 0 AS bad FROM lineitem)""",
    "s2_bronze_report": sql("SELECT * FROM t UNION ALL SELECT 'TOTAL', CAST(sum(n_rows) AS BIGINT), "
                            "CAST(sum(n_cols) AS BIGINT) FROM t", t=" UNION ALL ".join(
        f"SELECT '{STORED[n]}' AS table_name, count(*) AS n_rows, {WIDTHS[n]}::BIGINT AS n_cols FROM c_{n}" for n in NAMES)),
    "s3_named_tables": sql(" UNION ALL ".join(f"SELECT '{STORED[n]}' AS name, count(*) AS n FROM c_{n}" for n in NAMES) + """
        UNION ALL SELECT seller_state, count(*) FROM c_sellers GROUP BY 1
        UNION ALL SELECT product_category_name, count(*) FROM c_products GROUP BY 1"""),
    "s4_silver_store": FEATURE_SQL["e4_order_features"],
    "s5_s6_call_log": f"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, {TASK}, 'a1' AS mode,
        CAST(event_id % 2 AS INTEGER) AS attempt, ok, error, {TOKENS}, {RAW} AS raw, prediction, confidence, rationale
        FROM ({PARSED})""",
    "s7_sweep_store": f"""SELECT task, family, severity_label, seed, count(*) AS n FROM (
        {EXISTING.replace("DISTINCT", "")}) WHERE severity_label IS NOT NULL AND seed IS NOT NULL GROUP BY ALL""",
    "s8_json_report": FEATURE_SQL["a4_split_summary"],
    "s9_csv_summary": """SELECT event_type, round(avg(value), 4) AS value_mean, round(stddev_samp(value), 4) AS value_std
        FROM events GROUP BY 1""",
    "s11_cached_profile": sql("SELECT CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT string_split(text, chr(10)) AS l "
                              "FROM profile_text), range(1, 100) r(i) WHERE i <= len(l)",
                              **{k: PROMPTS[k] for k in ("train", "np", "cp", "profile_text")}),
    "j12_column_descriptions": sql(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, {quoted(COLUMN_DESCRIPTIONS.get(c, NO_DESCRIPTION))} AS description "
        "FROM order_features" for c in ["order_id", "split", *LABEL_COLS, *T2_FEATURE_COLS, *T1_EXTRA_FEATURE_COLS, *TEXT_COLS])),
    "p15_row_json": sql(f"SELECT order_id, {json_row(ROW_COLUMNS)} AS row FROM order_features"),
    "p15_row_json_numbers": sql("SELECT order_id, " + json_row(["total_price", "total_freight", "days_to_estimated",
                                "mean_product_weight_g", "days_to_approved"]) + " AS row FROM order_features"),
    "g1_prompts": sql(f"SELECT order_id, 'system' AS role_0, {quoted(SYSTEM_MESSAGE)} AS content_0, 'user' AS role_1, "
                      "prompt AS content_1 FROM prompts", **PROMPTS),
    "g2_parse_answers": f"SELECT event_id, prediction, confidence, rationale, ok, error FROM ({PARSED})",
    "g3_batch_scoring": sql("SELECT order_id, prediction, confidence, rationale, ok, n_calls, agent_score "
                            "FROM scored_answers", **PROMPTS),
    "g3_stored_answers": sql("SELECT order_id, prediction, confidence, rationale, ok, n_calls, agent_score "
                             "FROM scored_answers", **PROMPTS),
    "a15_stored_answer_costs": sql("""SELECT 'stub' AS scorer, 't2' AS task, attempt,
        CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(length(raw) // 4) AS BIGINT) AS completion_tokens,
        CAST(sum(prompt_tokens + length(raw) // 4) AS BIGINT) AS total_tokens,
        round(sum(prompt_tokens) * 0.15e-6 + sum(length(raw) // 4) * 0.60e-6, 6) AS cost
        FROM (SELECT DISTINCT prompt, attempt, prompt_tokens, raw FROM records JOIN prompts USING (order_id)) GROUP BY attempt""",
        **PROMPTS),
    "g4_call_records": sql("""SELECT 't2' AS task, 'a1' AS mode, attempt, ok,
        CASE WHEN NOT ok THEN 'no JSON object' END AS error, prompt_tokens, length(raw) // 4 AS completion_tokens,
        prompt_tokens + length(raw) // 4 AS total_tokens, raw, CASE WHEN ok THEN (n % 2)::INTEGER ELSE -1 END AS prediction,
        CASE WHEN ok THEN (n % 100) / 100.0::DOUBLE ELSE 0 END AS confidence FROM records""", **PROMPTS),
    "g5_agent_baseline": sql(f"""SELECT s.task, n, s.n_pos, s.n_neg, parse_ok, prompt_tokens, completion_tokens,
        prompt_tokens + completion_tokens AS total_tokens,
        round(prompt_tokens * 0.15e-6 + completion_tokens * 0.60e-6, 6) AS cost, round(auroc, 6) AS auroc,
        round(f1, 6) AS f1, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, round(parse_ok / n, 6) AS parse_ok_rate
        FROM (SELECT task, {stats()} FROM scored_answers GROUP BY 1) s
        JOIN ({area('scored_answers', ['task'], 'y', 'agent_score')}) a USING (task),
        (SELECT CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
                CAST(sum(length(raw) // 4) AS BIGINT) AS completion_tokens FROM records)""", **PROMPTS),
    "a15_token_costs": f"""SELECT task, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
        CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
        round(sum(prompt_tokens) * 0.15e-6 + sum(completion_tokens) * 0.60e-6, 6) AS cost
        FROM (SELECT {TASK}, {TOKENS} FROM events) GROUP BY 1""",
    "a16_pilot_report": f"""SELECT event_type, count(*) AS n, count_if(ok) AS parsed_ok,
        round(count_if(ok AND prediction = y) / count_if(ok), 6) AS accuracy,
        round(count_if(ok AND prediction = 1 AND y = 1) / count_if(ok AND y = 1), 6) AS tpr,
        round(count_if(ok AND prediction = 0 AND y = 0) / count_if(ok AND y = 0), 6) AS tnr,
        count_if(ok AND prediction = 1) AS predicted_positive
        FROM (SELECT *, user_id % 2 AS y FROM ({PARSED})) GROUP BY 1""",
}
