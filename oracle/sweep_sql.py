"""SQL of metrics, profiles, the paired sweep, the gate and their summaries."""

from oracle.base import sql
from oracle.corruption_sql import (currency, days, drawn, hash_of, hit, hour, missing, misread, pick, taxonomy)
from tarnish.fixed_values import (CATEGORICAL_COLS, FAMILIES, MONETARY_COLS, SEEDS,
                                  SWEEP_FAMILIES, T1_EXTRA_FEATURE_COLS, T2_FEATURE_COLS, TAXONOMY_COLS, TEXT_COLS,
                                  TIME_DAY_COLS)
from tarnish.plans.sweep import clean_cells, gate_cells, sweep_plan

FEATURES = T2_FEATURE_COLS + T1_EXTRA_FEATURE_COLS + TEXT_COLS
NUMERIC = [c for c in FEATURES if c not in CATEGORICAL_COLS and c not in TEXT_COLS]
LABEL = {"t1": "y_t1", "t2": "y_t2", "t3": "y_t3"}
COLUMNS = {"t1": T2_FEATURE_COLS + T1_EXTRA_FEATURE_COLS, "t2": T2_FEATURE_COLS, "t3": T2_FEATURE_COLS + TEXT_COLS}
TRAIN = "SELECT * FROM order_features WHERE split = 'train' AND y_t2 IS NOT NULL"


def area(source, keys, label, score):
    """Rank-sum form of the area under the curve."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}"
    return f"""SELECT {k}, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN
            (r - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (CAST(n_pos AS DOUBLE) * n_neg) END AS auroc
        FROM (SELECT {k}, sum(CASE WHEN {label} = 1 THEN rk END)::DOUBLE AS r, count(*) FILTER ({label} = 1) AS n_pos,
                     count(*) FILTER ({label} = 0) AS n_neg
              FROM (SELECT *, rank() OVER ({part} ORDER BY {score})
                        + (count(*) OVER ({part}, {score}) - 1) / 2.0::DOUBLE AS rk
                    FROM {source} WHERE {score} IS NOT NULL AND {label} IS NOT NULL) GROUP BY {k})"""


def stats(p="prediction", y="y"):
    pred = f"(CASE WHEN {p} IN (0, 1) THEN {p} ELSE 0 END)"
    return f"""count(*) AS n, count(*) FILTER ({y} = 1) AS n_pos, count(*) FILTER ({y} = 0) AS n_neg,
        coalesce(2.0::DOUBLE * count(*) FILTER ({pred} = 1 AND {y} = 1)
            / nullif(2 * count(*) FILTER ({pred} = 1 AND {y} = 1) + count(*) FILTER ({pred} <> {y}), 0), 0) AS f1,
        count(*) FILTER ({pred} = 1 AND {y} = 1) / greatest(1, count(*) FILTER ({y} = 1)) AS tpr,
        count(*) FILTER ({pred} = 0 AND {y} = 0) / greatest(1, count(*) FILTER ({y} = 0)) AS tnr,
        count(*) FILTER ({p} IN (0, 1)) AS parse_ok"""


EVENT_SCORES = """SELECT event_id, event_type AS cell, CAST(user_id % 2 AS INTEGER) AS y, round(value % 1, 2) AS p,
    CAST(event_id % 3 - 1 AS INTEGER) AS prediction FROM events"""


def num_profile(columns):
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, 1 - count({c}) / count(*) AS miss,
        avg({c})::DOUBLE AS mean, stddev_samp({c}) AS std, quantile_cont({c}::DOUBLE, 0.1) AS p10,
        quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.9) AS p90, min({c})::DOUBLE AS min,
        max({c})::DOUBLE AS max,
        CASE WHEN stddev_samp({c}) > 0 AND stddev_samp(y_t2) FILTER ({c} IS NOT NULL) > 0
             THEN covar_samp({c}, y_t2) / (stddev_samp({c}) * stddev_samp(y_t2) FILTER ({c} IS NOT NULL))
             ELSE 0 END AS corr FROM train""" for c in columns)


def cat_profile(columns):
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", coalesce(sum(n) FILTER (v IS NOT NULL), 0)::BIGINT AS n,
        1 - coalesce(sum(n) FILTER (v IS NOT NULL), 0) / sum(n) AS miss, count(v) AS "unique",
        string_agg(v || '=' || n, ', ' ORDER BY rn) FILTER (rn <= 3 AND v IS NOT NULL) AS top,
        coalesce(max(prev) FILTER (rn = 1 AND v IS NOT NULL), 0) AS prev_y_top
        FROM (SELECT *, row_number() OVER (ORDER BY v IS NULL, n DESC, v) AS rn
              FROM (SELECT {c} AS v, count(*) AS n, avg(y_t2) AS prev FROM train GROUP BY 1))""" for c in columns)


def _profile_text():
    """The text lines, with the number formats of the engine's own format function."""
    g = lambda c: f"format('{{:.3g}}', {c})"
    num = (f""""column" || ': numeric  n=' || n || '  miss=' || format('{{:.1f}}', miss * 100) || '%  mean=' || {g('mean')}
        || '  std=' || {g('std')} || '  p10=' || {g('p10')} || '  p50=' || {g('p50')} || '  p90=' || {g('p90')}
        || '  min=' || {g('min')} || '  max=' || {g('max')} || '  corr_y=' || format('{{:+.3f}}', corr)""")
    cat = (f""""column" || ': categorical  n=' || n || '  miss=' || format('{{:.1f}}', miss * 100) || '%  unique='
        || "unique" || '  top=' || top || '  prev_y_top=' || format('{{:.3f}}', prev_y_top)""")
    order = "list_position([" + ", ".join(f"'{c}'" for c in T2_FEATURE_COLS) + "], \"column\")"
    numeric = [c for c in T2_FEATURE_COLS if c in NUMERIC]
    cats = [c for c in T2_FEATURE_COLS if c in CATEGORICAL_COLS]
    return sql(f"""SELECT 0 AS line_no, 'Training-set profile for task=t2  n_train=' || format('{{:,}}', count(*))
            || '  prevalence(y=1)=' || format('{{:.4f}}', avg(y_t2)) || chr(10) AS line FROM train
        UNION ALL SELECT {order}::INTEGER, {num} FROM np UNION ALL SELECT {order}::INTEGER, {cat} FROM cp""",
               train=TRAIN, np=num_profile(numeric), cp=cat_profile(cats))


def cells_table(cells):
    rows = ", ".join("(" + ", ".join([
        f"'{c.task}'", f"'{c.family}'", f"'{c.severity_label}'", f"{c.severity}::DOUBLE", f"{c.seed}::BIGINT",
        f"{c.sample_seed}::BIGINT", "[" + ", ".join(f"'{d}'" for d in c.drifted) + "]::VARCHAR[]"]) + ")" for c in cells)
    return (f"SELECT * FROM (VALUES {rows}) t(task, family, severity_label, severity, seed, sample_seed, drifted)")


def corrupted(c, task, noise=False):
    """A column under the row's own cell."""
    s = "severity"
    parts = [f"WHEN family = 'missing_injection' THEN {missing(c, s)}",
             f"WHEN family = 'schema_drift' AND list_contains(drifted, '{c}') THEN NULL"]
    if c in MONETARY_COLS:
        parts.append(f"WHEN family = 'currency_unit_drift' THEN {currency(c, s)}")
    if c == "purchase_hour":
        parts.append(f"WHEN family = 'timezone_collapse' THEN {hour(c, s)}")
    elif c in TIME_DAY_COLS:
        parts.append(f"WHEN family = 'timezone_collapse' THEN {days(c, s)}")
    if c in TAXONOMY_COLS:
        parts.append(f"WHEN family = 'category_taxonomy_drift' THEN {taxonomy(c, s)}")
    if c in TAXONOMY_COLS or c in TEXT_COLS:
        parts.append(f"WHEN family = 'mojibake_roundtrip' AND {hit('mojibake_roundtrip', c, s)} AND {c} IS NOT NULL "
                     f"THEN m_{c}")
    if noise and c in CATEGORICAL_COLS:
        lv = f"(SELECT list(DISTINCT {c} ORDER BY {c}) FILTER ({c} IS NOT NULL) FROM order_features)"
        at = pick("label_noise_categorical", c, f"len({lv})")
        parts.append(f"WHEN family = 'label_noise_categorical' AND {hit('label_noise_categorical', c, s)} AND len({lv}) >= 2 THEN "
                     f"CASE WHEN {lv}[{at} + 1] IS NOT DISTINCT FROM {c} THEN {lv}[({at} + 1) % len({lv}) + 1] "
                     f"ELSE {lv}[{at} + 1] END")
    return f"CASE {' '.join(parts)} ELSE {c} END"


def flips(task):
    return [c for c in COLUMNS[task] if c in NUMERIC]


def scored_rows(task, n, mode="capped"):
    """Sampled rows of one task under each of its cells, scored by the two closed forms."""
    y, half = LABEL[task], n // 2
    quota = ((f"{half}", f"{n - half}") if mode == "strict" else
             (f"least({half}, p)", f"least({n} - least({half}, p), q)"))
    seeds = [13] if mode == "strict" else SEEDS
    cols = COLUMNS[task]
    garbled = ", ".join(f"coalesce({misread(c)}, '') AS m_{c}" for c in cols if c in TAXONOMY_COLS + TEXT_COLS)
    used = [c for c in ("days_to_estimated", "total_price", "n_items", "dominant_category", "purchase_hour",
                        "n_payments", "review_comment_message") if c in cols]
    shown = ", ".join(f"{corrupted(c, task)} AS x_{c}" for c in used)
    flipped = " + ".join(
        f"CAST(family = 'type_flip' AND {c} IS NOT NULL AND {hit('type_flip', c, 'severity')} AS INTEGER)"
        for c in flips(task))
    length = " + length(coalesce(x_review_comment_message, '')) / 10000.0::DOUBLE" if "review_comment_message" in used else ""
    return f"""
        SELECT task, family, severity_label, severity, seed, sample_seed, order_id, y,
               0.5::DOUBLE + 0.5::DOUBLE * z / (1.0::DOUBLE + abs(z)) AS ml_score,
               CASE WHEN pct % 13 = 5 THEN -1 WHEN x_days_to_estimated < 27 THEN 1 ELSE 0 END AS prediction,
               CASE WHEN pct % 13 = 5 THEN 0.5::DOUBLE WHEN x_days_to_estimated < 27 THEN pct / 100.0::DOUBLE
                    ELSE 1.0::DOUBLE - pct / 100.0::DOUBLE END AS agent_score
        FROM (SELECT *, (27.0::DOUBLE - coalesce(x_days_to_estimated, 27.0)) * 0.1::DOUBLE
                        + coalesce(x_total_price, 0.0) / 1000000.0::DOUBLE + coalesce(x_n_items, 0) * 0.01::DOUBLE
                        {length} AS z,
                     (length(coalesce(x_dominant_category, '')) * 7 + coalesce(x_purchase_hour, 0) * 3
                      + coalesce(x_n_payments, 0) * 11 + n_flipped * 5) % 100 AS pct
              FROM (SELECT task, family, severity_label, severity, seed, sample_seed, order_id, y, {shown},
                           {flipped} AS n_flipped
                    FROM (SELECT r.*, c.*, r.{y} AS y, {hash_of('c.seed', 'r.order_id')} AS h
                          FROM (SELECT f.*, s.sample_seed, {garbled}
                                FROM order_features f
                                JOIN (SELECT order_id, CAST(seed AS BIGINT) AS sample_seed FROM (
                                      {drawn(y, seeds, *quota)})) s USING (order_id)) r
                          JOIN (SELECT * RENAME (sample_seed AS cell_sample) FROM cells WHERE task = '{task}') c
                            ON c.cell_sample = r.sample_seed)))"""


def evaluated(cells, tasks, n, mode="capped"):
    """Named subqueries up to one row per cell with deltas."""
    cell = ["task", "family", "severity_label", "severity", "seed", "sample_seed"]
    k = ", ".join(cell)
    return {
        "cells": cells_table(cells + clean_cells(cells)),
        "scored": " UNION ALL ".join(f"({scored_rows(t, n, mode)})" for t in tasks),
        "ml_area": area("scored", cell, "y", "ml_score"),
        "agent_area": area("scored", cell, "y", "agent_score"),
        "cell_stats": f"SELECT {k}, {stats()} FROM scored GROUP BY {k}",
        "whole": f"""SELECT s.*, m.auroc AS ml_auc, a.auroc AS agent_auc FROM cell_stats s
            JOIN ml_area m USING ({k}) JOIN agent_area a USING ({k})""",
        "deltas": """SELECT w.*, c.ml_auc AS ml_auc_clean, c.agent_auc AS agent_auc_clean,
                w.ml_auc - c.ml_auc AS ml_delta, w.agent_auc - c.agent_auc AS agent_delta
            FROM whole w JOIN (SELECT * FROM whole WHERE family = 'clean') c USING (task, sample_seed)
            WHERE w.family <> 'clean'""",
        "judged": f"SELECT *, {RATIO} AS abs_ratio_max, {STATUS} AS ratio_status FROM deltas",
    }


def over(a, b):
    return f"CASE WHEN abs({b}) > 1e-6 THEN abs({a}) / abs({b}) ELSE 'inf'::DOUBLE END"


RATIO = (f"CASE WHEN ml_delta IS NOT NULL AND agent_delta IS NOT NULL THEN "
         f"greatest({over('agent_delta', 'ml_delta')}, {over('ml_delta', 'agent_delta')}) END")
STATUS = """CASE WHEN ml_delta IS NULL OR agent_delta IS NULL THEN 'undefined'
    WHEN abs(ml_delta) <= 1e-6 AND abs(agent_delta) <= 1e-6 THEN 'both_zero'
    WHEN abs(ml_delta) <= 1e-6 THEN 'ml_zero' WHEN abs(agent_delta) <= 1e-6 THEN 'agent_zero' ELSE 'finite' END"""
RATES = ", ".join(f"round({c}, 6) AS {c}" for c in (
    "ml_auc", "agent_auc", "ml_auc_clean", "agent_auc_clean", "ml_delta", "agent_delta", "tpr", "tnr"))
PLAN = sweep_plan(["t1", "t2", "t3"])
SWEEP = evaluated(PLAN, ["t1", "t2", "t3"], 1000)
KEYS = "task, family, severity_label, seed"
EXISTING = f"""SELECT DISTINCT ['t1', 't2', 't3'][user_id % 3 + 1] AS task,
    CASE event_type WHEN 'view' THEN '{SWEEP_FAMILIES[0]}' WHEN 'click' THEN '{SWEEP_FAMILIES[1]}'
        WHEN 'purchase' THEN '{SWEEP_FAMILIES[2]}' WHEN 'signup' THEN '{SWEEP_FAMILIES[3]}'
        WHEN 'error' THEN '{SWEEP_FAMILIES[4]}' END AS family,
    ['low', 'med', 'high'][event_id % 4 + 1] AS severity_label, [13, 17, 23, 31, 47][event_id % 7 + 1]::BIGINT AS seed
    FROM events"""


def _many_cells():
    cells = sweep_plan(["t2"], FAMILIES)
    garbled = ", ".join(f"coalesce({misread(c)}, '') AS m_{c}" for c in TAXONOMY_COLS)
    shown = ", ".join(f"{corrupted(c, 't2', noise=True)} AS x_{c}" for c in T2_FEATURE_COLS)
    out = ", ".join(f"x_{c} AS {c}" for c in T2_FEATURE_COLS)
    flipped = "concat_ws(',', " + ", ".join(
        f"CASE WHEN family = 'type_flip' AND {c} IS NOT NULL AND {hit('type_flip', c, 'severity')} THEN '{c}' END"
        for c in flips("t2")) + ")"
    return sql(f"""SELECT {KEYS}, order_id, y, {out}, flipped FROM (
        SELECT {KEYS}, order_id, y, {shown}, {flipped} AS flipped FROM (
            SELECT r.*, c.*, r.y_t2 AS y, {hash_of('c.seed', 'r.order_id')} AS h
            FROM (SELECT f.*, s.sample_seed, {garbled} FROM order_features f
                  JOIN (SELECT order_id, CAST(seed AS BIGINT) AS sample_seed FROM (
                        {drawn('y_t2', SEEDS, 'least(500, p)', 'least(1000 - least(500, p), q)')})) s
                  USING (order_id)) r
            JOIN (SELECT * RENAME (sample_seed AS cell_sample) FROM cells) c ON c.cell_sample = r.sample_seed))""",
               cells=cells_table(cells))


def _bootstrap():
    parts = []
    for d in ("ml_delta", "agent_delta"):
        parts.append(f"""SELECT task, family, severity_label, any_value(m)::INTEGER AS n_seeds, '{d}' AS delta,
            round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM (
              SELECT task, family, severity_label, b, any_value(len(ds)) AS m, sum(ds[('0x' || substr(md5(concat_ws('|', '13', task,
                  family, severity_label, CAST(b AS VARCHAR), CAST(j AS VARCHAR))), 1, 8))::BIGINT % len(ds) + 1])
                  / any_value(len(ds)) AS mean
              FROM (SELECT task, family, severity_label, list({d} ORDER BY seed) AS ds FROM judged
                    WHERE {d} IS NOT NULL GROUP BY ALL), range(1, 1001) rb(b), range(1, 6) rj(j)
              WHERE j <= len(ds) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
    return sql(" UNION ALL ".join(parts), **SWEEP)


SQL = {
    "m1_auroc": "WITH s AS (SELECT event_type AS cell, CAST(user_id % 2 AS INTEGER) AS y, value AS p FROM events) "
                f"SELECT cell, n_pos, n_neg, round(auroc, 9) AS auroc FROM ({area('s', ['cell'], 'y', 'p')})",
    "m2_m6_classification_metrics": f"""SELECT cell, n, n_pos, n_neg, parse_ok, round(f1, 6) AS f1, round(tpr, 6) AS tpr,
        round(tnr, 6) AS tnr, round(brier, 6) AS brier, round(parse_ok / n, 6) AS parse_ok_rate
        FROM (SELECT cell, {stats()}, avg((p - y) * (p - y)) AS brier FROM ({EVENT_SCORES}) GROUP BY 1)""",
    "m7_delta_ratio": f"""SELECT user_id, round({RATIO}, 6) AS abs_ratio_max, {STATUS} AS ratio_status FROM (
        SELECT user_id, (count_if(event_type = 'view') - count_if(event_type = 'click')) / 100.0::DOUBLE AS agent_delta,
            (count_if(event_type = 'error') - count_if(event_type = 'signup')) / 100.0::DOUBLE AS ml_delta
        FROM events GROUP BY 1)""",
    "a10_numeric_profile": sql(
        "SELECT \"column\", n, " + ", ".join(f"round({c}, 4) AS {c}" for c in (
            "miss", "mean", "std", "p10", "p50", "p90", "min", "max", "corr"))
        + f" FROM ({num_profile(NUMERIC)})", train=TRAIN),
    "a11_categorical_profile": sql(
        f"""SELECT * REPLACE (round(miss, 6) AS miss, round(prev_y_top, 6) AS prev_y_top)
        FROM ({cat_profile(CATEGORICAL_COLS + TEXT_COLS)})""", train=TRAIN),
    "a12_profile_text": _profile_text(),
    "w2_top_levels": sql("""SELECT dominant_category, count(*) AS n FROM order_features
        WHERE dominant_category IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3"""),
    "j8_paired_rows": sql(f"""SELECT order_id, y_t2, {', '.join(T2_FEATURE_COLS)} FROM order_features WHERE order_id IN (
        SELECT order_id FROM ({drawn('y_t2', [13], 'least(500, p)', 'least(1000 - least(500, p), q)')}))"""),
    "j9_pending_cells": sql(f"""SELECT {KEYS} FROM cells c WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE
        e.task = c.task AND e.family = c.family AND e.severity_label = c.severity_label AND e.seed = c.seed)""",
                            cells=cells_table(PLAN), existing=EXISTING),
    "j11_plan_quotas": sql(f"""SELECT {KEYS}, severity, least(500, p) AS n_pos, least(1000 - least(500, p), q) AS n_neg
        FROM cells JOIN (""" + " UNION ALL ".join(
            f"SELECT '{t}' AS task, count(*) FILTER ({y} = 1) AS p, count(*) FILTER ({y} = 0) AS q "
            "FROM order_features WHERE split = 'test'" for t, y in LABEL.items()) + ") USING (task)",
                           cells=cells_table(PLAN)),
    "e1_plan_report": sql(f"""SELECT task, count(*) AS n_planned, count(e.task) AS n_existing,
        count(*) - count(e.task) AS n_pending FROM cells c LEFT JOIN (SELECT * FROM existing WHERE severity_label IS NOT NULL
        AND seed IS NOT NULL) e USING ({KEYS}) GROUP BY 1""", cells=cells_table(PLAN), existing=EXISTING),
    "c12_many_cells": _many_cells(),
    "e2_j10_paired_sweep": sql(f"""SELECT {KEYS}, severity, n AS n_rows, parse_ok, ratio_status,
        round(abs_ratio_max, 4) AS abs_ratio_max, {RATES} FROM judged""", **SWEEP),
    "e2_resumed_sweep": sql(f"""SELECT {KEYS}, severity, 1000::BIGINT AS n, 1::BIGINT AS n_runs, parse_ok,
        round(abs_ratio_max, 4) AS abs_ratio_max, {RATES.split(", round(tpr")[0]} FROM judged""", **SWEEP),
    "e3_gate": sql(f"""SELECT family, severity, seed, n AS n_rows, parse_ok, ratio_status,
        round(abs_ratio_max, 4) AS abs_ratio_max, {RATES} FROM judged""",
                   **evaluated(gate_cells("t2"), ["t2"], 60, "strict")),
    "a17_gate_decision": sql("""SELECT task, 2.0::DOUBLE AS threshold, round(m, 4) AS max_observed_ratio, m > 2 AS passed,
        strict_reference FROM (
            SELECT task, false AS strict_reference, coalesce(max(abs_ratio_max) FILTER (ratio_status IN
                ('finite', 'ml_zero', 'agent_zero')), 0) AS m FROM judged GROUP BY 1
            UNION ALL SELECT task, true, coalesce(max(abs_ratio_max), 0) FROM judged GROUP BY 1)""", **SWEEP),
    "a18_cell_summary": sql("""SELECT task, family, severity_label, count(*) AS n_seeds,
        round(avg(ml_delta), 6) AS ml_delta_mean, round(stddev_samp(ml_delta), 6) AS ml_delta_std,
        round(avg(agent_delta), 6) AS agent_delta_mean, round(stddev_samp(agent_delta), 6) AS agent_delta_std
        FROM judged GROUP BY 1, 2, 3""", **SWEEP),
    "a19_bootstrap_intervals": _bootstrap(),
    "a20_asymmetry_counts": sql("""SELECT task, count(*) AS n_cells,
        count_if(abs(agent_delta) > 2 * abs(ml_delta)) AS agent_more,
        count_if(abs(ml_delta) > 2 * abs(agent_delta)) AS ml_more,
        count_if(abs(agent_delta) <= 2 * abs(ml_delta) AND abs(ml_delta) <= 2 * abs(agent_delta)) AS similar
        FROM judged WHERE ml_delta IS NOT NULL AND agent_delta IS NOT NULL GROUP BY 1""", **SWEEP),
}
