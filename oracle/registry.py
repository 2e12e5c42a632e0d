"""All oracle SQL."""

from oracle import agent_sql, corruption_sql, feature_sql, model_sql, sketch_sql, sweep_sql

SQL = {**feature_sql.SQL, **corruption_sql.SQL, **sketch_sql.SQL, **sweep_sql.SQL, **agent_sql.SQL, **model_sql.SQL}
