"""Registered queries against the independent engine, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from oracle.check import TABLES, compare

SLOW = {"e2_j10_paired_sweep", "e2_resumed_sweep", "g3_stored_answers", "a17_gate_decision", "a18_cell_summary", "a19_bootstrap_intervals",
        "a20_asymmetry_counts", "g3_batch_scoring", "g4_call_records"}  # run by python -m oracle.check
KEYS = [k for k in entry.oracle_sql() if k not in SLOW and k != "w3_strict_sample"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches(spark, con, key):
    ok, note = compare(key, spark, con, SF)
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 33 and df.count() > 0
