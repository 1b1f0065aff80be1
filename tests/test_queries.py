"""Registered queries against DuckDB on the smallest tables.

A spread of operators by default; TRACEFP_ALL=1 runs every query.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, rows_of  # noqa: E402

SPREAD = ["trace_summary_mean_std", "beacon_filter", "temporal_trial_features", "http_trial_features", "tls_trial_features",
          "behaviour_trial_features", "attribution_summary", "attribute_flushes", "checkpoints", "events_at_cutoff",
          "field_stability_tls", "header_comparison", "interaction_page_stats", "reassemble_sessions", "fold_metrics",
          "stream_checkpoints", "trial_ordinal", "interval_histogram"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TRACEFP_ALL") else SPREAD


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    rel = duck.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in rel.description], rel.fetchall())


def test_every_check_belongs_to_a_query():
    from tracefp.oracles import all_sql

    assert set(all_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["attribute_requests", "beacon_filter", "events_at_cutoff", "focus_to_input", "minmax_settings"])
def test_no_nested_loops(spark, small, name):
    text = plan(entry.queries()[name](spark, small))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_scan_reads_only_what_is_used(spark, small):
    text = plan(entry.queries()["request_prefixes"](spark, small))
    assert "WindowGroupLimit" in text
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "value" not in schema and "props" not in schema
