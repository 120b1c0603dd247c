"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from barloom.plans import oracles, queries

SF = "/root/testdata/sf0.001"
QUICK = (
    "bars", "bar_checks", "batch_identity", "source_roles", "text_forms", "local_dates", "price_status", "valuations_as_of", "previous_results", "merged_history", "market_days", "readiness",
    "panel_indicators", "panel_drawdowns", "whole_history_risk", "first_candidates", "universe_members", "second_ranking", "history_summary", "version_coverage", "supplement_decisions",
    "result_changes", "discrepancy_changes", "quality_frequency", "run_roll_ups", "run_quality", "broken_versions", "broken_rows", "reconcile_inputs", "structure_problems", "universe_conflicts", "daily_results",
    "month_rejects", "candle_rejects", "snapshot_rejects", "insert_conflicts", "upserts", "redacted_messages", "clean_references", "json_scalars", "table_digests",
    "prior_dates", "reason_frequency", "supplement_routes", "snapshot_ratio_rejects", "target_reconciliation", "reconciliation_dates", "version_ids", "version_ancestry", "backfill_months", "late_arrivals", "differing_ranges", "pruned_differences", "stored_summary", "rolled_quality", "rolled_reasons", "daily_indicators",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


def cell(v):
    return None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, con, name):
    cursor = con.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted((tuple(map(cell, r)) for r in cursor.fetchall()), key=repr)
    out = queries.queries()[name](spark, SF)
    assert sorted(out.columns) == sorted(columns)
    assert sorted((tuple(map(cell, r)) for r in out.select(columns).collect()), key=repr) == want


def test_every_panel_query_has_sql():
    assert set(oracles.oracle_sql()) == set(queries.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
