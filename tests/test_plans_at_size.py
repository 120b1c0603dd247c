"""What plans do once or without gathering, so that queries grow no faster than their tables."""

from __future__ import annotations

import datetime as dt
import re

from barloom.operators import asof
from barloom.sources import payloads


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_yearly_stats_parse_a_payload_once(spark):
    good, bad = payloads.yearly_stats(spark.createDataFrame([("1", "{}")], "payload_id string, payload string").repartition(2))
    for rows in (good, bad):
        assert len(re.findall("from_json", plan(rows))) == 1


def test_last_bars_of_two_days_without_a_join(spark):
    rows = [(s, dt.date(2024, 1, d), float(d)) for s, days in (("a", range(1, 11)), ("b", range(1, 10)), ("c", (9,)), ("d", (10,))) for d in days]
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, close double")
    day, before = dt.date(2024, 1, 10), dt.date(2024, 1, 9)
    got = asof.of_last_bars(bars, {"of_day": day, "of_before": before}, 3)
    assert "Join" not in plan(got)
    for flag, d in (("of_day", day), ("of_before", before)):
        assert sorted(map(tuple, got.where(flag).select("symbol", "trade_date").collect())) == sorted(map(tuple, asof.last_bars(bars, d, 3).select("symbol", "trade_date").collect()))
    assert asof.of_last_bars(bars, {"of_day": day, "of_before": None}, 3).where("of_before").count() == 0


def test_latest_values_are_added_up_by_hashing(spark):
    rows = [("a", "pe", dt.date(2024, 1, d), float(d), s) for d in (1, 2, 3) for s in ("x", "y")] + [("a", "pb", dt.date(2024, 1, 2), 7.0, "x")]
    metrics = spark.createDataFrame(rows, "symbol string, name string, metric_date date, value double, source string")
    got = asof.valuations_as_of(metrics, dt.date(2024, 1, 2))
    assert sorted(map(tuple, got.select("name", "value", "metric_date", "source").collect())) == [("pb", 7.0, dt.date(2024, 1, 2), "x"), ("pe", 2.0, dt.date(2024, 1, 2), "y")]
    steps = re.findall(r"(\w*)Aggregate\(", got._jdf.queryExecution().sparkPlan().toString())
    assert steps[-1] == "Hash"  # the one next to the rows


def test_bars_at_hand_are_read_from_files(spark):
    from barloom.plans.panel import Panel

    assert "Aggregate" not in plan(Panel(spark, "/root/testdata/sf0.001").at_hand().second)
