import datetime as dt

import pytest
from barloom.operators import compare, first_screen, second_screen, universe
from pyspark.sql import functions as F
from tests.test_windows_and_asof import series

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=3 * (n - 1))
RATIOS = "symbol string, metric_date date, name string, value double, unit string, source string"


def ratios(spark, rows=()):
    return spark.createDataFrame([(s, d, n, v, "ratio", "primary") for s, d, n, v in rows], RATIOS)


def first(spark, bars, day, values=None, previous=None):
    members = spark.createDataFrame([("0001",)], "symbol string")
    metrics = first_screen.metrics(members, bars, values or ratios(spark), day, previous or day)
    return {(r.metric, r.component): r for r in metrics.collect()}, {r.code: r for r in first_screen.reasons(metrics).collect()}, first_screen.evaluations(metrics, first_screen.reasons(metrics)).first()


def test_a_move_of_exactly_the_threshold_fires(spark):
    metrics, reasons, evaluated = first(spark, series(spark, [100, 100, 103]), DAY(3))
    assert metrics["price_change_1d", None].current == 3.0 and reasons["price_change_1d_threshold"].threshold_multiple == 1.0
    assert evaluated.triggered and evaluated.quality == "warning"
    _, below, _ = first(spark, series(spark, [100, 100, 102.999]), DAY(3))
    assert not below


def test_volume_leaves_the_current_bar_out_and_low_is_context(spark):
    metrics, reasons, _ = first(spark, series(spark, [100] * 22, volumes=[1000] * 21 + [2000]), DAY(22))
    assert metrics["volume_anomaly", None].current == 2.0 and "volume_anomaly_high" in reasons
    _, reasons, evaluated = first(spark, series(spark, [100] * 22, volumes=[1000] * 21 + [500]), DAY(22))
    assert set(reasons) == {"volume_anomaly_low_context"} and not evaluated.triggered and evaluated.secondary_reasons == 1


def test_short_history_wrong_day_and_no_prices(spark):
    metrics, _, _ = first(spark, series(spark, [100, 101]), DAY(2))
    assert {r.status for (m, _), r in metrics.items() if m != "valuation_update"} == {"insufficient_history"}
    metrics, _, _ = first(spark, series(spark, [100, 101, 110]), DAY(4))
    assert {r.status for (m, _), r in metrics.items() if m != "valuation_update"} == {"market_date_mismatch"}
    metrics, reasons, evaluated = first(spark, series(spark, [1, 2, 3], "0009"), DAY(3))
    assert {r.status for (m, _), r in metrics.items() if m != "valuation_update"} == {"missing_source"} and not reasons and evaluated.quality == "unavailable"
    metrics, _, _ = first(spark, series(spark, [100, 0, 103]), DAY(3))
    assert metrics["price_change_1d", None].status == "invalid_denominator"


def test_volatility_needs_62_bars(spark):
    closes = [100 + (k % 2) for k in range(62)]
    assert first(spark, series(spark, closes[1:]), DAY(61))[0]["volatility_regime_change", None].status == "insufficient_history"
    row = first(spark, series(spark, closes), DAY(62))[0]["volatility_regime_change", None]
    assert row.status == "available" and row.current == pytest.approx(row.previous, rel=0.02)


def test_valuation_changes(spark):
    bars = series(spark, [100, 100, 100])
    pe, pb, dy = "price_earnings_ratio", "price_to_book_ratio", "dividend_yield_pct"
    values = ratios(spark, [("0001", DAY(2), pe, 10.0), ("0001", DAY(3), pe, 11.0), ("0001", DAY(3), pb, 2.0), ("0001", DAY(2), dy, 1.0), ("0001", DAY(3), dy, 1.5)])
    metrics, reasons, _ = first(spark, bars, DAY(3), values, DAY(2))
    assert metrics["valuation_update", "pe_ratio"].delta == pytest.approx(10.0) and "valuation_pe_relative_change" in reasons
    assert metrics["valuation_update", "pb_ratio"].delta is None and reasons["valuation_pb_availability_transition"].threshold_multiple == 1.0
    assert metrics["valuation_update", "dividend_yield"].delta == pytest.approx(0.5) and "valuation_yield_delta_threshold" in reasons
    negative = ratios(spark, [("0001", DAY(2), pe, -10.0), ("0001", DAY(3), pe, 11.0)])
    assert first(spark, bars, DAY(3), negative, DAY(2))[0]["valuation_update", "pe_ratio"].status == "invalid_denominator"


def test_candidates_rank_and_limit(spark):
    rows = [("b", "clean", 2, 0, 20, 1.5, "", True), ("a", "clean", 2, 0, 20, 1.5, "", True), ("c", "clean", 3, 0, 50, 1.0, "", True), ("d", "clean", 2, 0, 10, 1.0, "", True), ("e", "clean", 0, 1, None, None, "", False)]
    frame = spark.createDataFrame(rows, "symbol string, quality string, primary_reasons int, secondary_reasons int, class_priority int, threshold_multiple double, codes string, triggered boolean")
    got = sorted((r["rank"], r.symbol) for r in first_screen.candidates(frame, 3).collect())
    assert got == [(1, "c"), (2, "d"), (3, "a")]
    counts = first_screen.counts(frame, frame, 3).first()
    assert (counts.triggered_count, counts.candidate_count, counts.truncated) == (4, 3, True)


def test_input_gaps_and_previous_duplicates(spark):
    members = spark.createDataFrame([("a",), ("b",)], "symbol string")
    inputs = spark.createDataFrame([("b",), ("b",), ("c",)], "symbol string")
    assert sorted(map(tuple, first_screen.input_gaps(members, inputs).collect())) == [("a", "missing"), ("b", "duplicate"), ("c", "extra")]
    rows = ratios(spark, [("a", DAY(1), "x", 1.0), ("a", DAY(1), "x", 1.0), ("b", DAY(1), "x", 1.0), ("b", DAY(1), "x", 2.0)])
    assert {r.symbol: r.conflict for r in first_screen.merged_previous(rows).collect()} == {"a": False, "b": True}


def test_the_cap_leaves_no_previous_state_of_250_rows(spark):
    members = spark.createDataFrame([("0001",)], "symbol string")
    rows = {r.metric: r for r in second_screen.price_metrics(members, series(spark, [100 + k % 7 for k in range(300)]), DAY(300)).collect()}
    assert len(rows) == 13
    for name in ("max_drawdown_250d", "ma_distance_250d"):
        assert rows[name].current is not None and rows[name].previous is None and rows[name].delta is None
    assert rows["max_drawdown_120d"].previous is not None and rows["return_120d"].observations == 121
    short = {r.metric: r for r in second_screen.price_metrics(members, series(spark, [100 + k % 7 for k in range(60)]), DAY(60)).collect()}
    assert short["volatility_60d"].status == "insufficient_history" and short["ma_distance_60d"].status == "available" and short["return_60d"].status == "insufficient_history"


def test_final_ranking(spark):
    best = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 3, 1), ("d", 4, 1)], "symbol string, rank int, primary_reasons int")
    states = spark.createDataFrame([("a", "available", "match"), ("b", "available", "source_discrepancy"), ("c", "market_date_mismatch", "match"), ("d", "available", "missing_source")], "symbol string, price_status string, validation_status string")
    why = spark.createDataFrame([("a", "x", "research_change", 20, 1, 1.5), ("b", "source_discrepancy", "data_quality", 10, 1, 1.0), ("d", "x", "research_change", 20, 1, 3.0)], "symbol string, code string, kind string, class_priority int, reason_order int, threshold_multiple double")
    got = {r.symbol: (r.final_rank, r.quality, r.kind) for r in second_screen.ranked(best, why, states).collect()}
    assert got == {"c": (1, "blocked", "data_quality_candidate"), "b": (2, "warning", "data_quality_candidate"), "d": (3, "warning", "research_candidate"), "a": (4, "clean", "research_candidate")}
    failed = second_screen.ranked(best, why, states, best.where("symbol = 'a'")).where("symbol = 'a'").first()
    assert (failed.final_rank, failed.quality) == (1, "failed")


def test_universe_decides_by_the_first_case(spark):
    day = dt.date(2024, 1, 10)
    names = lambda *s: [(x, f"name {x}") for x in s]
    feeds = {
        "identity": spark.createDataFrame([(s, n, dt.date(2030, 1, 1) if s == "late" else dt.date(2000, 1, 1)) for s, n in names("ok", "late", "gone", "none", "unk", "etf", "noprice", "noval", "nothing")] + [("clash", "one", dt.date(2000, 1, 1))], "symbol string, name string, listing_date date"),
        "trading": spark.createDataFrame([(s, n, s != "noprice") for s, n in names("ok", "gone", "unk", "etf", "noprice", "noval", "noid")] + [("clash", "other", True)], "symbol string, name string, price_available boolean"),
        "valuation": spark.createDataFrame(names("ok", "gone", "noprice", "notrade", "noid"), "symbol string, name string"),
        "classification": spark.createDataFrame([(s, "unknown" if s == "unk" else "etf" if s == "etf" else "common_stock") for s in ("ok", "late", "gone", "unk", "etf", "noprice", "noval", "nothing", "clash", "noid", "notrade")], "symbol string, class string"),
        "delisting": spark.createDataFrame([("gone", "name gone", dt.date(2020, 1, 1)), ("ok", "name ok", dt.date(2030, 1, 1)), ("never", "x", dt.date(2000, 1, 1))], "symbol string, name string, delisting_date date"),
    }
    got = {r.symbol: (r.status.split("_")[0], r.reason) for r in universe.members(feeds, day).collect()}
    assert got == {
        "ok": ("active", None), "late": ("classification", "listing_after_day"), "gone": ("inactive", "delisted"), "none": ("classification", "classification_missing"), "unk": ("classification", "classification_unknown"), "etf": ("excluded", "etf"),
        "noprice": ("active", "price_unavailable"), "noval": ("active", "valuation_missing"), "nothing": ("active", "both_feeds_missing"), "clash": ("classification", "identity_conflict"), "noid": ("classification", "identity_missing"), "notrade": ("classification", "identity_missing"),
    }
    classes = universe.assigned_classes(spark.createDataFrame([("a", "etf"), ("b", "unknown"), ("c", "common_stock")], "symbol string, class string"), spark.createDataFrame([("a",), ("b",), ("d",)], "symbol string"))
    assert {r.symbol: r["class"] for r in classes.collect()} == {"a": "etf", "b": "common_stock", "c": "common_stock", "d": "common_stock"}


def test_comparison_of_sources(spark):
    left = series(spark, [1, 2, 3])
    right = series(spark, [1, 2.5, 3]).where("trade_date > '2024-01-01'").unionByName(series(spark, [7], "0002"))
    outcomes, _ = compare.latest_day(left, right, DAY(2))
    assert {r.symbol: r.outcome for r in outcomes.collect()} == {"0001": "source_discrepancy", "0002": "missing_source"}
    paired = compare.histories(left, right, DAY(3))
    got = compare.history_summary(paired).where("symbol = '0001'").first()
    assert (got.common_dates, got.matched_dates, got.left_only_dates, got.right_only_dates, got.field_differences) == (2, 1, 1, 0, 4)
    assert {r.field: r.differences for r in compare.differences_by_field(compare.history_differences(paired)).collect()} == {"open": 1, "high": 1, "low": 1, "close": 1}
    zero = compare.history_differences(compare.histories(series(spark, [1], volumes=[0]), series(spark, [1], volumes=[5]), DAY(1))).first()
    assert zero.reason == "volume_mismatch" and zero.relative_difference_pct is None and zero.absolute_difference == 5
    assert spark.range(1).select(compare.timestamp_state(F.lit(1), F.lit(None)).alias("s")).first().s == "missing"
