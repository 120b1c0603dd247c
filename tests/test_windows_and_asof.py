import datetime as dt

import pytest
from barloom.operators import asof, windows
from pyspark.sql import functions as F


def series(spark, closes, symbol="0001", volumes=None, start=dt.date(2024, 1, 1)):
    rows = [(symbol, start + dt.timedelta(days=3 * k), float(c), float(c), float(c), float(c), (volumes or [1000] * len(closes))[k], "primary") for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume long, source string")


def test_windows_count_observations(spark):
    rows = windows.panel(series(spark, [100 + k for k in range(25)])).orderBy("trade_date").collect()
    assert rows[18].ma_20 is None and rows[19].ma_20 == pytest.approx(109.5)
    assert rows[19].return_20d is None and rows[20].return_20d == pytest.approx(20.0)
    assert rows[0].return_1d is None and rows[0].volatility_60d is None and rows[1].volatility_60d is None and rows[2].volatility_60d is not None
    assert rows[2].volatility_observations == 2
    assert rows[18].volume_state == "insufficient" and rows[19].volume_state == "normal"


def test_order_of_rows_does_not_matter(spark):
    frame = series(spark, [100, 90, 95, 80, 120])
    one, two = (sorted(map(tuple, windows.panel(f).collect()), key=str) for f in (frame, frame.orderBy(F.desc("close")).repartition(3)))
    assert one == two


def test_volume_states_at_their_limits(spark):
    high = windows.panel(series(spark, [100] * 20, volumes=[18] * 19 + [38])).orderBy(F.desc("trade_date")).first()
    assert high.volume_ratio_20d == pytest.approx(38 / 19) and high.volume_state == "high"
    low = windows.panel(series(spark, [100] * 20, volumes=[39] * 19 + [19])).orderBy(F.desc("trade_date")).first()
    assert low.volume_state == "low"


def test_drawdown_is_inside_the_window(spark):
    assert spark.range(1).select(windows.drawdown_of(F.array(*[F.lit(float(x)) for x in (10, 12, 9, 11)]))).first()[0] == pytest.approx(-25.0)
    rows = windows.drawdowns(series(spark, [200] + [100 + k for k in range(20)]), (20,)).orderBy("trade_date").collect()
    assert rows[18].max_drawdown_20d is None and rows[19].max_drawdown_20d == pytest.approx(-50.0) and rows[20].max_drawdown_20d == 0.0


def test_whole_history_of_one_bar_and_of_more(spark):
    one = windows.whole_history(series(spark, [50])).first()
    assert one.annualized_volatility_pct == 0 and one.mean_daily_return_pct == 0 and one.total_return_pct == 0
    more = windows.whole_history(series(spark, [100, 110, 99])).first()
    assert more.max_drawdown_pct == pytest.approx(-10) and more.mean_daily_return_pct == pytest.approx(0) and more.annualized_volatility_pct == pytest.approx(10 * 252**0.5)


def test_price_status_and_last_bars(spark):
    frame = series(spark, [1, 2, 3]).unionByName(series(spark, [5, 6], "0002"))
    symbols = spark.createDataFrame([("0001",), ("0002",), ("0003",)], "symbol string")
    status = {r.symbol: (r.price_status, r.observations) for r in asof.price_status(symbols, frame, dt.date(2024, 1, 7)).collect()}
    assert status == {"0001": ("available", 3), "0002": ("market_date_mismatch", 2), "0003": ("missing_source", 0)}
    got = asof.last_bars_with_total(frame, dt.date(2024, 1, 7), 2).collect()
    assert {(r.symbol, r.close, r.rn, r.truncated) for r in got} == {("0001", 3.0, 1, True), ("0001", 2.0, 2, True), ("0002", 6.0, 1, False), ("0002", 5.0, 2, False)}
    assert asof.prices_as_of(frame, dt.date(2023, 1, 1)).count() == 0
    plan = asof.last_bars(frame, dt.date(2024, 1, 7), 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_valuations_carry_forward_and_ties_go_by_source(spark):
    d = dt.date
    rows = [("0001", d(2024, 1, 1), "pe", 1.0, "ratio", "a"), ("0001", d(2024, 1, 5), "pe", 2.0, "ratio", "a"), ("0001", d(2024, 1, 5), "pe", 3.0, "ratio", "b"), ("0001", d(2024, 2, 1), "pe", 9.0, "ratio", "a")]
    got = asof.valuations_as_of(spark.createDataFrame(rows, "symbol string, metric_date date, name string, value double, unit string, source string"), d(2024, 1, 20)).first()
    assert (got.value, got.source, got.metric_date) == (3.0, "b", d(2024, 1, 5))


def test_validation_run_is_the_newest_success_of_the_day(spark):
    d = dt.date(2024, 1, 5)
    rows = [("0001", d, "success", 1, "r1"), ("0001", d, "success", 2, "r2"), ("0001", d, "failed", 3, "r3"), ("0001", dt.date(2024, 1, 6), "success", 9, "r4")]
    runs = spark.createDataFrame(rows, "symbol string, market_date date, status string, created_at int, run_id string")
    assert asof.validation_run(runs, d).first().run_id == "r2" and asof.validation_run(runs, d, "r1").first().run_id == "r1"


def test_merged_history_marks_conflicts(spark):
    one, other = series(spark, [1, 2, 3]), series(spark, [2, 9, 4], start=dt.date(2024, 1, 4))
    got = {str(r.trade_date): (r.close, r.conflict) for r in asof.merged_history(one, other).collect()}
    assert got == {"2024-01-01": (1.0, False), "2024-01-04": (2.0, False), "2024-01-07": (3.0, True), "2024-01-10": (4.0, False)}


def test_previous_results_over_gaps(spark):
    d = lambda k: dt.date(2024, 1, k)
    rows = [("0001", d(1), "v1"), ("0001", d(2), "v2"), ("0001", d(9), "v1")]
    got = {r.market_date: (r.previous_date, r.comparison_status) for r in asof.previous_results(spark.createDataFrame(rows, "symbol string, market_date date, methodology string")).collect()}
    assert got == {d(1): (None, "previous_result_missing"), d(2): (None, "methodology_incompatible"), d(9): (d(1), "available")}


def test_days(spark):
    d = lambda k: dt.date(2024, 1, k)
    days = spark.createDataFrame([(d(k),) for k in (4, 5, 6, 8)], "day date")
    got = {r.day.day: (r.state, r.market_day) for r in asof.is_market_day(days, days.where("day = date'2024-01-08'"), d(5)).collect()}
    assert got == {4: ("before_latest", False), 5: ("on_latest", True), 6: ("weekend", False), 8: ("closed", False)}
    states = days.select(asof.market_day_state(F.col("day"), F.lit(None).cast("date")).alias("s"), asof.resolved_day(F.col("day"), F.lit(d(5))).alias("r")).collect()
    assert {r.s for r in states} == {"weekend", "latest_unavailable"} and [r.r for r in states] == [None, d(5), d(5), d(5)]
