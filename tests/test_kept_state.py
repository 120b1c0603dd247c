"""What is kept between loads: rings of bars, digests of ranges, sums of runs."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from barloom.operators import compare, digests, history, windows
from barloom.schemas import BARS, OHLCV
from barloom.sources import keyed_table
from barloom.streaming import day_by_day, rollups
from pyspark.sql import functions as F


def panel_bars(spark, n=300, symbols=("a", "b")):
    rows = []
    for s in symbols:
        for k in range(n):
            close = 50 + 10 * math.sin(k * (1 + len(s)) / 7 + ord(s[0])) + k / 50
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=k), close, close + 1, close - 1, close, 100 + k * 7 % 41, "primary"))
    return spark.createDataFrame(rows, BARS)


def told(df):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_days_one_by_one_give_the_figures_of_the_whole_history(spark, tmp_path):
    bars = panel_bars(spark)
    date = lambda k: F.lit(dt.date(2020, 1, 1) + dt.timedelta(days=k))
    light = bars.select("symbol", "trade_date", "close", "volume")
    want = windows.panel(light, drawdowns=(20, 60, 120, 250))
    first, rings, _ = day_by_day.advance(None, light.where(F.col("trade_date") < date(280)))
    assert told(first) == told(want.where(F.col("trade_date") < date(280)))
    assert rings.select(F.max(F.size("ring"))).first()[0] == day_by_day.KEPT
    day = light.where((F.col("trade_date") == date(280)) & (F.col("symbol") == "a"))
    got, after, late = day_by_day.advance(rings, day.unionByName(light.where(F.col("trade_date") == date(100))))
    assert told(got) == told(want.where((F.col("trade_date") == date(280)) & (F.col("symbol") == "a"))) and late.count() == 2
    assert [r.symbol for r in after.collect()] == ["a"]  # a row for each symbol that has news
    several, _, _ = day_by_day.advance(rings, light.where(F.col("trade_date") >= date(280)))
    assert told(several) == told(want.where(F.col("trade_date") >= date(280)))


def test_a_lost_batch_writes_the_same_again(spark, tmp_path):
    bars = panel_bars(spark, 40)
    incoming, rings, out = (str(tmp_path / x) for x in ("in", "rings", "out"))
    bars.where(F.dayofmonth("trade_date") < 20).where("trade_date < '2020-02-01'").write.parquet(incoming)
    day_by_day.indicators_by_day(spark, incoming, rings, out, str(tmp_path / "p")).awaitTermination()
    before, version = spark.read.parquet(out).count(), keyed_table.manifest(spark, rings)["version"]
    day_by_day.indicators_by_day(spark, incoming, rings, out, str(tmp_path / "q")).awaitTermination()  # batch 0 again
    assert spark.read.parquet(out).count() == before and keyed_table.manifest(spark, rings)["version"] == version


def test_trees_find_the_leaves_that_differ(spark):
    rows = spark.range(0, 40_000, 3).select(F.col("id").alias("k"), (F.col("id") * 7 % 101).alias("v"))
    other = rows.where("k <> 33").withColumn("v", F.when(F.col("k") == 21_000, 0).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(39_998, 5)], "k long, v long"))
    grow = lambda t: digests.tree(t, F.col("k"), 64, ["k", "v"], 4, 5)
    one, two = grow(rows), grow(other)
    found = lambda a, b: sorted(r.node for r in digests.differing_leaves(a, b, 4, 5).collect())
    assert found(one, two) == [0, 21_000 // 64, 39_998 // 64] and found(one, one) == []
    gone, come = rows.where("k in (33, 21000)"), other.where("k in (21000, 39998)")
    kept = digests.changed(one, grow(gone), grow(come))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, two.collect()))
    assert digests.changed(one, one, grow(rows.limit(0))).count() == 0
    negative = rows.withColumn("k", F.col("k") - 20_000)
    assert found(grow(negative), grow(negative.where("k <> -19997"))) == [-19_997 // 64]


def test_months_alike_are_not_compared(spark):
    left = panel_bars(spark, 200)
    right = left.withColumn("close", F.when((F.col("symbol") == "a") & (F.col("trade_date") == "2020-03-05"), 1.0).otherwise(F.col("close"))).where("not (symbol = 'b' and trade_date = '2020-05-02')")
    months = digests.unlike(digests.by_month(left, list(OHLCV)), digests.by_month(right, list(OHLCV)))
    assert sorted((r.symbol, r.month.month) for r in months.collect()) == [("a", 3), ("b", 5)]
    day = dt.date(2021, 1, 1)
    whole = compare.history_differences(compare.histories(left, right, day))
    pruned = compare.history_differences(compare.histories(digests.of_months(left, months), digests.of_months(right, months), day))
    assert told(whole) == told(pruned) and whole.count() == 1


@pytest.fixture
def screening(spark):
    runs = spark.createDataFrame([(f"r{k}", dt.date(2024, 1, 1 + k % 4), "v1" if k % 2 else "v2", "open" if k == 5 else "succeeded") for k in range(9)], "run_id string, market_date date, methodology string, status string")
    picks = [(f"r{k}", f"s{(k * j) % 5}", ("clean", "warning")[j % 2], ("canonical_complete", "reconciliation_pending")[j % 3 == 0], j % 3, j % 2) for k in range(9) for j in range(1, 4)]
    candidates = spark.createDataFrame(picks, "run_id string, symbol string, quality string, version_status string, supplemental long, discrepancies long")
    reasons = candidates.select("run_id", "symbol", F.lit("first").alias("stage"), F.col("quality").alias("code"), F.lit("m").alias("metric"))
    return runs, candidates, reasons


def test_sums_of_runs_equal_the_models_over_all_runs(spark, tmp_path, screening):
    runs, candidates, reasons = screening
    path = str(tmp_path / "sums")
    assert rollups.add_sealed(spark, path, candidates, reasons, runs.where("run_id in ('r1', 'r2', 'r5')")) == 2
    assert rollups.add_sealed(spark, path, candidates, reasons, runs.where("run_id in ('r1', 'r2', 'r5')")) == 0
    assert rollups.add_sealed(spark, path, candidates, reasons, runs.where("run_id <> 'r0'")) == 5
    late = runs.withColumn("status", F.lit("succeeded"))  # r5 is sealed after the others, r0 comes last
    assert rollups.add_sealed(spark, path, candidates, reasons, late) == 2
    held = keyed_table.current(spark, path)
    same = lambda a, b: told(a.select(sorted(a.columns))) == told(b.select(sorted(b.columns)))
    assert same(rollups.selections_per_symbol(held), history.selections_per_symbol(candidates, late))
    assert same(rollups.quality_frequency(held), history.quality_frequency(candidates, late))
    assert same(rollups.date_totals(held), history.date_totals(candidates, late))
    assert same(rollups.methodology_comparison(held, "v1", "v2"), history.methodology_comparison(candidates, late, "v1", "v2"))
    assert same(rollups.reason_frequency(held), history.reason_frequency(reasons, late).drop("position"))
