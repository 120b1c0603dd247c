"""Registered queries of what is kept between loads: rings of bars, digests of ranges, sums of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.session import durable, fresh_folder
from barloom.operators import compare, digests
from barloom.plans.panel import Panel, Query, shown
from barloom.schemas import OHLCV
from barloom.sources import keyed_table, layout, market
from barloom.streaming import day_by_day, rollups


def daily_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of every bar after three loads: the history up to the day before, the day, and all later ones; the last
    load has the day's bars of some symbols again, which come too late."""
    p = Panel(spark, sf_dir).at_hand()
    names = ("incoming", "rings", "indicators", "cursor")
    incoming, rings, out, point = (fresh_folder(spark, n) for n in names)
    date, day = F.col("trade_date"), F.lit(p.day)
    for part in (date < day, date == day, (date > day) | ((date == day) & (F.col("supplier") % 3 == 0))):
        p.bars.where(part).select("symbol", "trade_date", *OHLCV, "source").write.mode("append").parquet(incoming)
        day_by_day.indicators_by_day(spark, incoming, rings, out, point).awaitTermination()
    told = spark.read.parquet(out).drop("batch")
    return shown(told.select(*(c for c in told.columns if not c.startswith("max_drawdown"))))


def differing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of 1024 order keys in which two copies of the orders differ, found from the top of their trees down; some
    prices were changed, and some orders lack, in one of them."""
    orders = market.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_totalprice").cast("string").alias("price"))
    other = orders.where("k % 7001 <> 5").withColumn("price", F.when(F.col("k") % 9973 == 3, "0").otherwise(F.col("price")))
    columns = ["k", "o_custkey", "price"]
    one = digests.tree(orders, F.col("k"), 1024, columns)
    # the other side's digests are kept up from the load that changed it
    lost = digests.tree(orders.where("k % 7001 = 5 or k % 9973 = 3"), F.col("k"), 1024, columns)
    come = digests.tree(other.where("k % 9973 = 3"), F.col("k"), 1024, columns)
    return digests.differing_leaves(one, digests.changed(one, lost, come)).select((F.col("node") * 1024).alias("first_key"), (F.col("node") * 1024 + 1023).alias("last_key"))


def pruned_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences of two histories, of which only the months whose digests differ are compared bar by bar."""
    p = Panel(spark, sf_dir).at_hand()
    months = digests.unlike(digests.by_month(p.bars, list(OHLCV)), digests.by_month(p.second, list(OHLCV)))
    return shown(compare.history_differences(compare.histories(digests.of_months(p.bars, months), digests.of_months(p.second, months), p.day)))


def stored_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of two histories from tables stored in buckets by symbol: neither the last bars nor the comparison deals
    them again."""
    p = Panel(spark, sf_dir)
    left = p.bars.where(F.dayofmonth("trade_date") != 3)
    names = [layout.write_bucketed(t.select("symbol", "trade_date", *OHLCV), buckets=16) for t in (left, p.second)]
    with layout.as_it_lies(spark):
        out = durable(compare.history_summary(compare.histories(*(layout.bucketed(spark, n) for n in names), p.day, 250)))
    for n in names:
        layout.drop_bucketed(spark, n)
    return out


def _rolled(p: Panel) -> DataFrame:
    """Runs added in three batches, the second without news, and the third late ones."""
    from barloom.plans.queries import _runs

    runs, candidates, reasons = _runs(p)
    path, late = fresh_folder(p.spark, "rollups"), F.dayofmonth("market_date") % 3 == 0
    rollups.add_sealed(p.spark, path, candidates, reasons, runs.where(~late))
    rollups.add_sealed(p.spark, path, candidates, reasons, runs.where(~late))
    rollups.add_sealed(p.spark, path, candidates, reasons, runs)
    return keyed_table.current(p.spark, path)


def rolled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.quality_frequency(_rolled(Panel(spark, sf_dir)))


def rolled_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.methodology_comparison(_rolled(Panel(spark, sf_dir)), "v1", "v2")


def rolled_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.reason_frequency(_rolled(Panel(spark, sf_dir)))


ALL: tuple[Query, ...] = (daily_indicators, differing_ranges, pruned_differences, stored_summary, rolled_quality, rolled_comparison, rolled_reasons)
