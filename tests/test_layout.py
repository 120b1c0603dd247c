"""Tables in buckets by symbol: plans without a shuffle, and the same results."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from barloom.operators import asof, compare
from barloom.sources import layout, market, sinks
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DAY = dt.date(1997, 6, 2)


@pytest.fixture(scope="module")
def stored(spark):
    bars = market.bars(spark, SF).drop("top_discount", "supplier")
    names = [layout.write_bucketed(t, buckets=4) for t in (bars, market.second_bars(bars))]
    yield (bars, market.second_bars(bars), *(layout.bucketed(spark, n) for n in names))
    for n in names:
        layout.drop_bucketed(spark, n)


def shuffles(df) -> int:
    return len(re.findall(r"(?<!Broadcast)Exchange", df._jdf.queryExecution().executedPlan().toString()))


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sums_and_last_bars_read_the_buckets_as_they_lie(spark, stored):
    bars, _, one, _ = stored
    with layout.as_it_lies(spark):
        for step in (lambda t: t.groupBy("symbol").count(), lambda t: asof.last_bars(t, DAY, 20).select("symbol", "trade_date")):
            assert shuffles(step(one)) == 0 and shuffles(step(bars)) > 0
            assert told(step(one)) == told(step(bars))


def test_histories_meet_without_a_shuffle(spark, stored):
    bars, second, one, two = stored
    with layout.as_it_lies(spark):
        paired = compare.histories(one, two, DAY)
        assert shuffles(paired) == 0 and shuffles(compare.histories(bars, second, DAY)) > 0
        assert told(compare.history_summary(paired)) == told(compare.history_summary(compare.histories(bars, second, DAY)))
        assert told(compare.history_differences(paired)) == told(compare.history_differences(compare.histories(bars, second, DAY)))


def test_a_symbols_rows_are_in_one_bucket(spark, stored):
    one = stored[2]
    files = lambda t: {r[0] for r in t.select(F.input_file_name()).distinct().collect()}
    assert len(files(sinks.keyed_read(one, "0003", dt.date(1995, 1, 1)).select("symbol"))) == 1 < len(files(one))
    with layout.as_it_lies(spark):
        scan = sinks.keyed_read(one, "0003")._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 4" in scan
