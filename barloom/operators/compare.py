"""Comparing two sources field by field; neither is averaged into or written over the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import asof
from barloom.schemas import OHLCV

PRICE_FIELDS = ("open", "high", "low", "close", "volume")


def _fields(left: str, right: str) -> Column:
    """A row per field: both values as doubles."""
    one = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"{left}.{f}").cast("double").alias("left_value"), F.col(f"{right}.{f}").cast("double").alias("right_value"))
    return F.inline(F.array(*[one(f) for f in PRICE_FIELDS]))


def _differences(paired: DataFrame, keys: list[str]) -> DataFrame:
    rows = paired.select(*keys, _fields("l", "r")).where("left_value <> right_value")
    gap = F.abs(F.col("right_value") - F.col("left_value"))
    return rows.select(*keys, "field", "left_value", "right_value", F.when(F.col("field") == "volume", "volume_mismatch").otherwise("price_mismatch").alias("reason"), gap.alias("absolute_difference"), (F.try_divide(gap, F.abs(F.col("left_value"))) * 100).alias("relative_difference_pct"))


def latest_day(left: DataFrame, right: DataFrame, day) -> tuple[DataFrame, DataFrame]:
    """Each source's latest bar up to the day: outcomes per symbol, and the differing fields where the dates agree."""
    newest = lambda t: asof.prices_as_of(t, day).groupBy("symbol").agg(F.max("trade_date").alias("date"), F.max_by(F.struct(*OHLCV), "trade_date").alias("bar"))
    both = newest(left).toDF("symbol", "left_date", "l").join(newest(right).toDF("symbol", "right_date", "r"), "symbol", "full")
    agree = both.where(F.col("left_date") == F.col("right_date"))
    differences = _differences(agree, ["symbol"])
    n = differences.groupBy("symbol").agg(F.count("*").alias("differences"))
    outcome = F.when(F.col("left_date").isNull() | F.col("right_date").isNull(), "missing_source").when(F.col("left_date") != F.col("right_date"), "market_date_mismatch").when(F.coalesce("differences", F.lit(0)) > 0, "source_discrepancy").otherwise("match")
    return both.join(n, "symbol", "left").select("symbol", "left_date", "right_date", F.coalesce("differences", F.lit(0)).alias("differences"), outcome.alias("outcome")), differences


def histories(left: DataFrame, right: DataFrame, day, n: int | None = None) -> DataFrame:
    """The last n bars of both sources side by side, with who has which date."""
    cap = lambda t: asof.last_bars(t, day, n) if n else asof.prices_as_of(t, day)
    a = cap(left).select("symbol", "trade_date", F.struct(*OHLCV).alias("l"))
    b = cap(right).select("symbol", "trade_date", F.struct(*OHLCV).alias("r"))
    return a.join(b, ["symbol", "trade_date"], "full").withColumn("presence", F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("common"))


def history_differences(paired: DataFrame) -> DataFrame:
    return _differences(paired.where("presence = 'common'"), ["symbol", "trade_date"])


def history_summary(paired: DataFrame) -> DataFrame:
    """Per symbol: common, fully matched and one-sided dates, field differences, latest dates."""
    differing = sum(((F.col(f"l.{f}") != F.col(f"r.{f}")).cast("int") for f in PRICE_FIELDS), F.lit(0))
    rows = paired.select("symbol", "trade_date", "presence", F.when(F.col("presence") == "common", differing).alias("d"))
    per = lambda v: F.count_if(F.col("presence") == v)
    return rows.groupBy("symbol").agg(
        per("common").alias("common_dates"), F.count_if(F.col("d") == 0).alias("matched_dates"), per("left_only").alias("left_only_dates"), per("right_only").alias("right_only_dates"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("field_differences"),
        F.max(F.when(F.col("presence") != "right_only", F.col("trade_date"))).alias("left_latest"), F.max(F.when(F.col("presence") != "left_only", F.col("trade_date"))).alias("right_latest"),
    )


def differences_by_field(differences: DataFrame) -> DataFrame:
    return differences.groupBy("field").agg(F.count("*").alias("differences"))


def covered(left: DataFrame, right: DataFrame, day, n: int) -> DataFrame:
    """Whether both sides have exactly n rows; a comparison needs that."""
    count = lambda t, c: asof.last_bars(t, day, n).groupBy("symbol").agg(F.count("*").alias(c))
    both = count(left, "left_rows").join(count(right, "right_rows"), "symbol", "full").select("symbol", F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows"))
    return both.withColumn("covered", (F.col("left_rows") == n) & (F.col("right_rows") == n))


def timestamp_state(left: Column, right: Column) -> Column:
    return F.when(left.isNull() | right.isNull(), "missing").when(left == right, "match").otherwise("mismatch")


def shown(value: Column) -> Column:
    """A double as text with 15 significant digits, for display only."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.15g", value), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
