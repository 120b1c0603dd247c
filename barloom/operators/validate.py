"""Checks on rows and batches: each gives a reason beside the row, or the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import clean_symbol, clean_text, first_of, is_symbol, to_integer, to_number


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def bar_problem() -> Column:
    """Why a bar isn't valid, null if it is: prices finite and positive, high and low around them, volume not negative."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    return first_of(
        (~(_finite(o) & _finite(h) & _finite(lo) & _finite(c)), "price_not_finite"),
        (F.least(o, h, lo, c) <= 0, "price_not_positive"),
        (h < F.greatest(o, lo, c), "high_not_highest"),
        (lo > F.least(o, h, c), "low_not_lowest"),
        (v.isNull() | (v < 0), "volume_invalid"),
    )


def checked_bars(bars: DataFrame) -> DataFrame:
    return bars.withColumn("problem", bar_problem())


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def batch_problems(bars: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch_id, problem) of every batch: its rows all of its symbol, inside its range, its market date among them.

    One wrong row fails the batch. ``batches`` has batch_id, batch_symbol, start_date, end_date, market_date."""
    facts = bars.join(batches, "batch_id", "right").groupBy("batch_id").agg(
        F.count("trade_date").alias("n"),
        F.bool_and(F.col("symbol").eqNullSafe(F.col("batch_symbol"))).alias("own"),
        F.bool_and(F.coalesce(F.col("trade_date").between(F.col("start_date"), F.col("end_date")), F.lit(False))).alias("inside"),
        F.bool_or(F.coalesce(F.col("trade_date") == F.col("market_date"), F.lit(False))).alias("current"),
    )
    return facts.select("batch_id", first_of((F.col("n") == 0, "empty"), (~F.col("own"), "symbol_mismatch"), (~F.col("inside"), "date_out_of_range"), (~F.col("current"), "market_date_missing")).alias("problem"))


def price_class() -> Column:
    """Four zero prices mean there was no trade; some prices that aren't positive are an error."""
    prices = [F.col(x) for x in ("open", "high", "low", "close")]
    return F.when(F.greatest(*(F.abs(p) for p in prices)) == 0, "unavailable").when(F.least(*prices) <= 0, "malformed").otherwise("available")


def role_violations(rows: DataFrame, policy: dict[str, tuple[str, ...]]) -> DataFrame:
    """(symbol, role, source) of rows whose source their role doesn't allow, and symbols that mix made-up sources with real ones."""
    allowed = F.lit(False)
    for role, sources in policy.items():
        allowed = allowed | ((F.col("role") == role) & F.col("source").isin(*sources))
    wrong = rows.where(~F.coalesce(allowed, F.lit(False))).select("symbol", "role", "source").distinct().withColumn("problem", F.lit("source_not_allowed"))
    mixed = rows.groupBy("symbol").agg(F.bool_or(F.col("source").startswith("synthetic")).alias("a"), F.bool_or(~F.col("source").startswith("synthetic")).alias("b")).where("a and b")
    return wrong.unionByName(mixed.select("symbol", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("source"), F.lit("synthetic_mixed").alias("problem")))


def payload_violations(metrics: DataFrame) -> DataFrame:
    """Metrics whose status doesn't fit: available exactly if there are a value and a date."""
    there = F.col("value").isNotNull() & F.col("as_of_date").isNotNull()
    return metrics.where((F.col("status") == "available") != there)


def normalised(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars from text fields, and the rows that aren't bars with the reason."""
    typed = raw.select(
        clean_symbol(F.col("symbol")).alias("symbol"), F.btrim("trade_date").try_cast("date").alias("trade_date"),
        *(to_number(F.col(c)).alias(c) for c in ("open", "high", "low", "close")), to_integer(F.col("volume")).alias("volume"), clean_text(F.col("source")).alias("source"),
    )
    judged = typed.withColumn("problem", F.coalesce(F.when(~is_symbol(F.col("symbol")), "symbol_invalid"), F.when(F.col("trade_date").isNull(), "date_invalid"), F.when(F.col("source").isNull(), "source_blank"), bar_problem()))
    return judged.where("problem is null").drop("problem"), judged.where("problem is not null")
