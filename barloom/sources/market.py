"""Panel tables derived from the order tables: bars of two sources, valuations, symbols and feeds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


PART_DIGITS, PRICE_DIGITS = 12, 11  #: of parts and of prices in cents, beside those of a line's place


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: what ``code`` gives: four digits, and more for suppliers from 10,000 on
CODES = "[0-9]{4,}"


def code(number: str) -> F.Column:
    return F.when(F.col(number).between(0, 9999), F.lpad(F.col(number).cast("string"), 4, "0")).when(F.col(number) > 9999, F.col(number).cast("string")).otherwise(F.format_string("%04d", F.col(number)))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: a symbol per supplier, a price per line of an order, in the order of the lines.

    Lines are added up before they are shuffled, so a supplier with a third of all lines is no more than a bar a
    day from each task. What looks at a symbol's history deals the bars again, by symbol: a row a day at most."""
    cents = F.floor(F.lit(10000) + F.lit(5000) * F.col("l_discount") + F.col("l_extendedprice") / 1000).cast("long")
    # a line's place and its price in one number, so that the first and the last price are a least and a greatest value,
    # for which Spark adds up by hashing; numbers over these widths are an error, not another order
    wide = lambda n: F.lit(10**n).cast(f"decimal({n + 1},0)")
    line = (F.col("l_orderkey").cast("decimal(13,0)") * F.lit(8).cast("decimal(1,0)") + F.col("l_linenumber").cast("decimal(1,0)")).cast("decimal(14,0)")
    placed = ((line * wide(PART_DIGITS) + F.col("l_partkey").cast(f"decimal({PART_DIGITS},0)")).cast("decimal(26,0)") * wide(PRICE_DIGITS) + F.col("cents").cast(f"decimal({PRICE_DIGITS},0)")).cast("decimal(37,0)")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").cast("date").alias("trade_date"), "l_quantity", "l_discount", "l_orderkey", "l_linenumber", "l_partkey", cents.alias("cents"))
    daily = lines.select("*", placed.alias("placed")).groupBy("supplier", "trade_date").agg(
        F.min("placed").alias("first"), F.max("placed").alias("last"), F.max("cents").alias("high"), F.min("cents").alias("low"), F.sum("l_quantity").cast("long").alias("volume"), F.max("l_discount").alias("top_discount")
    )
    price = lambda c: ((F.col(c) % wide(PRICE_DIGITS)).cast("long") / 100).alias({"first": "open", "last": "close"}[c])
    return daily.select(code("supplier").alias("symbol"), "trade_date", price("first"), (F.col("high") / 100).alias("high"), (F.col("low") / 100).alias("low"), price("last"), "volume", F.lit("primary").alias("source"), "top_discount", "supplier")


def second_bars(first: DataFrame) -> DataFrame:
    """The second source: no rows on the 13th, other volumes on the 28th, other closes on the 27th."""
    day = F.dayofmonth("trade_date")
    moved = F.when(day == 27, 0.01).otherwise(0.0)
    return first.where(day != 13).select(
        "symbol", "trade_date", "open", (F.col("high") + moved).alias("high"), "low", (F.col("close") + moved).alias("close"),
        (F.col("volume") + F.when(day == 28, 1000).otherwise(0)).alias("volume"), F.lit("secondary").alias("source"),
    )


def valuations(first: DataFrame) -> DataFrame:
    """Ratios in long form; price to earnings is missing on some days."""
    pe = F.when((F.col("supplier") + F.dayofmonth("trade_date")) % 11 != 0, F.col("close") / (1 + F.col("supplier") % 7))
    wide = first.select("symbol", F.col("trade_date").alias("metric_date"), pe.alias("price_earnings_ratio"), (F.col("close") / 50).alias("price_to_book_ratio"), (100 * F.col("top_discount")).alias("dividend_yield_pct"))
    long = wide.unpivot(["symbol", "metric_date"], ["price_earnings_ratio", "price_to_book_ratio", "dividend_yield_pct"], "name", "value").where("value is not null")
    return long.withColumn("unit", F.when(F.col("name") == "dividend_yield_pct", "%").otherwise("ratio")).withColumn("source", F.lit("primary"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = supplier.join(F.broadcast(nation.select("n_nationkey", "n_name")), supplier["s_nationkey"] == nation["n_nationkey"])  # a nation table has 25 rows
    return joined.select(code("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.col("n_name").alias("market"), F.lit("TWD").alias("currency"), (F.col("s_acctbal") >= 0).alias("is_active"), F.col("s_suppkey").alias("supplier"))


def best_dates(panel: DataFrame, since: str = "2000-06-01") -> tuple:
    """The date from ``since`` on with most symbols, the latest of equals, and the date before it; None without any.

    As many counts as there are dates from ``since`` on come to the driver; dates before are looked at only if the date
    before the best is none of those."""
    late = panel.where(F.col("trade_date") >= F.lit(dt.date.fromisoformat(since)))
    counts = {r.trade_date: r.n for r in late.groupBy("trade_date").agg(F.count("*").alias("n")).collect()}
    best = max(((n, d) for d, n in counts.items()), default=(0, None))[1]
    before = max((d for d in counts if d < best), default=None) if best else None
    if best and before is None:
        before = panel.where(F.col("trade_date") < F.lit(best)).agg(F.max("trade_date")).first()[0]
    return best, before


def feeds(names: DataFrame, panel: DataFrame, day) -> dict[str, DataFrame]:
    """What a universe is built from, as of ``day``: identity, trading, valuation, classification, delisting.

    Some rows come twice, some contradict themselves, some names differ between feeds and some are listed later."""
    key = F.col("supplier")
    kind = F.when(key % 13 == 5, "etf").when(key % 17 == 3, "tdr").when(key % 19 == 7, "unknown").otherwise("common_stock")
    today = panel.where(F.col("trade_date") == F.lit(day)).select("symbol").join(names.select("symbol", "name", "supplier"), "symbol")
    listed = F.when(key % 43 == 8, F.date_add(F.lit(day), 30)).otherwise(F.lit("1990-01-01").cast("date"))
    copies = F.explode(F.when(key % 47 == 9, F.array(F.lit(""), F.lit(" B"))).when(key % 7 == 0, F.array(F.lit(""), F.lit(""))).otherwise(F.array(F.lit("")))).alias("mark")
    identity = names.where(key % 10 != 9).select("symbol", "name", listed.alias("listing_date"), copies)
    return {
        "identity": identity.select("symbol", F.concat("name", "mark").alias("name"), "listing_date"),
        "trading": today.select("symbol", F.when(key % 41 == 6, F.concat("name", F.lit(" X"))).otherwise(F.col("name")).alias("name"), (key % 29 != 1).alias("price_available")),
        "valuation": today.where(key % 31 != 2).select("symbol", "name"),
        "classification": names.where(key % 37 != 4).select("symbol", kind.alias("class")),
        "delisting": names.where(key % 23 == 11).select("symbol", "name", F.lit("1999-01-01").cast("date").alias("delisting_date")),
    }
