"""The universe of a day: every symbol that any feed names, with one status and one reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import first_of


def enumerated(*feeds: DataFrame) -> DataFrame:
    """Symbols of the feeds, once each; delistings never add any."""
    every = feeds[0].select("symbol")
    for f in feeds[1:]:
        every = every.union(f.select("symbol"))
    return every.distinct()


def merged(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A feed with equal duplicates made one, a row per symbol, and the symbols whose duplicates differ; of those
    the least row stays."""
    rest = [c for c in feed.columns if c != "symbol"]
    row = F.struct(*rest) if rest else F.lit(True)
    per = feed.groupBy("symbol").agg(F.min(row).alias("row"), (F.max(row) != F.min(row)).alias("differ"))
    once = per.select("symbol", "row.*") if rest else per.select("symbol")
    return once, per.where("differ").select("symbol")


def conflicts(feeds: dict[str, DataFrame]) -> DataFrame:
    """(symbol, feed) of feeds that contradict themselves on a symbol."""
    every = None
    for name, feed in feeds.items():
        found = merged(feed)[1].withColumn("feed", F.lit(name))
        every = found if every is None else every.unionByName(found)
    return every


def members(feeds: dict[str, DataFrame], day) -> DataFrame:
    """(symbol, name, status, reason), one row a symbol, decided by the first case that applies. A symbol that a
    feed contradicts itself on is unresolved whatever else is known; ``conflicts`` says where."""
    every, said = None, {}
    for key, feed in feeds.items():  # all feeds under each other, each in a column of its own: one aggregate per symbol
        said[key] = [c for c in feed.columns if c != "symbol"]
        rows = feed.select("symbol", F.struct(*said[key], F.lit(True).alias("has")).alias(key))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    differ = [F.coalesce(F.max(k) != F.min(k), F.lit(False)) for k in feeds]
    per = every.groupBy("symbol").agg(*(F.min(k).alias(k) for k in feeds), F.array_contains(F.array(*differ), True).alias("contradicted"))
    named = per.where(F.coalesce("identity.has", "trading.has", "valuation.has", "classification.has").isNotNull())  # delistings never add any
    out = named.select("symbol", "contradicted", *(F.col(f"{k}.{c}").alias(f"{k}_{c}") for k, cs in said.items() for c in cs), *(F.col(f"{k}.has").alias(f"has_{k}") for k in feeds))
    names = F.array_compact(F.array("identity_name", "trading_name", "valuation_name", "delisting_name"))
    has = lambda k: F.col(f"has_{k}").isNotNull()
    kind = F.col("classification_class")
    state = first_of(
        (F.col("contradicted"), _state("classification_unresolved", "feed_conflict")),
        (F.size(F.array_distinct(names)) > 1, _state("classification_unresolved", "identity_conflict")),
        (F.col("identity_listing_date") > F.lit(day), _state("classification_unresolved", "listing_after_day")),
        (F.col("delisting_delisting_date") <= F.lit(day), _state("inactive", "delisted")),
        (~has("classification"), _state("classification_unresolved", "classification_missing")),
        (kind == "unknown", _state("classification_unresolved", "classification_unknown")),
        (kind == "etf", _state("excluded_non_common_equity", "etf")),
        (kind == "tdr", _state("excluded_non_common_equity", "tdr")),
        (~has("identity"), _state("classification_unresolved", "identity_missing")),
        (~has("trading") & ~has("valuation"), _state("active_scan_unavailable", "both_feeds_missing")),
        (~has("trading"), _state("active_scan_unavailable", "trading_missing")),
        (~F.col("trading_price_available"), _state("active_scan_unavailable", "price_unavailable")),
        (~has("valuation"), _state("active_scan_unavailable", "valuation_missing")),
        otherwise=_state("active_scan_eligible", None),
    )
    return out.select("symbol", F.coalesce("identity_name", "trading_name", "valuation_name", "delisting_name").alias("name"), state.alias("s")).select("symbol", "name", "s.status", "s.reason")


def _state(status: str, reason: str | None) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))


def status_counts(of: DataFrame) -> DataFrame:
    names = ("active_scan_eligible", "active_scan_unavailable", "excluded_non_common_equity", "inactive", "classification_unresolved")
    return of.agg(F.count("*").alias("universe_count"), *(F.count_if(F.col("status") == n).alias(n) for n in names))


def assigned_classes(previous: DataFrame, identity: DataFrame) -> DataFrame:
    """Known funds and receipts stay; who is listed is common stock; the rest keeps its class or is unknown."""
    both = previous.select("symbol", F.col("class").alias("old")).join(identity.select("symbol", F.lit(True).alias("listed")), "symbol", "full")
    return both.select("symbol", F.when(F.col("old").isin("etf", "tdr"), F.col("old")).when(F.col("listed"), "common_stock").otherwise(F.coalesce("old", F.lit("unknown"))).alias("class"))


def feed_date_agrees(feed: DataFrame, day, column: str = "trade_date") -> DataFrame:
    return feed.agg(F.coalesce(F.min(column).eqNullSafe(F.lit(day)) & F.max(column).eqNullSafe(F.lit(day)), F.lit(False)).alias("agrees"))


def watchlist_revision(symbols: DataFrame, revision: int) -> DataFrame:
    """The active symbols, frozen under a revision."""
    return symbols.where("is_active").select(F.lit(revision).alias("revision"), "symbol", "name")
