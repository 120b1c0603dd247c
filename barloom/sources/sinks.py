"""Parquet and JSON sinks: a key is written once and never again, or the last write of a key wins (``keyed_table``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.keyed_table import current, latest_wins, one_per_key, upsert

__all__ = ["insert_once", "keyed_read", "latest_wins", "one_per_key", "stored_table", "upsert", "write_report", "write_universe"]


def stored_table(spark, path: str) -> DataFrame | None:
    """The table at ``path``, of keys or of plain Parquet, none before its first load."""
    keyed = current(spark, path)
    if keyed is not None:
        return keyed
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def insert_once(new: DataFrame, old: DataFrame | None, keys: list[str], payload: str = "payload_sha256") -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): a known key with the same payload is nothing to do; a key with two payloads,
    stored or in the load itself, is a conflict, and none of its rows is appended."""
    each = new.select(*keys, payload)
    each = each.unionByName(old.select(*keys, payload)) if old is not None else each
    differ = each.groupBy(*keys).agg(F.count_distinct(F.struct(payload)).alias("n")).where("n > 1").select(*keys)
    once = new.join(differ, keys, "left_anti").dropDuplicates([*keys, payload])
    return (once.join(old.select(*keys), keys, "left_anti") if old is not None else once), new.join(differ, keys, "left_semi")


def keyed_read(table: DataFrame, symbol: str | None = None, start=None, end=None) -> DataFrame:
    """Rows of a symbol in an inclusive range of dates, in order; all filters reach the scan."""
    rows = table.where(F.col("symbol") == symbol) if symbol is not None else table
    rows = rows.where(F.col("trade_date") >= F.lit(start)) if start is not None else rows
    rows = rows.where(F.col("trade_date") <= F.lit(end)) if end is not None else rows
    return rows.orderBy("symbol", "trade_date")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_universe(members: DataFrame, day, path: str, parts: int = 16) -> None:
    """A day's universe as JSON documents, each with a part of the members in order, so that none is gathered whole."""
    member = F.struct("symbol", "name", "status", "reason")
    split = members.select(F.pmod(F.xxhash64("symbol"), F.lit(parts)).alias("part"), member.alias("m")).groupBy("part").agg(F.array_sort(F.collect_list("m")).alias("members"))
    split.select(F.lit(day).alias("market_date"), "members").write.mode("append").json(path)
