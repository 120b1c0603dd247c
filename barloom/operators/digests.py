"""Digests by ranges of keys: where two tables differ, without reading both whole again.

A row's hash counts in the digest of its leaf, a range of keys, and in those of all wider ranges around it. Digests are sums,
so they are added up before they are shuffled, and a load changes them by what it adds less what it takes away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT, LEVELS = 16, 4


def row_hash(*columns: str) -> Column:
    """64 bits of the named columns as a number that sums don't overflow."""
    return F.xxhash64(*columns).cast("decimal(38,0)")


def digest_by(rows: DataFrame, keys: dict[str, Column], columns: list[str]) -> DataFrame:
    """(keys, rows, digest) of groups of rows, whatever their order."""
    return rows.select(*(c.alias(k) for k, c in keys.items()), row_hash(*columns).alias("_h")).groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("_h").alias("digest"))


def tree(rows: DataFrame, key: Column, width: int, columns: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(level, node, rows, digest): the leaves (level 0) are ranges of ``width`` of a whole-numbered ``key``, and a node of the
    next level is ``fanout`` of them."""
    leaves = digest_by(rows, {"node": F.floor(key / F.lit(width)).cast("long")}, columns)
    return _levelled(leaves, fanout, levels)


def _levelled(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("node") / F.lit(fanout**k)).cast("long").alias("node")) for k in range(levels)])
    return leaves.select(F.explode(steps).alias("at"), "rows", "digest").groupBy("at.level", "at.node").agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest"))


def changed(held: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """The digests after the rows behind ``gone`` were taken out and those behind ``come`` put in, both digests of the same
    shape; what has no rows left goes."""
    keys = [c for c in held.columns if c not in ("rows", "digest")]
    less = gone.select(*keys, (-F.col("rows")).alias("rows"), (-F.col("digest")).alias("digest"))
    summed = held.unionByName(less).unionByName(come).groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest"))
    return summed.where("rows <> 0 or digest <> 0")


def unlike(left: DataFrame, right: DataFrame) -> DataFrame:
    """The keys of digests that differ, or that only one side has."""
    keys = [c for c in left.columns if c not in ("rows", "digest")]
    other = right.select(*keys, F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    return left.join(other, keys, "full").where(~(F.col("rows").eqNullSafe(F.col("_rows")) & F.col("digest").eqNullSafe(F.col("_digest")))).select(*keys)


def differing_leaves(left: DataFrame, right: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(node) of the leaves in which two trees differ: from the top down, only nodes below ones that differ are compared."""
    at = lambda t, k: t.where(F.col("level") == k).select("node", "rows", "digest")
    found = unlike(at(left, levels - 1), at(right, levels - 1))
    for k in range(levels - 2, -1, -1):
        above = found.withColumnRenamed("node", "_above")
        under = lambda t: t.withColumn("_above", F.floor(F.col("node") / F.lit(fanout)).cast("long")).join(above, "_above", "left_semi").drop("_above")
        found = unlike(under(at(left, k)), under(at(right, k)))
    return found


def by_month(bars: DataFrame, columns: list[str]) -> DataFrame:
    """(symbol, month, rows, digest) of bars."""
    return digest_by(bars, {"symbol": F.col("symbol"), "month": F.trunc("trade_date", "month")}, ["trade_date", *columns])


def of_months(bars: DataFrame, months: DataFrame) -> DataFrame:
    """The bars of some (symbol, month)."""
    return bars.withColumn("month", F.trunc("trade_date", "month")).join(months, ["symbol", "month"], "left_semi").drop("month")
