"""Trailing indicators day by day: of each symbol only the last bars are kept, so a new day costs a row and a window a
symbol, however long its history is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.functions.session import durable
from barloom.operators import windows
from barloom.schemas import BARS
from barloom.sources import keyed_table, sinks
from barloom.streaming.incremental import _stream

KEPT = 250  #: bars before a new one that the longest window looks at
RING = "array<struct<trade_date:date,close:double,volume:bigint>>"


def advance(rings: DataFrame | None, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(indicators of the new bars, the rings after them, bars that came too late to count).

    ``rings`` has symbol, last_date and ring, the last bars in order; ``new`` has a bar per symbol and date, of any number
    of days. A bar that isn't after a symbol's last date changes nothing. Both the rings and the new
    bars go through ``windows.panel``, so the figures are those of a whole history."""
    bars = new.select("symbol", "trade_date", "close", "volume")
    if rings is None:
        fresh, late, held = bars, bars.where("1 = 0"), bars.where("1 = 0")
    else:
        known = bars.join(rings.select("symbol", "last_date"), "symbol", "left")
        after = F.col("last_date").isNull() | (F.col("trade_date") > F.col("last_date"))
        fresh, late = (known.where(c).drop("last_date") for c in (after, ~after))
        touched = rings.join(fresh.select("symbol").distinct(), "symbol", "left_semi")
        held = touched.select("symbol", F.inline("ring"))
    rows = held.withColumn("new", F.lit(False)).unionByName(fresh.withColumn("new", F.lit(True)))
    told = windows.panel(rows, drawdowns=(20, 60, 120, 250), keep=("new",)).where("new").drop("new")
    bar = F.struct("trade_date", "close", F.col("volume").cast("long").alias("volume"))
    ordered = F.array_sort(F.collect_list(bar))
    ring = rows.groupBy("symbol").agg(F.max("trade_date").alias("last_date"), F.slice(ordered, -F.least(F.size(ordered), F.lit(KEPT)), KEPT).cast(RING).alias("ring"))
    return told, ring, late


def indicators_by_day(spark: SparkSession, incoming: str, rings: str, out: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Appends the indicators of bars not seen before to ``out``, a folder for each batch, and keeps the rings in the
    table by key ``rings``. The rings are written last and say which batch they are after: a batch that was lost
    before is run again and writes the same, one that was lost after isn't run twice."""

    def batch(rows: DataFrame, number: int) -> None:
        held = sinks.stored_table(spark, rings)
        if held is not None and (held.agg(F.max("batch")).first()[0] or 0) >= number + 1:
            return
        once = durable(sinks.one_per_key(rows, ["symbol", "trade_date"], [F.desc("arrived_at"), F.desc("arrived_from")]))
        told, ring, _ = advance(held, once)
        told.write.mode("overwrite").parquet(f"{out}/batch={number}")
        bucket = F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")
        keyed_table.upsert(ring.withColumns({"batch": F.lit(number + 1).cast("long"), "bucket": bucket}), rings, ["symbol"], [], "bucket")

    return _stream(spark, incoming, BARS, checkpoint, batch, 1000)
