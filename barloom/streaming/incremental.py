"""Incremental loads as Structured Streaming over files; the checkpoint is the cursor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.functions.session import durable
from barloom.operators import versions as v
from barloom.schemas import BARS
from barloom.sources import sinks

BUCKETS = 64  #: of a store of versions, by symbol


def _stream(spark: SparkSession, incoming: str, schema: str, checkpoint: str, batch: Callable[[DataFrame, int], None], per_trigger: int) -> StreamingQuery:
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(incoming)
    source = source.select("*", F.col("_metadata.file_modification_time").alias("arrived_at"), F.col("_metadata.file_path").alias("arrived_from"))
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backfill(spark: SparkSession, incoming: str, table: str, checkpoint: str, per_trigger: int = 10, target_rows: int | None = None, max_months: int | None = None) -> StreamingQuery:
    """Loads the files of bars not seen before into ``table``, keyed by symbol, date and source, and stops; the bar
    that arrived last wins.

    With ``target_rows`` a symbol takes no more once it has so many bars, and with ``max_months`` once it has
    bars of so many months; a symbol is looked at before each batch of ``per_trigger`` files."""

    def load(rows: DataFrame, _: int) -> None:
        held = sinks.stored_table(spark, table)
        if held is not None and (target_rows or max_months):
            full = backfill_state(held, target_rows, max_months).where("state <> 'pending'")
            rows = rows.join(full.select("symbol"), "symbol", "left_anti")
        keyed = rows.withColumn("month", F.date_format("trade_date", "yyyy-MM"))
        sinks.upsert(keyed, table, ["symbol", "trade_date", "source"], ["arrived_at", "arrived_from"], "month")

    return _stream(spark, incoming, BARS, checkpoint, load, per_trigger)


def backfill_state(table: DataFrame, target_rows: int | None, max_months: int | None) -> DataFrame:
    """(symbol, bars, months, state): complete with enough bars, out of months with too few after too many, else pending."""
    per = table.groupBy("symbol").agg(F.count_distinct("trade_date").alias("bars"), F.count_distinct(F.date_format("trade_date", "yyyy-MM")).alias("months"))
    enough = F.col("bars") >= target_rows if target_rows else F.lit(False)
    over = F.col("months") >= max_months if max_months else F.lit(False)
    return per.withColumn("state", F.when(enough, "complete").when(over, "out_of_months").otherwise("pending"))


def backfill_by_month(
    spark: SparkSession, incoming: str, table: str, waiting: str, cursor: str, checkpoint: str, target_date, target_rows: int = 250, max_months: int = 18, per_trigger: int = 10
) -> StreamingQuery:
    """Fills ``table`` symbol by symbol from the month of ``target_date`` backwards, a month at a time, as far as files of
    bars have come, until a symbol has ``target_rows`` bars or has taken ``max_months``: it stops there within a
    batch, however many months the batch has.

    ``cursor`` keeps each (symbol, month) taken; a month that lacks holds a symbol up, and later ones
    wait in ``waiting``. A month that was taken isn't taken again. All three are tables by key, and the cursor is
    written last, so a batch that is lost is run again with the same result."""

    def load(rows: DataFrame, _: int) -> None:
        due = rows.where(F.col("trade_date") <= F.lit(target_date)).withColumn("month", F.trunc("trade_date", "month"))
        taken = sinks.stored_table(spark, cursor)
        if taken is not None:
            ended = month_cursors(taken, target_date, target_rows, max_months).where("state <> 'pending'")
            due = due.join(taken.select("symbol", "month"), ["symbol", "month"], "left_anti").join(ended.select("symbol"), "symbol", "left_anti")
        sinks.upsert(due, waiting, ["symbol", "trade_date", "source"], ["arrived_at", "arrived_from"], "month")
        held = sinks.stored_table(spark, waiting)
        next_ = durable(next_months(held, taken, target_date, target_rows, max_months))
        sinks.upsert(held.join(next_.select("symbol", "month"), ["symbol", "month"], "left_semi"), table, ["symbol", "trade_date", "source"], [], "month")
        sinks.upsert(next_.withColumn("year", F.year("month")), cursor, ["symbol", "month"], [], "year")

    return _stream(spark, incoming, BARS, checkpoint, load, per_trigger)


def month_cursors(taken: DataFrame, target_date, target_rows: int, max_months: int) -> DataFrame:
    """(symbol, bars, months, next_month, state) from the months taken (symbol, month, bars): complete with enough bars, out
    of months with too few after too many, else pending at next_month."""
    per = taken.groupBy("symbol").agg(F.sum("bars").alias("bars"), F.count("*").alias("months"))
    next_month = F.add_months(F.trunc(F.lit(target_date), "month"), -F.col("months").cast("int"))
    return per.select("symbol", "bars", "months", next_month.alias("next_month"), F.when(F.col("bars") >= target_rows, "complete").when(F.col("months") >= max_months, "out_of_months").otherwise("pending").alias("state"))


def next_months(held: DataFrame, taken: DataFrame | None, target_date, target_rows: int, max_months: int) -> DataFrame:
    """(symbol, month, bars) of the months of ``held`` that are to be taken next: without a gap from a symbol's cursor
    backwards, as long as there are too few bars and not too many months."""
    months = held.groupBy("symbol", "month").agg(F.count_distinct("trade_date").alias("bars"))
    start = F.trunc(F.lit(target_date), "month")
    if taken is None:
        at = months.withColumns({"had": F.lit(0).cast("long"), "done": F.lit(0).cast("long")})
    else:
        cursors = month_cursors(taken, target_date, target_rows, max_months).select("symbol", F.col("bars").alias("had"), F.col("months").alias("done"))
        at = months.join(taken.select("symbol", "month"), ["symbol", "month"], "left_anti").join(cursors, "symbol", "left").fillna(0, ["had", "done"])
    back = Window.partitionBy("symbol").orderBy(F.desc("month"))
    before = F.col("had") + F.coalesce(F.sum("bars").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("done") + F.row_number().over(back) - 1  # months taken before this one, if none lacks
    ready = at.withColumns({"before": before, "place": place}).where((F.col("month") == F.add_months(start, -F.col("place").cast("int"))) & (F.col("before") < target_rows) & (F.col("place") < max_months))
    return ready.select("symbol", "month", "bars")


def store_versions(made: DataFrame, rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Appends versions and their observations to a store in ``buckets`` by symbol, in files of a fitting size."""
    bucket = F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")
    for part, name in ((rows, "observations"), (made, "versions")):  # a version is there only after its rows
        part.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/{name}")


def stored_versions(spark: SparkSession, path: str, buckets: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(versions, observations) of a store, or of some of its buckets: files of others aren't listed."""
    made, rows = (spark.read.parquet(f"{path}/{name}") for name in ("versions", "observations"))
    return tuple((t if buckets is None else t.where(F.col("bucket").isin(buckets))).drop("bucket") for t in (made, rows))


def reconcile_arrivals(spark: SparkSession, incoming: str, store: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Canonical bars that arrive late open child versions of the provisional ones they resolve, of each target date.

    A batch reads only the buckets that its symbols are in; as each counts on from its parent, it needs
    neither other versions nor the required dates. A child's id comes from its content, and known ids are left
    out, so a batch that runs twice adds nothing; bars on which a reconciled version rests change nothing."""

    def resolve(rows: DataFrame, _: int) -> None:
        once = durable(sinks.one_per_key(rows, ["symbol", "trade_date"], [F.desc("arrived_at"), F.desc("arrived_from")]))
        asked = [r[0] for r in once.select(F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")).distinct().collect()]
        if not asked:
            return
        known, held = stored_versions(spark, store, asked)
        tips = v.leaves(known).where("leaf_state = 'open'").select("version_id")
        children, child_rows = v.reconcile(known.join(tips, "version_id", "left_semi"), held, once)
        fresh = durable(children.join(known.select("version_id"), "version_id", "left_anti").select(known.columns))
        unwritten = child_rows.join(fresh.select("version_id"), "version_id", "left_semi").join(held.select("version_id").distinct(), "version_id", "left_anti")
        store_versions(fresh, unwritten.select(held.columns), store, buckets)

    return _stream(spark, incoming, BARS, checkpoint, resolve, 1000)


def replay(spark: SparkSession, incoming: str, schema: str, table: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends results whose key isn't stored yet; a finished key keeps its stored result, and of results of one
    key in a batch the first to arrive is stored."""

    def append(rows: DataFrame, _: int) -> None:
        known = sinks.stored_table(spark, table)
        once = sinks.one_per_key(rows, keys, [F.asc("arrived_at"), F.asc("arrived_from")]).drop("arrived_at", "arrived_from")
        (once if known is None else once.join(known.select(*keys), keys, "left_anti")).write.mode("append").parquet(table)

    return _stream(spark, incoming, schema, checkpoint, append, 1000)
