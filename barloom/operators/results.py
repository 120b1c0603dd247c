"""Daily results per symbol: metrics with a status, their quality, and what changed since the result before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import content_id, first_of, settled
from barloom.operators import asof
from barloom.operators.windows import panel
from barloom.schemas import VALUATIONS

# The metrics of a result in their order, with their units.
METRICS = {
    "latest_close": "TWD", "latest_volume": "shares", "return_20d": "percentage_points", "return_60d": "percentage_points", "return_120d": "percentage_points",
    "volatility_60d": "percentage_points", "max_drawdown_20d": "percentage_points", "max_drawdown_60d": "percentage_points", "max_drawdown_120d": "percentage_points",
    "volume_ratio_20d": "ratio", "volume_anomaly": "state", "ma_distance_20d": "percentage_points", "ma_distance_60d": "percentage_points", "ma_distance_120d": "percentage_points",
}
#: metrics whose changes are told; the latest close and volume change every day
CHANGING = tuple(m for m in METRICS if not m.startswith("latest_"))
# Thresholds of a change worth telling, by the beginning of the metric's name.
CHANGE_THRESHOLDS = {"return_": 1.0, "volatility_": 1.0, "max_drawdown_": 1.0, "ma_distance_": 1.0, "volume_ratio_": 0.25}


def _wide(bars: DataFrame) -> DataFrame:
    """A column per metric on every date of every symbol, from the whole history up to it."""
    w = panel(bars, (20, 60, 120), drawdowns=(20, 60, 120), keep=("close", "volume"))
    full = F.col("volatility_observations") >= 60
    made = {"latest_close": F.col("close"), "latest_volume": F.col("volume").cast("double"), "volatility_60d": F.when(full, F.col("volatility_60d")), "volume_anomaly": F.nullif("volume_state", F.lit("insufficient"))}
    return w.select("symbol", "trade_date", *(made.get(m, F.col(m)).alias(m) for m in METRICS))


def _long(wide: DataFrame, status: Column, *keys: str) -> DataFrame:
    """A row per metric of (keys, trade_date), null values being a short history where ``status`` is available."""
    structs = []
    for m, unit in METRICS.items():
        number = F.lit(None).cast("double") if m == "volume_anomaly" else settled(F.col(m))
        text = F.col(m) if m == "volume_anomaly" else F.lit(None).cast("string")
        known = F.when(status != "available", status).when(F.col(m).isNull(), "insufficient_history").otherwise("available")
        ok = known == "available"
        structs.append(F.struct(F.lit(m).alias("metric"), known.alias("status"), F.when(ok, number).alias("value"), F.when(ok, text).alias("state"), F.lit(unit).alias("unit"), F.when(ok, F.col("trade_date")).alias("as_of_date")))
    return wide.select(*keys, F.inline(F.array(*structs)))


def daily(bars: DataFrame, methodology: str = "v1") -> DataFrame:
    """(result_id, symbol, market_date, methodology, metric, status, value, state, unit, as_of_date): the fourteen
    metrics of every symbol on every date that it has a bar."""
    keyed = _wide(bars).withColumn("market_date", F.col("trade_date"))
    long = _long(keyed, F.lit("available"), "symbol", "market_date")
    return long.select(result_id(methodology).alias("result_id"), "symbol", "market_date", F.lit(methodology).alias("methodology"), "metric", "status", "value", "state", "unit", "as_of_date")


def daily_as_of(symbols: DataFrame, bars: DataFrame, day) -> DataFrame:
    """The fourteen metrics of every symbol as of one day: where its last bar isn't the day's, that is their status."""
    known = asof.prices_as_of(bars, day)
    last = _wide(known).withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))).where("rn = 1").drop("rn")
    status = asof.price_status(symbols, known, day).select("symbol", "price_status")
    return _long(status.join(last, "symbol", "left"), F.col("price_status"), "symbol")


def result_id(methodology: str) -> Column:
    """Of a symbol's result of a day by a methodology: the same however often it is computed."""
    return F.concat(F.lit("daily-"), content_id(F.upper(F.btrim("symbol")), F.col("market_date"), F.lit(methodology), length=32))


def changes(results: DataFrame) -> DataFrame:
    """What changed against the result before of the same methodology: a status, the state of the volume, or a
    value by the metric's threshold."""
    before = Window.partitionBy("symbol", "methodology", "metric").orderBy("market_date")
    back = [F.lag(c).over(before).alias(f"previous_{n}") for c, n in (("market_date", "date"), ("status", "status"), ("value", "value"), ("state", "state"))]
    rows = results.where(F.col("metric").isin(*CHANGING)).select("symbol", "methodology", "metric", "market_date", "status", "value", "state", "unit", *back)
    limit = first_of(*((F.col("metric").startswith(k), F.lit(v)) for k, v in CHANGE_THRESHOLDS.items()))
    delta, kind = _change(F.col("status"), F.col("previous_status"), F.col("value"), F.col("previous_value"), F.col("state"), F.col("previous_state"), limit)
    told = rows.where("previous_date is not null").withColumn("delta", delta).withColumn("change", kind).where("change is not null")
    return told.select("symbol", "methodology", "metric", "previous_date", "market_date", "previous_status", "status", "previous_value", "value", "previous_state", "state", "delta", "unit", "change")


def _change(status: Column, before: Column, value: Column, value_before: Column, state: Column, state_before: Column, limit: Column) -> tuple[Column, Column]:
    """By how much a value moved, and the kind of change, null for none."""
    delta = settled(value - value_before)
    known = status == "available"
    kind = F.when(status != before, "availability_changed").when(known & (state != state_before), "volume_anomaly_state_changed").when(known & (F.abs(delta) >= limit), "metric_changed")
    return delta, kind


def history_changes(bars: DataFrame, methodology: str = "v1") -> DataFrame:
    """``changes`` of ``daily`` results, straight from bars: all metrics of a date are compared with those of the date
    before in one row, so what is sorted is a row a date and only changes become rows."""
    wide = _wide(bars).select("symbol", "trade_date", F.struct(*(settled(F.col(m)).alias(m) if m != "volume_anomaly" else F.col(m) for m in CHANGING), "trade_date").alias("now"))
    rows = wide.withColumn("then", F.lag("now").over(Window.partitionBy("symbol").orderBy("trade_date"))).where("then is not null")
    each = []
    for m in CHANGING:
        now, then = F.col("now")[m], F.col("then")[m]
        status = lambda c: F.when(c.isNull(), "insufficient_history").otherwise("available")
        number = lambda c: F.lit(None).cast("double") if m == "volume_anomaly" else c  # noqa: B023, E731
        text = lambda c: c if m == "volume_anomaly" else F.lit(None).cast("string")  # noqa: B023, E731
        limit = F.lit(next((v for k, v in CHANGE_THRESHOLDS.items() if m.startswith(k)), None)).cast("double")
        delta, kind = _change(status(now), status(then), number(now), number(then), text(now), text(then), limit)
        each.append(F.struct(F.lit(m).alias("metric"), F.col("then")["trade_date"].alias("previous_date"), F.col("trade_date").alias("market_date"), status(then).alias("previous_status"), status(now).alias("status"), number(then).alias("previous_value"), number(now).alias("value"), text(then).alias("previous_state"), text(now).alias("state"), delta.alias("delta"), F.lit(METRICS[m]).alias("unit"), kind.alias("change")))
    told = F.filter(F.array(*each), lambda c: c["change"].isNotNull())
    return rows.select("symbol", F.lit(methodology).alias("methodology"), F.inline(told))


def state_changes(states: DataFrame, column: str) -> DataFrame:
    """Rows on which a state differs from the one before, nulls included."""
    before = Window.partitionBy("symbol").orderBy("market_date")
    rows = states.select("symbol", "market_date", F.col(column).alias("state"), F.lag(column).over(before).alias("previous_state"), F.row_number().over(before).alias("k"))
    return rows.where((F.col("k") > 1) & ~F.col("state").eqNullSafe(F.col("previous_state"))).drop("k")


def daily_valuations(days: DataFrame, metrics: DataFrame) -> DataFrame:
    """(symbol, market_date, name, status, value, as_of_date): the three ratios of every (symbol, market_date) of
    ``days``, each carried forward from the latest date that has it."""
    known = metrics.where(F.col("name").isin(*VALUATIONS)).groupBy("symbol", "name", "metric_date").agg(F.max_by("value", "source").alias("value"))
    asked = days.select("symbol", F.col("market_date").alias("d")).distinct().select("symbol", F.explode(F.array(*[F.lit(n) for n in VALUATIONS])).alias("name"), "d")
    at = known.select("symbol", "name", F.col("metric_date").alias("d"), "value").join(asked.withColumn("asked", F.lit(True)), ["symbol", "name", "d"], "full")
    so_far = Window.partitionBy("symbol", "name").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("value").isNotNull(), F.struct("value", F.col("d").alias("as_of_date"))), ignorenulls=True).over(so_far)
    rows = at.withColumn("seen", seen).where("asked")
    return rows.select("symbol", F.col("d").alias("market_date"), "name", F.when(F.col("seen").isNull(), "missing_source").otherwise("available").alias("status"), "seen.value", "seen.as_of_date")


def valuation_changes(valuations: DataFrame) -> DataFrame:
    """What changed in a ratio against the result before: whether there is one, or its value or date."""
    before = Window.partitionBy("symbol", "name").orderBy("market_date")
    back = [F.lag(c).over(before).alias(f"previous_{c}") for c in ("market_date", "status", "value", "as_of_date")]
    rows = valuations.select("symbol", "name", "market_date", "status", "value", "as_of_date", *back)
    differs = ~F.col("value").eqNullSafe(F.col("previous_value")) | ~F.col("as_of_date").eqNullSafe(F.col("previous_as_of_date"))
    kind = F.when(F.col("status") != F.col("previous_status"), "availability_changed").when((F.col("status") == "available") & differs, "valuation_updated")
    return rows.where("previous_market_date is not null").withColumn("change", kind).where("change is not null")


def discrepancy_changes(discrepancies: DataFrame, days: DataFrame) -> DataFrame:
    """(symbol, market_date, added, resolved): how the set of (field, reason) changed from each compared day to the next.

    ``days`` has every (symbol, market_date) that was compared, with differences or without."""
    sets = discrepancies.groupBy("symbol", "market_date").agg(F.array_sort(F.collect_set(F.concat_ws(":", "field", "reason"))).alias("found"))
    every = days.join(sets, ["symbol", "market_date"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    before = F.lag("found").over(Window.partitionBy("symbol").orderBy("market_date"))
    rows = every.withColumn("before", before).where("before is not null")
    return rows.select("symbol", "market_date", F.array_join(F.array_sort(F.array_except("found", "before")), ",").alias("added"), F.array_join(F.array_sort(F.array_except("before", "found")), ",").alias("resolved")).where("added <> '' or resolved <> ''")


def quality(prices: DataFrame, validation: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """Per symbol the quality of the day from its price status and its validation, with the differing fields.

    ``prices`` is ``asof.price_status``. A day is clean if both are available, unavailable if there is no price
    at all, and else a warning; a validation that matches is available."""
    fields = discrepancies.groupBy("symbol").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
    joined = prices.join(validation.select("symbol", "outcome"), "symbol", "left").join(fields, "symbol", "left")
    checked = F.coalesce(F.when(F.col("outcome") == "match", "available").otherwise(F.col("outcome")), F.lit("missing_source"))
    status = F.when((F.col("price_status") == "available") & (checked == "available"), "clean").when(F.col("price_status") == "missing_source", "unavailable").otherwise("warning")
    return joined.select("symbol", "price_status", checked.alias("validation_status"), status.alias("quality"), "latest_date", F.coalesce("n", F.lit(0)).alias("discrepancies"), F.coalesce("fields", F.lit("")).alias("fields"))


def provenance(bars: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per symbol the sources behind its result, and the dates they span."""
    prices = bars.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("price_sources"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    ratios = metrics.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("valuation_sources"), F.count_distinct("name").alias("ratios"))
    return prices.join(ratios, "symbol", "left")


# What every report says of its scope.
NOTICE = "Descriptive figures from past prices; no advice."


def report_rows(ranked: DataFrame, reasons: DataFrame) -> DataFrame:
    """Candidates with their reasons nested, in order, as they are written to a report."""
    why = reasons.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("reason_order", "code", "kind", "threshold_multiple"))).alias("reasons"))
    return ranked.join(why, "symbol", "left").select("final_rank", "symbol", "quality", "kind", "reasons", F.lit(NOTICE).alias("notice"))


def report_totals(counts: DataFrame, ranked: DataFrame, provenance: DataFrame, limit: int) -> DataFrame:
    """One row: the scan's counts, its candidates' worst quality, and the sums and ids of the versions behind them.

    ``counts`` is ``first_screen.counts``; ``provenance`` has the columns of ``second_screen.provenance``."""
    behind = ranked.select("symbol").join(provenance, "symbol", "left")
    sums = behind.agg(
        F.count_if(F.col("supplemental") > 0).alias("supplemental_candidates"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("canonical", "supplemental", "missing", "discrepancies")),
        F.when(F.bool_or(F.col("research_quality") == "provisional"), "provisional").when(F.bool_or(F.col("research_quality") == "reconciled"), "reconciled").otherwise("canonical").alias("research_quality"),
        F.count("version_id").alias("versions"),
    )
    return counts.crossJoin(F.broadcast(sums)).select("*", F.lit(limit).alias("candidate_limit"), F.lit(NOTICE).alias("notice"))  # one row each
