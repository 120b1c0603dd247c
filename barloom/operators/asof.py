"""As-of selection: nothing later than the as-of date is ever read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schemas import OHLCV


def prices_as_of(bars: DataFrame, day) -> DataFrame:
    return bars.where(F.col("trade_date") <= F.lit(day))


def price_status(symbols: DataFrame, bars: DataFrame, day) -> DataFrame:
    """A row per symbol: the last date with a bar, and whether it is the day itself."""
    latest = prices_as_of(bars, day).groupBy("symbol").agg(F.max("trade_date").alias("latest_date"), F.count("*").alias("observations"))
    status = F.when(F.col("latest_date").isNull(), "missing_source").when(F.col("latest_date") == F.lit(day), "available").otherwise("market_date_mismatch")
    return symbols.select("symbol").join(latest, "symbol", "left").select("symbol", "latest_date", F.coalesce("observations", F.lit(0)).alias("observations"), status.alias("price_status"))


def last_bars(bars: DataFrame, day, n: int) -> DataFrame:
    """The last n bars of each symbol; rn is 1 for the latest. Nothing else is computed over the same
    window, so Spark prunes groups before the shuffle."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return prices_as_of(bars, day).withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n)


def of_last_bars(bars: DataFrame, days: dict[str, object], n: int) -> DataFrame:
    """The bars that are among the last n of their symbol up to any of ``days``, with a flag for each: ``days`` names the
    flags. Which bars those are is counted in one window, so nothing is joined back."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    known = {k: F.coalesce(F.col("trade_date") <= F.lit(d), F.lit(False)) for k, d in days.items()}
    place = {k: F.sum(c.cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0)) for k, c in known.items()}
    marked = bars.select("*", *((known[k] & (place[k] <= n)).alias(k) for k in days))
    return marked.where(F.array_contains(F.array(*days), True))


def last_bars_with_total(bars: DataFrame, day, n: int) -> DataFrame:
    total = prices_as_of(bars, day).groupBy("symbol").agg(F.count("*").alias("total_observations"))
    return last_bars(bars, day, n).join(total, "symbol").withColumn("truncated", F.col("total_observations") > n)


def valuations_as_of(metrics: DataFrame, day) -> DataFrame:
    """The latest value of each ratio up to the day, by its name; of one date, the last source by name."""
    return latest_values(metrics.where(F.col("metric_date") <= F.lit(day)))


def latest_values(metrics: DataFrame) -> DataFrame:
    """The latest value of each ratio, by its name; of one date, the last source by name.

    First the latest of each source, which is added up by hashing as all that is kept are numbers and dates; a struct would
    have every row sorted. What is left is a row per symbol, ratio and source."""
    per = metrics.groupBy("symbol", "name", "source").agg(F.max_by("value", "metric_date").alias("value"), F.max("metric_date").alias("metric_date"))
    newest = F.struct("metric_date", "source")
    return per.groupBy("symbol", "name").agg(F.max_by("value", newest).alias("value"), F.max("metric_date").alias("metric_date"), F.max_by("source", newest).alias("source"))


def validation_run(runs: DataFrame, day, run_id: str | None = None) -> DataFrame:
    """Per symbol the newest successful run for exactly that day, or the run asked for."""
    fits = (F.col("market_date") == F.lit(day)) & (F.col("status") == "success")
    fits = fits & (F.col("run_id") == run_id) if run_id is not None else fits
    best = runs.where(fits).groupBy("symbol").agg(F.max_by(F.struct("*"), F.struct("created_at", "run_id")).alias("r"))
    return best.select("r.*")


def previous_results(results: DataFrame) -> DataFrame:
    """Each result with the date of the one before it of the same methodology, and of any."""
    same = Window.partitionBy("symbol", "methodology").orderBy("market_date")
    earlier = F.max("market_date").over(Window.partitionBy("symbol").orderBy("day_number").rangeBetween(Window.unboundedPreceding, -1))
    numbered = results.withColumn("day_number", F.datediff("market_date", F.lit("1970-01-01").cast("date")))
    out = numbered.select("*", F.lag("market_date").over(same).alias("previous_date"), earlier.alias("previous_any_date"))
    status = F.when(F.col("previous_date").isNotNull(), "available").when(F.col("previous_any_date").isNotNull(), "methodology_incompatible").otherwise("previous_result_missing")
    return out.withColumn("comparison_status", status).drop("day_number")


def merged_history(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two owners' bars of one history; ``conflict`` marks dates on which both have bars that differ."""
    a = one.select("symbol", "trade_date", F.struct(*OHLCV).alias("a"))
    b = other.select("symbol", "trade_date", F.struct(*OHLCV).alias("b"))
    both = a.join(b, ["symbol", "trade_date"], "full")
    conflict = F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))
    picked = F.coalesce("a", "b")
    return both.select("symbol", "trade_date", *(picked[c].alias(c) for c in OHLCV), conflict.alias("conflict"))


def sources_union(*tables: DataFrame) -> DataFrame:
    """Sorted distinct sources of each symbol over several tables, and their endpoints where a table has them."""
    endpoint = lambda t: F.col("endpoint") if "endpoint" in t.columns else F.lit(None).cast("string").alias("endpoint")
    parts = [t.select("symbol", "source", endpoint(t)).distinct() for t in tables]
    every = parts[0]
    for t in parts[1:]:
        every = every.unionByName(t)
    return every.groupBy("symbol").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("endpoint")).alias("endpoints"))


def market_day_state(day: Column, latest: Column) -> Column:
    """Where a day stands: weekends first, then against the latest date that is published."""
    return F.when(F.weekday(day) >= 5, "weekend").when(latest.isNull(), "latest_unavailable").when(day < latest, "before_latest").when(day == latest, "on_latest").otherwise("after_latest")


def resolved_day(day: Column, latest: Column) -> Column:
    """The trading day a request means: the latest one if the day isn't before it, else none yet."""
    return F.when(latest.isNotNull() & (day >= latest), latest)


def is_market_day(days: DataFrame, closed: DataFrame, latest) -> DataFrame:
    """(day, state, market_day): only the latest published date itself counts, unless the exchange is closed."""
    marked = days.join(closed.select("day").distinct().withColumn("closed", F.lit(True)), "day", "left")
    state = F.when(F.col("closed"), "closed").otherwise(market_day_state(F.col("day"), F.lit(latest)))
    return marked.select("day", state.alias("state"), (state == "on_latest").alias("market_day"))


def latest_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("source").agg(F.max("trade_date").alias("latest_date"))


def short_history(bars: DataFrame, listed: DataFrame, day, required: int = 250) -> DataFrame:
    """Whether a symbol's history is long enough, or short because it starts on its listing date."""
    spans = prices_as_of(bars, day).groupBy("symbol").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    whole = (F.col("first_date") == F.col("listing_date")) & (F.col("last_date") == F.lit(day))
    state = F.when(F.col("n") >= required, "complete").when(F.coalesce(whole, F.lit(False)), "legal_short").when(F.col("n") > 0, "incomplete").otherwise("missing")
    joined = listed.select("symbol", "listing_date").join(spans, "symbol", "left")
    return joined.select("symbol", F.coalesce("n", F.lit(0)).alias("observations"), state.alias("history_state"))


def readiness(symbols: DataFrame, bars: DataFrame, day, required: int = 62, allowed: tuple[str, ...] = ("primary",)) -> DataFrame:
    """Per symbol: ready, ready but short, of a source that isn't allowed, or missing - as it also is if its last
    bar isn't the day's."""
    known = prices_as_of(bars, day).groupBy("symbol").agg(F.count("*").alias("n"), F.max("trade_date").alias("latest"), F.max(~F.col("source").isin(*allowed)).alias("other"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("other"), "illegal_source").when(F.col("latest") != F.lit(day), "missing").when(F.col("n") < required, "short").otherwise("ready")
    return symbols.select("symbol").join(known, "symbol", "left").select("symbol", state.alias("readiness"))


def readiness_totals(of: DataFrame) -> DataFrame:
    """One row: how many are ready, how many of them short, how many not, and whether a scan may start."""
    is_ = lambda *s: F.count_if(F.col("readiness").isin(*s))
    return of.agg(F.count("*").alias("eligible"), is_("ready", "short").alias("ready"), is_("short").alias("short"), is_("illegal_source").alias("illegal_source"), is_("missing", "illegal_source").alias("missing"), (is_("ready", "short") == F.count("*")).alias("complete"))


def version_snapshot(observations: DataFrame, version_id: str | DataFrame) -> DataFrame:
    """The selected rows of explicitly named versions; there is no latest one to fall back to."""
    if isinstance(version_id, str):
        return observations.where((F.col("version_id") == version_id) & F.col("selected"))
    return observations.join(version_id.select("version_id").distinct(), "version_id", "left_semi").where("selected")


def validation_view(observations: DataFrame, days: DataFrame) -> DataFrame:
    """(version_id, status, outcome, left_provider, right_provider, fields): the canonical row of a version's day
    against its validation row of the first provider by name, field by field.

    ``days`` has version_id and target_date. Without one of the rows the source is missing."""
    on_day = observations.join(days.select("version_id", F.col("target_date").alias("trade_date")), ["version_id", "trade_date"])
    bar = F.struct("provider", *OHLCV)
    per = on_day.groupBy("version_id").agg(F.min_by(bar, F.when((F.col("role") == "canonical") & F.col("selected"), F.col("provider"))).alias("l"), F.min_by(bar, F.when(F.col("role") == "validation", F.col("provider"))).alias("r"))
    both = days.select("version_id").join(per, "version_id", "left")
    there = F.col("l").isNotNull() & F.col("r").isNotNull()
    fields = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), c) for c in OHLCV])), ",")
    status = F.when(~there, "missing_source").when(fields != "", "source_discrepancy").otherwise("available")
    outcome = F.when(there, F.when(fields != "", "discrepancy").otherwise("match"))
    return both.select("version_id", status.alias("status"), outcome.alias("outcome"), F.when(there, F.col("l.provider")).alias("left_provider"), F.when(there, F.col("r.provider")).alias("right_provider"), F.when(there, fields).otherwise("").alias("fields"))
