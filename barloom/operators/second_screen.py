"""The second screen: sixteen metrics of each candidate on its last 250 bars, reasons, and a final ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import first_of, settled
from barloom.operators import asof, versions
from barloom.operators.rules import CONFIRMED, SECOND_RULES, STATUS_RULES, fired, rule_table
from barloom.operators.windows import drawdown_of

LOOKBACK = 250
WINDOWS = (20, 60, 120, 250)
# The metrics in their order.
PRICE_METRICS = (
    "return_20d", "return_60d", "return_120d", "volatility_60d", "max_drawdown_20d", "max_drawdown_60d", "max_drawdown_120d", "max_drawdown_250d",
    "volume_ratio_20d", "ma_distance_20d", "ma_distance_60d", "ma_distance_120d", "ma_distance_250d",
)
VALUATION_METRICS = {"valuation_pe_ratio": ("price_earnings_ratio", "pe_ratio"), "valuation_pb_ratio": ("price_to_book_ratio", "pb_ratio"), "valuation_dividend_yield": ("dividend_yield_pct", "dividend_yield")}


def price_metrics(members: DataFrame, bars: DataFrame, day) -> DataFrame:
    """(symbol, metric, component, status, previous, current, delta, observations): thirteen rows per member.

    The previous state is that of the same capped rows without the last. So with 250 rows the
    250-row metrics have no previous state: 249 rows are left of it."""
    light = bars.join(members.select("symbol"), "symbol", "left_semi").select("symbol", "trade_date", "close", "volume")
    capped = asof.last_bars(light, day, LOOKBACK)
    back = F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    rows = capped.withColumn("daily", F.when(back > 0, F.col("close") / back - 1))

    def over(fn, column: str, a: int, b: int) -> Column:
        return fn(F.when(F.col("rn").between(a, b), F.col(column)))

    parts = []
    for s, shift in (("now", 0), ("then", 1)):
        close = lambda k: F.max(F.when(F.col("rn") == k + shift, F.col("close")))  # noqa: B023, E731
        parts += [close(1).alias(f"c_{s}"), F.max(F.when(F.col("rn") == 1 + shift, F.col("volume"))).alias(f"v_{s}")]
        parts += [close(n + 1).alias(f"c{n}_{s}") for n in (20, 60, 120)]
        parts += [over(F.avg, "close", 1 + shift, n + shift).alias(f"m{n}_{s}") for n in WINDOWS]
        parts += [over(F.avg, "volume", 1 + shift, 20 + shift).alias(f"mv_{s}"), over(F.stddev_pop, "daily", 1 + shift, 60 + shift).alias(f"s_{s}"), over(F.count, "daily", 1 + shift, 60 + shift).alias(f"k_{s}")]
    wide = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.max("trade_date").alias("latest_date"), F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "close"))), lambda r: r["close"]).alias("closes"), *parts)
    joined = members.select("symbol").join(wide, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def value(name: str, s: str) -> Column:
        have = F.col("n") - int(s == "then")
        if name.startswith("return_"):
            n = int(name[7:-1])
            return F.when(have >= n + 1, (F.try_divide(F.col(f"c_{s}"), F.col(f"c{n}_{s}")) - 1) * 100)
        if name.startswith("ma_distance_"):
            n = int(name[12:-1])
            return F.when(have >= n, (F.try_divide(F.col(f"c_{s}"), F.col(f"m{n}_{s}")) - 1) * 100)
        if name.startswith("max_drawdown_"):
            n = int(name[13:-1])
            end = F.size("closes") - int(s == "then")
            return F.when(have >= n, drawdown_of(F.slice("closes", F.greatest(end - n + 1, F.lit(1)), n)))
        if name == "volatility_60d":
            return F.when(F.col(f"k_{s}") >= 60, F.col(f"s_{s}") * 100)
        return F.when(have >= 20, F.try_divide(F.col(f"v_{s}"), F.col(f"mv_{s}")))

    def observed(name: str) -> Column:
        if name == "volatility_60d":
            return F.coalesce("k_now", F.lit(0))
        n = 20 if name == "volume_ratio_20d" else int(name.rsplit("_", 1)[1][:-1]) + name.startswith("return_")
        return F.least("n", F.lit(n))

    state = F.when(F.col("latest_date").isNull(), "missing_source").when(F.col("latest_date") != F.lit(day), "market_date_mismatch")
    joined = joined.withColumn("blocked", state)
    values = joined.select("symbol", "blocked", "n", *(settled(value(m, s)).alias(f"{m}__{s}") for m in PRICE_METRICS for s in ("now", "then")), *(observed(m).cast("int").alias(f"{m}__n") for m in PRICE_METRICS))
    kinds = []
    for m in PRICE_METRICS:
        now, then, free = F.col(f"{m}__now"), F.col(f"{m}__then"), F.col("blocked").isNull()
        status = F.when(~free, F.col("blocked")).when(now.isNull(), "insufficient_history").otherwise("available")
        ok = free & now.isNotNull()
        kinds.append(F.struct(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("component"), status.alias("status"), F.when(ok, then).alias("previous"), F.when(free, now).alias("current"), F.when(ok, settled(now - then)).alias("delta"), F.when(free, F.col(f"{m}__n")).otherwise(F.col("n").cast("int")).alias("observations")))
    return values.select("symbol", F.explode(F.array(*kinds)).alias("m")).select("symbol", "m.*")


def valuation_metrics(members: DataFrame, ratios: DataFrame, day, first_metrics: DataFrame) -> DataFrame:
    """Current ratios as of the day; what came before and the change are those of the first screen."""
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(n).alias("name"), F.lit(c).alias("first_component")) for m, (n, c) in VALUATION_METRICS.items()])).alias("k")
    now = asof.valuations_as_of(ratios, day).select("symbol", "name", "value")
    before = first_metrics.where("metric = 'valuation_update'").select("symbol", F.col("component").alias("first_component"), "previous", "delta")
    joined = members.select("symbol", kinds).select("symbol", "k.*").join(now, ["symbol", "name"], "left").join(before, ["symbol", "first_component"], "left")
    known = F.col("value").isNotNull()
    return joined.select("symbol", "metric", F.lit(None).cast("string").alias("component"), F.when(known, "available").otherwise("valuation_unavailable").alias("status"), F.when(known, F.col("previous")).alias("previous"), settled(F.col("value")).alias("current"), F.when(known, F.col("delta")).alias("delta"), known.cast("int").alias("observations"))


def metrics(members: DataFrame, bars: DataFrame, ratios: DataFrame, day, first_metrics: DataFrame) -> DataFrame:
    return price_metrics(members, bars, day).unionByName(valuation_metrics(members, ratios, day, first_metrics))


def reasons(of: DataFrame, first_reasons: DataFrame, states: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(symbol, code, kind, class_priority, reason_order, threshold_multiple) of rules on numbers, of changed
    ratios that the first screen saw and this one confirms, and of states.

    ``states`` has price_status and validation_status of each symbol."""
    numbers = fired(of, rule_table(of.sparkSession, rules or SECOND_RULES)).select("symbol", "code", F.lit("research_change").alias("kind"), "class_priority", "reason_order", "threshold_multiple")
    seen = first_reasons.where("metric = 'valuation_update' and role = 'primary'").groupBy("symbol", "component").agg(F.min_by(F.struct("current", "threshold_multiple"), "reason_order").alias("r"))
    sure = F.col("status") == "available"
    rule = lambda k: first_of(*((F.col("metric") == m, F.lit(v)) for code, (m, component, order) in CONFIRMED.items() for v in [(code, component, order)[k]]))
    now = of.where(sure & F.col("metric").isin(*(m for m, _, _ in CONFIRMED.values()))).select("symbol", F.col("current").alias("now"), rule(0).alias("code"), rule(1).alias("component"), rule(2).alias("reason_order"))
    confirmed = seen.join(now, ["symbol", "component"]).where(F.abs(F.col("r.current") - F.col("now")) <= 1e-9)
    confirmed = confirmed.select("symbol", "code", F.lit("research_change").alias("kind"), F.lit(70).alias("class_priority"), "reason_order", settled(F.col("r.threshold_multiple")).alias("threshold_multiple"))
    found = {"source_discrepancy": F.col("validation_status") == "source_discrepancy", "market_date_mismatch": (F.col("price_status") == "market_date_mismatch") | (F.col("validation_status") == "market_date_mismatch")}
    marks = F.array_compact(F.array(*[F.when(F.coalesce(found[c], F.lit(False)), F.struct(F.lit(c).alias("code"), F.lit("data_quality").alias("kind"), F.lit(p).alias("class_priority"), F.lit(o).alias("reason_order"), F.lit(1.0).alias("threshold_multiple"))) for c, (p, o) in STATUS_RULES.items()]))
    return numbers.unionByName(confirmed).unionByName(states.select("symbol", F.inline(marks)))


def ranked(first: DataFrame, fired_rules: DataFrame, states: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The candidates of the first screen in their final order; none is added or lost.

    Failed ones come first, then blocked ones, then those that only a warning is known of, then the rest."""
    why = fired_rules.groupBy("symbol").agg(
        F.count_if(F.col("kind") == "research_change").alias("research_reasons"), F.count_if(F.col("kind") == "data_quality").alias("quality_reasons"),
        F.min("class_priority").alias("second_priority"), F.max("threshold_multiple").alias("second_multiple"),
    )
    out = first.select("symbol", F.col("rank").alias("first_rank"), "primary_reasons").join(states, "symbol", "left").join(why, "symbol", "left")
    out = out.join(failed.select("symbol", F.lit(True).alias("failed")), "symbol", "left") if failed is not None else out.withColumn("failed", F.lit(None).cast("boolean"))
    quality = first_of(
        (F.col("failed"), "failed"),
        (F.col("price_status").isin("missing_source", "market_date_mismatch"), "blocked"),
        (F.col("validation_status").isin("source_discrepancy", "market_date_mismatch", "missing_source"), "warning"),
        otherwise="clean",
    )
    out = out.withColumn("quality", quality)
    kind = F.when(F.col("quality").isin("failed", "blocked") | (F.coalesce("quality_reasons", F.lit(0)) > 0), "data_quality_candidate").otherwise("research_candidate")
    out = out.withColumn("kind", kind)
    group = F.when(F.col("quality") == "failed", 0).when(F.col("quality") == "blocked", 1).when((F.col("quality") == "warning") & (F.col("kind") == "data_quality_candidate"), 2).otherwise(4)
    research = F.coalesce("research_reasons", F.lit(0))
    out = out.select("symbol", "quality", "kind", research.alias("research_reasons"), "primary_reasons", F.coalesce("second_priority", F.lit(999)).alias("class_priority"), F.coalesce("second_multiple", F.lit(0.0)).alias("threshold_multiple"), "first_rank", group.alias("quality_group"))
    order = Window.orderBy("quality_group", F.desc("research_reasons"), F.desc("primary_reasons"), "class_priority", F.desc("threshold_multiple"), "first_rank", "symbol")
    return out.withColumn("final_rank", F.row_number().over(order))  # as many rows as the first screen's limit


def states_of(members: DataFrame, bars: DataFrame, day, validation: DataFrame) -> DataFrame:
    """price_status and validation_status of each member; no validation is a missing source."""
    prices = asof.price_status(members, bars, day).select("symbol", "price_status")
    return prices.join(validation.select("symbol", F.col("outcome").alias("validation_status")), "symbol", "left").withColumn("validation_status", F.coalesce("validation_status", F.lit("missing_source")))


def failed_metrics(failed: DataFrame) -> DataFrame:
    """The sixteen metrics of candidates whose analysis failed: all null, with that as their status."""
    null = F.lit(None).cast("double")
    names = F.explode(F.array(*[F.lit(m) for m in (*PRICE_METRICS, *VALUATION_METRICS)])).alias("metric")
    return failed.select("symbol", names).select("symbol", "metric", F.lit(None).cast("string").alias("component"), F.lit("analysis_failed").alias("status"), null.alias("previous"), null.alias("current"), null.alias("delta"), F.lit(0).alias("observations"))


def isolated(of: DataFrame, failed: DataFrame) -> DataFrame:
    """Metrics with those of failed candidates replaced: one that fails keeps its place and spoils no other."""
    return of.join(failed.select("symbol"), "symbol", "left_anti").unionByName(failed_metrics(failed))


def provenance(candidates: DataFrame, made: DataFrame, rows: DataFrame) -> DataFrame:
    """What stands behind each candidate: its version with states and counts, and the sources of each role.

    A candidate without a version has nulls, empty lists and canonical quality."""
    state = versions.states(F.col("status"))
    source = lambda role: F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("provider")))), ",").alias(f"{role}_sources")
    by_role = rows.groupBy("version_id").agg(*(source(r) for r in ("canonical", "supplemental", "validation")))
    behind = made.select("symbol", "version_id", "parent_id", "provenance_sha256", state["source"].alias("source_status"), state["authority"].alias("authority"), state["reconciliation"].alias("reconciliation"), state["quality"].alias("research_quality"), "canonical", "supplemental", "missing", "discrepancies")
    joined = candidates.select("symbol").join(behind, "symbol", "left").join(by_role, "version_id", "left")
    blank = {f"{r}_sources": "" for r in ("canonical", "supplemental", "validation")} | {"research_quality": "canonical"}
    return joined.fillna(blank).select("symbol", *(c for c in joined.columns if c != "symbol"))
