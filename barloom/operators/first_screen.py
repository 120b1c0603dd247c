"""The first screen: eight metrics per symbol on its last 62 bars, rules, and a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import first_of, settled
from barloom.operators import asof
from barloom.operators.rules import FIRST_RULES, fired, rule_table

LOOKBACK = 62
PRICE_METRICS = ("price_change_1d", "volume_anomaly", "return_20d_change", "volatility_regime_change", "ma_distance_change")
# Units of a metric's values and of its change, by metric and component.
UNITS = {
    ("price_change_1d", None): ("percent", "percentage_point"), ("volume_anomaly", None): ("ratio", "ratio"), ("return_20d_change", None): ("percent", "percentage_point"),
    ("volatility_regime_change", None): ("annualized_percent", "percentage_point"), ("ma_distance_change", None): ("percent", "percentage_point"),
    ("valuation_update", "pe_ratio"): ("ratio", "percent_relative_change"), ("valuation_update", "pb_ratio"): ("ratio", "percent_relative_change"), ("valuation_update", "dividend_yield"): ("percent", "percentage_point"),
}
COMPONENTS = {"price_earnings_ratio": "pe_ratio", "price_to_book_ratio": "pb_ratio", "dividend_yield_pct": "dividend_yield"}


def _at(column: str, k: int) -> Column:
    return F.max(F.when(F.col("rn") == k, F.col(column)))


def _over(fn, column: str, a: int, b: int) -> Column:
    return fn(F.when(F.col("rn").between(a, b), F.col(column)))


def price_inputs(bars: DataFrame, day) -> DataFrame:
    """One row per symbol of all that the price metrics need: bars are capped first, then one aggregate."""
    capped = asof.last_bars(bars.select("symbol", "trade_date", "close", "volume"), day, LOOKBACK)
    back = F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    rows = capped.withColumn("daily", F.when(back > 0, F.col("close") / back - 1))
    return rows.groupBy("symbol").agg(
        F.count("*").alias("n"), F.max("trade_date").alias("latest_date"), _at("trade_date", 2).alias("prior_date"),
        *(_at("close", k).alias(f"c{k}") for k in (1, 2, 3, 21, 22)), *(_at("volume", k).alias(f"v{k}") for k in (1, 2)),
        _over(F.avg, "volume", 2, 21).alias("v_now"), _over(F.avg, "volume", 3, 22).alias("v_then"),
        _over(F.stddev_samp, "daily", 1, 60).alias("s_now"), _over(F.stddev_samp, "daily", 2, 61).alias("s_then"),
        _over(F.avg, "close", 1, 20).alias("m_now"), _over(F.avg, "close", 2, 21).alias("m_then"),
        *(_over(F.min, "close", 1, k).alias(f"low{k}") for k in (3, 21, 62)),
    )


def _price_metrics() -> list[Column]:
    """Structs of the five price metrics, each with its own need of rows and its own denominators."""
    pct = lambda a, b: (F.try_divide(F.col(a), F.col(b)) - 1) * 100
    low = lambda *c: F.array_min(F.array(*(F.col(x) for x in c))) > 0
    year = 252**0.5 * 100
    parts = [
        ("price_change_1d", 3, low("low3"), pct("c2", "c3"), pct("c1", "c2")),
        ("volume_anomaly", 22, low("v_then", "v_now"), F.try_divide(F.col("v2"), F.col("v_then")), F.try_divide(F.col("v1"), F.col("v_now"))),
        ("return_20d_change", 22, low("c22", "c21", "c2", "c1"), pct("c2", "c22"), pct("c1", "c21")),
        ("volatility_regime_change", 62, low("low62"), F.col("s_then") * year, F.col("s_now") * year),
        ("ma_distance_change", 21, low("low21"), pct("c2", "m_then"), pct("c1", "m_now")),
    ]
    out = []
    for name, need, valid, then, now in parts:
        status = F.when(F.col("price_status") != "available", F.col("price_status")).when(F.col("n") < need, "insufficient_history").when(~valid, "invalid_denominator").otherwise("available")
        ok = status == "available"
        out.append(F.struct(F.lit(name).alias("metric"), F.lit(None).cast("string").alias("component"), status.alias("status"), F.when(ok, settled(then)).alias("previous"), F.when(ok, settled(now)).alias("current"), F.when(ok, settled(settled(now) - settled(then))).alias("delta")))
    return out


def valuation_changes(members: DataFrame, metrics: DataFrame, day, previous_day) -> DataFrame:
    """The three valuation metrics of each member: the ratio as of the day against that as of the day before."""
    light = members.select("symbol")
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("component")) for n, c in COMPONENTS.items()])).alias("k")
    grid = light.select("symbol", kinds).select("symbol", "k.name", "k.component")
    now = asof.valuations_as_of(metrics, day).select("symbol", "name", F.col("value").alias("now"))
    then = asof.valuations_as_of(metrics, previous_day).select("symbol", "name", F.col("value").alias("then"))
    joined = grid.join(now, ["symbol", "name"], "left").join(then, ["symbol", "name"], "left")
    # a side without any ratio is a missing source
    sides = Window.partitionBy("symbol")
    seen = joined.withColumn("both", (F.count("now").over(sides) > 0) & (F.count("then").over(sides) > 0))
    positive = (F.col("now") > 0) & (F.col("then") > 0)
    one = F.col("now").isNull() | F.col("then").isNull()
    relative = F.col("component") != "dividend_yield"
    status = (
        F.when(~F.col("both") | (F.col("now").isNull() & F.col("then").isNull()), "valuation_unavailable")
        .when(~one & relative & ~positive, "invalid_denominator")
        .otherwise("available")
    )
    delta = F.when(relative, (F.try_divide(F.col("now"), F.col("then")) - 1) * 100).otherwise(F.col("now") - F.col("then"))
    ok = F.col("status") == "available"
    return seen.withColumn("status", status).select(
        "symbol", F.lit("valuation_update").alias("metric"), "component", "status",
        F.when(ok, settled(F.col("then"))).alias("previous"), F.when(ok, settled(F.col("now"))).alias("current"), F.when(ok, settled(delta)).alias("delta"),
    )


def metrics(members: DataFrame, bars: DataFrame, ratios: DataFrame, day, previous_day) -> DataFrame:
    """(symbol, metric, component, status, previous, current, delta, value_unit, delta_unit): eight rows for every member."""
    inputs = members.select("symbol").join(price_inputs(bars, day), "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("latest_date").isNull(), "missing_source").when(F.col("latest_date") == F.lit(day), "available").otherwise("market_date_mismatch")
    prices = inputs.withColumn("price_status", status).select("symbol", F.explode(F.array(*_price_metrics())).alias("m")).select("symbol", "m.*")
    every = prices.unionByName(valuation_changes(members, ratios, day, previous_day))
    unit = lambda k: first_of(*(((F.col("metric") == m) & F.col("component").eqNullSafe(F.lit(c)), u[k]) for (m, c), u in UNITS.items()))
    return every.select("*", unit(0).alias("value_unit"), unit(1).alias("delta_unit"))


def reasons(of: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    return fired(of, rule_table(of.sparkSession, rules or FIRST_RULES))


def evaluations(of: DataFrame, fired_rules: DataFrame) -> DataFrame:
    """A row per member: quality, number of primary and secondary reasons, and what ranks it."""
    quality = of.groupBy("symbol").agg(F.count_if(F.col("status") == "available").alias("available"), F.count("*").alias("n"))
    primary = F.col("role") == "primary"
    why = fired_rules.groupBy("symbol").agg(
        F.count_if(primary).alias("primary_reasons"), F.count_if(~primary).alias("secondary_reasons"),
        F.min(F.when(primary, F.col("class_priority"))).alias("class_priority"), F.max(F.when(primary, F.col("threshold_multiple"))).alias("threshold_multiple"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reason_order", "code"))), lambda r: r["code"]), ",").alias("codes"),
    )
    status = F.when(F.col("available") == F.col("n"), "clean").when(F.col("available") > 0, "warning").otherwise("unavailable")
    joined = quality.join(why, "symbol", "left")
    return joined.select("symbol", status.alias("quality"), F.coalesce("primary_reasons", F.lit(0)).alias("primary_reasons"), F.coalesce("secondary_reasons", F.lit(0)).alias("secondary_reasons"), "class_priority", "threshold_multiple", F.coalesce("codes", F.lit("")).alias("codes"), (F.coalesce("primary_reasons", F.lit(0)) > 0).alias("triggered"))


def candidates(evaluated: DataFrame, limit: int = 30) -> DataFrame:
    """The triggered members in order of priority, up to ``limit``. Top-k first, so ranks are given to k rows."""
    order = [F.desc("primary_reasons"), F.asc("class_priority"), F.desc("threshold_multiple"), F.asc("symbol")]
    best = evaluated.where("triggered").orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("triggered")


def counts(evaluated: DataFrame, universe: DataFrame, limit: int = 30) -> DataFrame:
    """Universe, screened, triggered and candidate counts of a scan, and whether the limit cut it."""
    scan = evaluated.agg(F.count("*").alias("screened_count"), F.count_if("triggered").alias("triggered_count"))
    every = universe.agg(F.count("*").alias("universe_count"))
    return every.crossJoin(F.broadcast(scan)).select("universe_count", "screened_count", "triggered_count", F.least(F.col("triggered_count"), F.lit(limit)).alias("candidate_count"), (F.col("triggered_count") > limit).alias("truncated"))


def input_gaps(members: DataFrame, inputs: DataFrame) -> DataFrame:
    """What keeps a scan from starting: members without input, inputs without member, repeated inputs."""
    missing = members.select("symbol").join(inputs.select("symbol"), "symbol", "left_anti").withColumn("problem", F.lit("missing"))
    extra = inputs.select("symbol").join(members.select("symbol"), "symbol", "left_anti").withColumn("problem", F.lit("extra"))
    twice = inputs.groupBy("symbol").count().where("count > 1").select("symbol", F.lit("duplicate").alias("problem"))
    return missing.unionByName(extra).unionByName(twice)


def merged_previous(valuations: DataFrame) -> DataFrame:
    """(symbol, name, value, conflict): equal duplicates become one row, different ones are marked."""
    per = valuations.groupBy("symbol", "name").agg(F.min("value").alias("value"), F.max("value").alias("most"), F.count("value").alias("known"), F.count("*").alias("n"))
    return per.select("symbol", "name", "value", ((F.col("value") != F.col("most")) | ((F.col("known") > 0) & (F.col("known") < F.col("n")))).alias("conflict"))


def screening_source(source: Column, supplemental: tuple[str, ...] = ("secondary",), canonical: str = "primary") -> Column:
    """Rows filled in from the other source count as canonical for the screen, and only there."""
    return F.when(source.isin(*supplemental), canonical).otherwise(source)
