"""Rules as data: a table of rules meets a long table of metrics by a join, and what fires are reasons.

A metric row has metric, component (null if it has none), status, previous, current and delta. Callers
may pass rules of their own with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalar import settled

RULES = "code string, metric string, component string, trigger_class string, role string, operator string, threshold double, unit string, class_priority int, reason_order int"

# Codes, thresholds and priorities of the first screen.
FIRST_RULES = [
    ("price_change_1d_threshold", "price_change_1d", None, "market_move", "primary", "abs_current_gte", 3.0, "percent", 10, 10),
    ("volume_anomaly_high", "volume_anomaly", None, "liquidity_change", "primary", "current_gte", 2.0, "ratio", 20, 20),
    ("volume_anomaly_low_context", "volume_anomaly", None, "liquidity_context", "secondary", "current_lte", 0.5, "ratio", 90, 30),
    ("return_20d_delta_threshold", "return_20d_change", None, "trend_change", "primary", "abs_delta_gte", 1.0, "percentage_point", 30, 40),
    ("volatility_60d_delta_threshold", "volatility_regime_change", None, "risk_regime_change", "primary", "abs_delta_gte", 1.0, "percentage_point", 40, 50),
    ("ma20_distance_delta_threshold", "ma_distance_change", None, "trend_change", "primary", "abs_delta_gte", 1.0, "percentage_point", 30, 60),
    ("valuation_pe_availability_transition", "valuation_update", "pe_ratio", "valuation_change", "primary", "availability_changed", None, "availability", 50, 70),
    ("valuation_pe_relative_change", "valuation_update", "pe_ratio", "valuation_change", "primary", "abs_delta_gte", 10.0, "percent_relative_change", 50, 80),
    ("valuation_pb_availability_transition", "valuation_update", "pb_ratio", "valuation_change", "primary", "availability_changed", None, "availability", 50, 90),
    ("valuation_pb_relative_change", "valuation_update", "pb_ratio", "valuation_change", "primary", "abs_delta_gte", 10.0, "percent_relative_change", 50, 100),
    ("valuation_yield_availability_transition", "valuation_update", "dividend_yield", "valuation_change", "primary", "availability_changed", None, "availability", 50, 110),
    ("valuation_yield_delta_threshold", "valuation_update", "dividend_yield", "valuation_change", "primary", "abs_delta_gte", 0.5, "percentage_point", 50, 120),
]

# Codes, thresholds and priorities of the second screen's rules on numbers.
SECOND_RULES = [
    ("drawdown_change", "max_drawdown_120d", None, "risk_change", "research_change", "abs_delta_gte", 1.0, "percentage_point", 20, 30),
    ("volatility_regime_change", "volatility_60d", None, "risk_change", "research_change", "abs_delta_gte", 1.0, "percentage_point", 20, 40),
    ("return_60d_change", "return_60d", None, "return_change", "research_change", "abs_delta_gte", 1.0, "percentage_point", 30, 50),
    ("return_120d_state", "return_120d", None, "return_state", "research_change", "abs_current_gte", 10.0, "percent", 40, 60),
    ("ma_distance_change", "ma_distance_60d", None, "trend_change", "research_change", "abs_delta_gte", 1.0, "percentage_point", 50, 70),
    ("volume_anomaly", "volume_ratio_20d", None, "liquidity_change", "research_change", "current_gte", 2.0, "ratio", 60, 80),
]

# Its rules on states, and the metric that each valuation rule confirms.
STATUS_RULES = {"source_discrepancy": (10, 10), "market_date_mismatch": (10, 20)}
CONFIRMED = {"valuation_update_pe": ("valuation_pe_ratio", "pe_ratio", 90), "valuation_update_pb": ("valuation_pb_ratio", "pb_ratio", 100), "valuation_update_yield": ("valuation_dividend_yield", "dividend_yield", 110)}


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)


def _matched() -> tuple[Column, Column]:
    """Whether a rule fires on a metric, and how many times over its threshold the metric is."""
    current, delta, limit, op = F.col("current"), F.col("delta"), F.col("threshold"), F.col("operator")
    size = F.when(op == "abs_current_gte", F.abs(current)).when(op == "abs_delta_gte", F.abs(delta)).otherwise(current)
    fires = F.when(op == "availability_changed", F.col("previous").isNull() != current.isNull()).when(op == "current_lte", current <= limit).otherwise(size >= limit)
    times = (
        F.when(op == "availability_changed", 1.0)
        .when(op == "current_lte", F.when(current > 0, limit / current).otherwise(1.0))
        .otherwise(F.try_divide(F.greatest(size, F.lit(0.0)), limit))
    )
    return F.coalesce(fires, F.lit(False)), settled(times)


def fired(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Reasons: a row per rule that fires on an available metric. Rules are a table of a few rows, broadcast."""
    fires, times = _matched()
    named = F.broadcast(rules.withColumnsRenamed({"metric": "rule_metric", "component": "rule_component"}))
    joined = metrics.where(F.col("status") == "available").join(named, (F.col("metric") == F.col("rule_metric")) & F.col("component").eqNullSafe(F.col("rule_component")))
    return joined.where(fires).select("symbol", "code", "metric", "component", "previous", "current", "delta", "unit", "operator", "threshold", "role", "trigger_class", "class_priority", "reason_order", times.alias("threshold_multiple"))
