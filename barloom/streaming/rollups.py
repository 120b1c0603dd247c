"""Read models of runs kept as sums: a run is added once, when it is sealed, however late, and readers add up groups
instead of all candidates and reasons of all runs.

All kinds of sums and the list of the runs in them are one table by key, so adding runs is one step: a batch that is lost
adds nothing, and a run that is there is never added again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.session import durable
from barloom.operators import history
from barloom.sources import keyed_table

KEYS = ("kind", "a", "b", "c", "d")
PARTS = 16  #: of each kind
SUMS = ("n", "runs", "supplemental", "pending", "discrepancies", "with_supplemental", "with_discrepancies")


def _sums(rows: DataFrame, kind: str, keys: list[str], **sums) -> DataFrame:
    """Rows of one kind: up to four keys as text, and the sums that it has."""
    named = [F.col(k).cast("string").alias(n) for k, n in zip(keys, "abcd")] + [F.lit("").alias(n) for n in "abcd"[len(keys) :]]
    per = rows.groupBy(*keys).agg(*(sums.get(s, F.lit(0)).cast("long").alias(s) for s in SUMS))
    return per.select(F.lit(kind).alias("kind"), *named, *SUMS)


def partial(candidates: DataFrame, reasons: DataFrame, runs: DataFrame) -> DataFrame:
    """What some sealed runs add: selections by methodology and symbol, reasons by symbol, and counts by quality."""
    of = lambda t, *more: t.join(runs.select("run_id", *more), "run_id")
    chosen = of(candidates, "market_date", "methodology")
    quality = _sums(
        chosen, "quality", ["market_date", "quality", "version_status"], n=F.count("*"), runs=F.count_distinct("run_id"), supplemental=F.sum("supplemental"), pending=F.count_if(F.col("version_status") == "reconciliation_pending"),
        discrepancies=F.sum("discrepancies"), with_supplemental=F.count_if(F.col("supplemental") > 0), with_discrepancies=F.count_if(F.col("discrepancies") > 0),
    )
    added = _sums(chosen, "selection", ["methodology", "symbol"], n=F.count("*")).unionByName(quality)
    added = added.unionByName(_sums(of(reasons), "reason", ["stage", "code", "metric", "symbol"], n=F.count("*")))
    return added.unionByName(_sums(runs, "run", ["run_id"], n=F.count("*")))


def add_sealed(spark: SparkSession, path: str, candidates: DataFrame, reasons: DataFrame, runs: DataFrame) -> int:
    """Adds the sealed runs that aren't in the table at ``path`` yet; returns how many these were."""
    sealed = history.sealed(runs).select("run_id", "market_date", "methodology")
    held = keyed_table.current(spark, path)
    if held is not None:
        there = held.where("kind = 'run'").select(F.col("a").alias("run_id"))
        sealed = sealed.join(there, "run_id", "left_anti")
    sealed = durable(sealed)
    n = sealed.count()
    if n:
        new = durable(partial(candidates, reasons, sealed))
        if held is not None:
            both = new.join(held.select(*KEYS, *(F.col(s).alias(f"_{s}") for s in SUMS)), [*KEYS], "left")
            new = both.select(*KEYS, *((F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in SUMS))
        part = F.concat_ws("-", "kind", F.pmod(F.xxhash64(*KEYS), F.lit(PARTS)).cast("string"))  # only parts with groups of the runs are written
        keyed_table.upsert(new.withColumn("part", part), path, [*KEYS], [], "part")
    return n


def _kind(held: DataFrame, kind: str, *names: str) -> DataFrame:
    return held.where(F.col("kind") == kind).select(*(F.col(k).alias(n) for k, n in zip("abcd", names)), *SUMS)


def selections_per_symbol(held: DataFrame) -> DataFrame:
    return _kind(held, "selection", "methodology", "symbol").groupBy("symbol").agg(F.sum("n").alias("selections"))


def methodology_comparison(held: DataFrame, left: str, right: str) -> DataFrame:
    rows = _kind(held, "selection", "methodology", "symbol").where(F.col("methodology").isin(left, right))
    per = rows.groupBy("symbol").agg(*(F.coalesce(F.sum(F.when(F.col("methodology") == m, F.col("n"))), F.lit(0)).alias(f"{side}_selections") for side, m in (("left", left), ("right", right))))
    return per.withColumn("side", F.when((F.col("left_selections") > 0) & (F.col("right_selections") > 0), "both").when(F.col("left_selections") > 0, "left_only").otherwise("right_only"))


def reason_frequency(held: DataFrame) -> DataFrame:
    return _kind(held, "reason", "stage", "code", "metric", "symbol").groupBy("stage", "code", "metric").agg(F.sum("n").alias("times"), F.count("*").alias("symbols"))


def quality_frequency(held: DataFrame) -> DataFrame:
    return _kind(held, "quality", "market_date", "quality", "version_status").select(F.col("market_date").cast("date").alias("market_date"), "quality", "version_status", "runs", F.col("n").alias("candidates"), "supplemental", "pending", "discrepancies")


def date_totals(held: DataFrame) -> DataFrame:
    per = _kind(held, "quality", "market_date").groupBy(F.col("market_date").cast("date").alias("market_date"))
    return per.agg(*(F.sum(c).alias(c) for c in ("with_supplemental", "with_discrepancies", "pending")))
