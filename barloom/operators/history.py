"""Read models over stored runs. Only sealed runs count, however many open or failed ones lie beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import first_of
from barloom.operators import versions


def sealed(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'succeeded'")


def _of(rows: DataFrame, runs: DataFrame, *columns: str) -> DataFrame:
    return rows.join(sealed(runs).select("run_id", *columns), "run_id")


def selections_per_symbol(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    return _of(candidates, runs).groupBy("symbol").agg(F.count("*").alias("selections"))


def stage_order(stage: Column) -> Column:
    """Sort key of stages: the first screen's before the second's, then what has no stage."""
    return F.when(stage == "first", 1).when(stage == "second", 2).otherwise(3)


def reason_frequency(reasons: DataFrame, runs: DataFrame, stage: str | None = None, code: str | None = None) -> DataFrame:
    """How often each reason was given, and its position in the order of reports."""
    rows = _of(reasons, runs)
    rows = rows.where(F.col("stage") == stage) if stage else rows
    rows = rows.where(F.col("code") == code) if code else rows
    per = rows.groupBy("stage", "code", "metric").agg(F.count("*").alias("times"), F.count_distinct("symbol").alias("symbols"))
    order = (stage_order(F.col("stage")), F.col("code"), F.col("metric"))
    return per.withColumn("position", F.row_number().over(Window.orderBy(*order))).orderBy(*order)  # a row per kind of reason


def daily_candidates(candidates: DataFrame, runs: DataFrame, day) -> DataFrame:
    return _of(candidates, runs, "market_date", "methodology").where(F.col("market_date") == F.lit(day))


def quality_frequency(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts by date, quality and status of the versions behind the candidates."""
    return _of(candidates, runs, "market_date").groupBy("market_date", "quality", "version_status").agg(
        F.count_distinct("run_id").alias("runs"), F.count("*").alias("candidates"), F.sum("supplemental").alias("supplemental"), F.count_if(F.col("version_status") == "reconciliation_pending").alias("pending"), F.sum("discrepancies").alias("discrepancies"),
    )


def date_totals(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Per date: candidates with filled-in rows, with discrepancies, and pending ones."""
    return _of(candidates, runs, "market_date").groupBy("market_date").agg(F.count_if(F.col("supplemental") > 0).alias("with_supplemental"), F.count_if(F.col("discrepancies") > 0).alias("with_discrepancies"), F.count_if(F.col("version_status") == "reconciliation_pending").alias("pending"))


def symbol_history(candidates: DataFrame, reasons: DataFrame, runs: DataFrame, symbol: str | None = None) -> DataFrame:
    """Each reason of each selection, with the run's date and the rank."""
    rows = _of(candidates, runs, "market_date", "methodology")
    rows = rows.where(F.col("symbol") == symbol) if symbol else rows
    return rows.join(reasons.select("run_id", "symbol", "stage", "code"), ["run_id", "symbol"]).select("symbol", "market_date", "methodology", "run_id", "rank", "stage", "code")


def methodology_comparison(candidates: DataFrame, runs: DataFrame, left: str, right: str) -> DataFrame:
    """Symbols that either methodology selected, how often each did, and on which side they are."""
    rows = _of(candidates, runs, "methodology").where(F.col("methodology").isin(left, right))
    per = rows.groupBy("symbol").agg(F.count_if(F.col("methodology") == left).alias("left_selections"), F.count_if(F.col("methodology") == right).alias("right_selections"))
    return per.withColumn("side", F.when((F.col("left_selections") > 0) & (F.col("right_selections") > 0), "both").when(F.col("left_selections") > 0, "left_only").otherwise("right_only"))


def versions_of(made: DataFrame, symbol: str | None = None, target=None, status: str | None = None) -> DataFrame:
    for column, value in (("symbol", symbol), ("target_date", target), ("status", status)):
        made = made.where(F.col(column) == F.lit(value)) if value is not None else made
    return made


def digest(table: DataFrame) -> DataFrame:
    """One row: how many rows a table has, and a sum of row hashes that doesn't depend on their order.

    A row hash is the first 60 bits of the MD5 of its columns as text in order of their names, so that other
    systems come to the same sum."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(table.columns)))
    return table.select(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def batch_status(tasks: DataFrame) -> DataFrame:
    """Per batch: counts by outcome, and success, partial success or failure."""
    per = tasks.groupBy("batch_id").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "failed", "skipped")))
    return per.withColumn("status", F.when(F.col("failed") == 0, "success").when(F.col("success") > 0, "partial_success").otherwise("failed"))


def run_status(candidates: DataFrame) -> DataFrame:
    """Per run: running while a candidate is open or none has failed (a run without failures ends when it
    is sealed, not here), else a partial success if one is done, else failed; with the code of the error."""
    per = candidates.groupBy("run_id").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("open", "failed", "done")), F.count("*").alias("candidates"))
    running = (F.col("open") > 0) | (F.col("failed") == 0)
    status = F.when(running, "running").when(F.col("done") > 0, "partial_success").otherwise("failed")
    error = F.when(~running, F.when(F.col("done") > 0, "candidate_failure").otherwise("all_candidates_failed"))
    return per.select("run_id", "open", "failed", "done", "candidates", status.alias("status"), error.alias("error_code"))


def run_quality(candidates: DataFrame) -> DataFrame:
    """Per run the worst quality, authority and reconciliation of its candidates' versions, sums of their counts,
    and their sources and ids.

    Candidates without a version are canonical by definition; a run that mixes both kinds has no quality but a
    ``problem``. ``candidates`` has version_id, version_status, canonical, supplemental, missing,
    discrepancies and supplemental_source."""
    versioned = F.col("version_id").isNotNull()
    state = versions.states(F.col("version_status"))
    rows = candidates.select("run_id", versioned.alias("versioned"), "version_id", "symbol", *(state[k].alias(k) for k in ("quality", "authority", "reconciliation")), *(F.when(versioned, F.col(c)).alias(c) for c in ("canonical", "supplemental", "missing", "discrepancies", "supplemental_source")))
    has = lambda column, value: F.coalesce(F.bool_or(F.when(F.col("versioned"), F.col(column) == value)), F.lit(False))
    worst = lambda column, *order, otherwise: first_of(*((has(column, v), v) for v in order), otherwise=otherwise)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    per = rows.groupBy("run_id").agg(
        F.when(F.bool_or("versioned") & ~F.bool_and("versioned"), "mixed_policies").alias("problem"),
        worst("quality", "provisional", "reconciled", otherwise="canonical").alias("quality"),
        worst("authority", "incomplete", "reconciled", otherwise="complete").alias("authority"),
        worst("reconciliation", "pending", "reconciled_discrepant", "reconciled_equal", otherwise="not_applicable").alias("reconciliation"),
        total("canonical"), total("supplemental"), total("missing"), total("discrepancies"), F.count_if(F.col("supplemental") > 0).alias("supplemental_candidates"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("supplemental") > 0, F.col("supplemental_source")))), ",").alias("supplemental_sources"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("versioned"), F.struct("symbol", "version_id")))), lambda v: v["version_id"]), ",").alias("version_ids"),
    )
    fine = F.col("problem").isNull()
    kept = [F.when(fine, F.col(c)).alias(c) for c in per.columns if c not in ("run_id", "problem")]
    execution = F.when(F.col("quality") == "provisional", "provisional_success").otherwise("success")
    source = F.when(F.col("quality") == "provisional", "provisional_mixed").when(F.col("quality") == "reconciled", "reconciled").otherwise("canonical_complete")
    return per.select("run_id", "problem", F.when(fine, execution).alias("execution_status"), F.when(fine, source).alias("source_status"), *kept)


def coverage(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
