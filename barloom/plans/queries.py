"""The registered queries of the panel operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import scalar
from barloom.functions.session import durable
from barloom.operators import asof, compare, first_screen, history, results, second_screen, universe, validate, versions, windows
from barloom.plans import kept, reading
from barloom.plans.panel import Panel, Query, shown
from barloom.sources import market


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(market.bars(spark, sf_dir).drop("supplier", "top_discount"))


def valuation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(Panel(spark, sf_dir).ratios)


def bar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of bars of which some are broken: by the day of the month."""
    day = F.dayofmonth("trade_date")
    broken = Panel(spark, sf_dir).bars.select("symbol", "trade_date", F.when(day == 3, -F.col("open")).otherwise(F.col("open")).alias("open"), F.when(day == 5, F.col("low") - 1).otherwise(F.col("high")).alias("high"), F.when(day == 7, F.col("high") + 1).otherwise(F.col("low")).alias("low"), "close", F.when(day == 9, -1).otherwise(F.col("volume")).alias("volume"))
    return validate.checked_bars(broken).groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"))


def repeated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.repeated(market.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def batch_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch per symbol and year, some with a wrong range, symbol or date."""
    rows = Panel(spark, sf_dir).bars.select("symbol", "supplier", "trade_date", F.concat_ws("-", "symbol", F.year("trade_date")).alias("batch_id"))
    batches = rows.groupBy("batch_id").agg(F.min("symbol").alias("s"), F.min("supplier").alias("k"), F.min("trade_date").alias("start"), F.max("trade_date").alias("market_date"), F.year(F.min("trade_date")).alias("y"))
    key = F.col("k") + F.col("y")
    batches = batches.select("batch_id", F.when(key % 5 == 0, "ZZZZ").otherwise(F.col("s")).alias("batch_symbol"), F.when(key % 7 == 0, F.date_add("start", 1)).otherwise(F.col("start")).alias("start_date"), F.col("market_date").alias("end_date"), F.when(key % 3 == 0, F.date_add("market_date", 1)).otherwise(F.col("market_date")).alias("market_date"))
    return validate.batch_problems(rows, batches)


def source_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = Panel(spark, sf_dir)
    rows = panel.bars.select("symbol", F.lit("canonical").alias("role"), F.when(F.col("supplier") % 4 == 0, "secondary").when(F.col("supplier") % 9 == 0, "synthetic_a").otherwise("primary").alias("source"))
    rows = rows.unionByName(panel.second.select("symbol", F.lit("validation").alias("role"), "source"))
    return validate.role_violations(rows, {"canonical": ("primary",), "validation": ("primary", "secondary")})


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and numbers of the order tables in the forms that providers send, some of them broken, read back."""
    part = market.table(spark, sf_dir, "part").select("p_partkey", F.floor("p_retailprice").alias("price"))
    k = F.col("p_partkey")
    number = F.when(k % 7 == 1, F.concat(F.format_string("%,d", F.col("price")), F.lit(",5"))).when(k % 7 == 2, "1e400").otherwise(F.format_string("%,d.25", F.col("price")))
    whole = F.when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".5"))).when(k % 5 == 2, F.concat(k.cast("string"), F.lit(".0"))).otherwise(F.format_string("%,d", k * 1000))
    code = F.when(k % 6 == 1, F.concat(F.lit(" p-"), k.cast("string"))).when(k % 6 == 2, "   ").otherwise(F.concat(F.lit("  p"), k.cast("string"), F.lit(" ")))
    word = F.element_at(F.array(*[F.lit(w) for w in (" Yes ", "no", "TRUE", "0", "maybe")]), (k % 5 + 1).cast("int"))
    return shown(part.select("p_partkey", scalar.to_number(number).alias("number"), scalar.to_integer(whole).alias("whole"), scalar.clean_symbol(code).alias("symbol"), scalar.is_symbol(scalar.clean_symbol(code)).alias("fits"), scalar.to_boolean(word).alias("truth")))


def local_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in the local calendar and read back, with month ends and starts."""
    orders = market.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    local = F.concat(F.lpad((F.year("d") - 1911).cast("string"), 3, "0"), F.date_format("d", "MMdd"))
    slashed = F.concat((F.year("d") - 1911).cast("string"), F.date_format("d", "/MM/dd"))
    return orders.select("d", scalar.roc_date(local).alias("compact"), scalar.roc_date(slashed).alias("slashed"), scalar.flexible_date(F.date_format("d", "yyyyMMdd")).alias("flexible"), scalar.month_end(F.col("d")).alias("month_end"), scalar.previous_month_start(F.col("d")).alias("previous_month"))


def price_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return asof.price_status(p.symbols, p.bars, p.day)


def last_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return shown(asof.last_bars_with_total(p.bars.select("symbol", "trade_date", "close", "volume"), p.day, 20))


def valuations_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return shown(asof.valuations_as_of(p.ratios, p.day))


def validation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several runs per symbol and day, the one that counts."""
    p = Panel(spark, sf_dir)
    run = F.explode(F.sequence(F.lit(1), F.lit(3)))
    runs = p.bars.select("symbol", F.col("trade_date").alias("market_date"), "supplier", run.alias("k"))
    status = F.when((F.col("supplier") + F.col("k")) % 4 == 0, "failed").otherwise("success")
    runs = runs.select("symbol", "market_date", status.alias("status"), (F.col("k") % 3).alias("created_at"), F.concat_ws("-", "symbol", F.col("k").cast("string")).alias("run_id"))
    return asof.validation_run(runs, p.day)


def previous_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    rows = p.bars.select("symbol", F.col("trade_date").alias("market_date"), F.when(F.dayofmonth("trade_date") % 3 == 0, "v2").otherwise("v1").alias("methodology"))
    return asof.previous_results(rows)


def merged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return shown(asof.merged_history(p.bars.where(F.dayofmonth("trade_date") < 28), p.second))


def source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    out = asof.sources_union(p.bars.withColumn("endpoint", F.concat(F.lit("/day/"), (F.col("supplier") % 3).cast("string"))), p.second.where(F.col("symbol") >= "0003"), p.ratios.withColumn("endpoint", F.lit("/ratios")))
    return out.select("symbol", F.array_join("sources", ",").alias("sources"), F.array_join("endpoints", ",").alias("endpoints"))


def market_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    days = p.bars.select(F.col("trade_date").alias("day")).distinct()
    closed = days.where(F.dayofmonth("day") == 1)
    return asof.is_market_day(days, closed, p.day)


def latest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return asof.latest_dates(p.bars.select("source", "trade_date").unionByName(p.second.select("source", "trade_date")))


def short_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories cut to start late: some where the listing says so, some not."""
    p = Panel(spark, sf_dir)
    late = p.bars.where(F.col("trade_date") >= F.add_months(F.lit(p.day), -2))
    listed = p.bars.groupBy("symbol", "supplier").agg(F.min(F.when(F.col("trade_date") >= F.add_months(F.lit(p.day), -2), F.col("trade_date"))).alias("first"))
    listed = listed.select("symbol", F.when(F.col("supplier") % 2 == 0, F.col("first")).otherwise(F.lit("1990-01-01").cast("date")).alias("listing_date"))
    return asof.short_history(late, listed, p.day)


def _readiness(p: Panel) -> DataFrame:
    mixed = p.bars.where((F.col("supplier") % 6 != 1) & ((F.col("supplier") % 8 != 3) | (F.col("trade_date") >= F.date_sub(F.lit(p.day), 100)))).select("symbol", "trade_date", F.when(F.col("supplier") % 5 == 2, "synthetic").otherwise(F.col("source")).alias("source"))
    return asof.readiness(p.symbols, mixed, p.day)


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readiness(Panel(spark, sf_dir))


def readiness_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.readiness_totals(_readiness(Panel(spark, sf_dir)))


def resolved_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which trading day a request of each date means."""
    p = Panel(spark, sf_dir)
    return p.bars.select(F.col("trade_date").alias("day")).distinct().select("day", asof.resolved_day(F.col("day"), F.lit(p.day)).alias("resolved"))


def panel_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(windows.panel(Panel(spark, sf_dir).bars))


def panel_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(windows.drawdowns(Panel(spark, sf_dir).bars, (20, 60, 120)))


def whole_history_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(windows.whole_history(Panel(spark, sf_dir).bars))


def research_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return windows.summary(p.bars, p.ratios)


def prior_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest date of each symbol up to the day, and the date of its observation before, however far that is."""
    p = Panel(spark, sf_dir)
    return first_screen.price_inputs(p.recent, p.day).select("symbol", "n", "latest_date", "prior_date")


def first_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(Panel(spark, sf_dir).first()[0])


def first_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = Panel(spark, sf_dir).first()[1]
    return shown(reasons.select("symbol", "code", "metric", "component", "current", "role", "class_priority", "threshold_multiple"))


def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the first screen of every symbol, ranked."""
    return shown(first_screen.candidates(Panel(spark, sf_dir).first()[2]))


def first_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return first_screen.counts(p.first(every=False)[2], p.members())


def input_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of a scan against its members: some lack, some are no members, some come twice."""
    p = Panel(spark, sf_dir)
    key = F.col("supplier")
    copies = F.explode(F.when(key % 5 == 1, F.array(F.lit(1), F.lit(2))).when(key % 5 == 2, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))))
    inputs = p.symbols.select("symbol", copies.alias("k"))
    return first_screen.input_gaps(p.symbols.where(key % 5 != 3), inputs)


def screening_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both sources as the screen sees them."""
    p = Panel(spark, sf_dir)
    rows = p.bars.select("symbol", "source").unionByName(p.second.select("symbol", "source"))
    return rows.groupBy("symbol", first_screen.screening_source(F.col("source")).alias("seen_as")).agg(F.count("*").alias("n"))


def previous_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios given twice, equally or not."""
    p = Panel(spark, sf_dir)
    last = p.ratios.where(F.col("metric_date") == F.lit(p.before))
    other = last.select("symbol", "name", F.when(F.col("symbol").cast("int") % 3 == 1, F.col("value") + 1).when(F.col("symbol").cast("int") % 3 == 2, F.lit(None)).otherwise(F.col("value")).alias("value"))
    return shown(first_screen.merged_previous(last.select("symbol", "name", "value").unionByName(other)))


def universe_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Panel(spark, sf_dir).members()


def universe_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.conflicts(Panel(spark, sf_dir).feeds)


def universe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.status_counts(Panel(spark, sf_dir).members())


def class_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the next day from those of the day and the new identities."""
    feeds = Panel(spark, sf_dir).feeds
    return universe.assigned_classes(feeds["classification"], universe.merged(feeds["identity"])[0])


def feed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a feed is all of the day: the day's bars are, the week's aren't, an empty one isn't."""
    p = Panel(spark, sf_dir)
    cases = {"day": p.bars.where(F.col("trade_date") == F.lit(p.day)), "week": p.bars.where(F.col("trade_date").between(F.date_sub(F.lit(p.day), 6), F.lit(p.day))), "none": p.bars.where("symbol = ''")}
    parts = [universe.feed_date_agrees(f, p.day).withColumn("feed", F.lit(k)) for k, f in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.watchlist_revision(Panel(spark, sf_dir).symbols, 7)


def _second(p: Panel, failing: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    metrics, reasons, evaluated = p.first()
    best = durable(first_screen.candidates(evaluated))
    outcome, _ = compare.latest_day(p.recent, p.recent_second, p.day)
    states = second_screen.states_of(best, p.recent, p.day, outcome)
    deep = second_screen.metrics(best, p.recent, p.recent_ratios, p.day, metrics)
    failed = best.where("rank % 4 = 2").select("symbol") if failing else None
    deep = durable(second_screen.isolated(deep, failed) if failing else deep)  # sixteen rows a candidate
    why = durable(second_screen.reasons(deep, reasons.join(F.broadcast(best.select("symbol")), "symbol", "left_semi"), states))
    return best, why, second_screen.ranked(best, why, states, failed)


def second_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deep metrics of every symbol, not of the candidates alone."""
    p = Panel(spark, sf_dir)
    return shown(second_screen.metrics(p.symbols.select("symbol"), p.recent, p.recent_ratios, p.day, p.first()[0]))


def second_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_second(Panel(spark, sf_dir))[1])


def second_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_second(Panel(spark, sf_dir))[2])


def failed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of symbols of which some couldn't be analysed."""
    p = Panel(spark, sf_dir)
    deep = second_screen.price_metrics(p.symbols.select("symbol"), p.recent, p.day)
    return second_screen.isolated(deep, p.symbols.where("supplier % 4 = 2")).groupBy("metric", "status").agg(F.count("*").alias("n"), F.count("current").alias("known"), F.sum("observations").alias("observations"))


def failed_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final ranking where some candidates' analysis failed: they keep a place."""
    return shown(_second(Panel(spark, sf_dir), failing=True)[2])


def report_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates as a report lists them, with the codes of their nested reasons."""
    _, why, ranked = _second(Panel(spark, sf_dir))
    rows = results.report_rows(ranked, why)
    return rows.select("final_rank", "symbol", "quality", "kind", F.coalesce(F.array_join(F.transform("reasons", lambda r: r["code"]), ","), F.lit("")).alias("codes"), "notice")


def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of a report: counts of the scan, and what stands behind its candidates."""
    p = Panel(spark, sf_dir)
    made, rows, _, _ = _versions(p)
    evaluated = durable(p.first()[2])
    best = durable(first_screen.candidates(evaluated))
    counts = first_screen.counts(evaluated, p.symbols)
    return results.report_totals(counts, best, second_screen.provenance(best, made, rows), 30)


def candidate_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands behind every symbol: its version, states, counts and sources by role."""
    p = Panel(spark, sf_dir)
    made, rows, _, _ = _versions(p)
    return second_screen.provenance(p.symbols, made, rows).drop("version_id", "parent_id", "provenance_sha256")


def latest_day_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return compare.latest_day(p.bars, p.second, p.day)[0]


def history_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return shown(compare.history_differences(compare.histories(p.bars, p.second, p.day)))


def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    left = p.bars.where(F.dayofmonth("trade_date") != 3)
    return compare.history_summary(compare.histories(left, p.second, p.day, 250))


def differences_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return compare.differences_by_field(compare.history_differences(compare.histories(p.bars, p.second, p.day)))


def coverage_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return compare.covered(p.bars, p.second.where(F.col("symbol") != "0002"), p.day, 60)


def _versions(p: Panel) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Versions for the day: the primary source lacks the 20th and later days of months, the secondary the 13th."""
    last = p.lasting(60)  # all dates of these bars are required, and no others
    required = last.select("symbol", "trade_date")
    canonical = last.where((F.dayofmonth("trade_date") < 20) | (F.col("supplier") % 3 == 0))
    other = market.second_bars(last).where("cast(symbol as int) % 19 <> 4")
    made, rows = versions.build(canonical, other, other.join(canonical.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_semi"), required, p.day)
    made, rows = durable(made), durable(rows)  # versions are stored tables
    return made, rows, required, last.where(F.dayofmonth("trade_date") >= 20)


def version_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(Panel(spark, sf_dir))[0].select("symbol", "target_date", "required", "canonical", "supplemental", "missing", "remaining", "status")


def version_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows, _, _ = _versions(Panel(spark, sf_dir))
    return rows.groupBy("symbol", "provider", "role", "selected").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def version_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected rows of named versions, here those of every second symbol."""
    made, rows, _, _ = _versions(Panel(spark, sf_dir))
    return shown(asof.version_snapshot(rows, made.where("cast(symbol as int) % 2 = 0")).select("symbol", "trade_date", "provider", "role", "close", "volume"))


def validation_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources' rows of each version's last canonical date."""
    made, rows, _, _ = _versions(Panel(spark, sf_dir))
    last = rows.where("role = 'canonical'").groupBy("version_id").agg(F.max("trade_date").alias("target_date"))
    return asof.validation_view(rows, last).join(made.select("version_id", "symbol"), "version_id").drop("version_id")


def versions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return history.versions_of(_versions(p)[0], target=p.day, status="provisional_complete").select("symbol", "status", "supplemental")


def version_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, rows, required, late = _versions(Panel(spark, sf_dir))
    children, _ = versions.reconcile(made, rows, late)
    return children.select("symbol", "target_date", "required", "canonical", "supplemental", "missing", "remaining", "status", "discrepancies")


def version_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each symbol stands after reconciliation; some have a second complete or a second open version."""
    made, rows, required, late = _versions(Panel(spark, sf_dir))
    children, _ = versions.reconcile(made, rows, late.where("cast(symbol as int) % 4 <> 1"))
    twice = made.where("cast(symbol as int) % 7 = 2").withColumn("version_id", F.concat(F.lit("x"), "version_id"))
    return versions.leaves(made.unionByName(children).unionByName(twice)).select("symbol", "target_date", "leaf_state", F.col("version_id").isNotNull().alias("named"))


def _targets(p: Panel) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions for the day and for the market day before, their rows, and late canonical bars: of every second symbol all, of the
    others those from the 25th of a month on."""
    last, day = p.last_of_both(60), F.dayofmonth("trade_date")
    other = market.second_bars(last).where("cast(symbol as int) % 19 <> 4")
    made, rows = versions.build(last.where((day < 20) | (F.col("supplier") % 3 == 0)), other, other.where("1 = 0"), p.required(last))
    return durable(made), durable(rows), last.where((day >= 25) | ((day >= 20) & (F.col("supplier") % 2 == 0)))


def target_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of versions for two target dates of each symbol: late bars that only one of them has change only that one."""
    children, _ = versions.reconcile(*_targets(Panel(spark, sf_dir)))
    return children.select("symbol", "target_date", "required", "canonical", "supplemental", "missing", "remaining", "status", "discrepancies")


def reconciliation_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each supplemental date: equal, discrepant, or still pending."""
    return versions.reconciliation_dates(*_targets(Panel(spark, sf_dir))).drop("version_id")


def version_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of versions, from their content."""
    return _versions(Panel(spark, sf_dir))[0].select("symbol", "target_date", "version_id", "provenance_sha256")


def version_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and tips of a version for every month of each symbol. It comes from the month before that has bars; those of
    some months begin anew, and some branch off the month before that."""
    months = Panel(spark, sf_dir).bars.select("symbol", "supplier", F.trunc("trade_date", "month").alias("month")).distinct()
    name = F.concat_ws("/", "symbol", F.date_format("month", "yyyy-MM"))
    by_month = Window.partitionBy("symbol").orderBy("month")
    branch = (F.col("supplier") % 3 == 0) & (F.month("month") % 5 == 0)
    parent = F.when(F.month("month") % 7 == 0, None).when(branch, F.lag("version_id", 2).over(by_month)).otherwise(F.lag("version_id").over(by_month))
    return versions.ancestry(months.withColumn("version_id", name).withColumn("parent_id", parent))


def version_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each ancestor of the first reconciled version is."""
    made, rows, required, late = _versions(Panel(spark, sf_dir))
    children, _ = versions.reconcile(made, rows, late)
    every = durable(made.unionByName(children.select(made.columns)))
    child = every.where("parent_id is not null").agg(F.min_by("version_id", "symbol").alias("v")).first().v
    return versions.lineage(every, child or "").join(every.select("version_id", "symbol", "status"), "version_id").drop("version_id")


def broken_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of versions after some were spoilt: selected against their role, of another source, or doubled."""
    _, rows, _, _ = _versions(Panel(spark, sf_dir))
    k = F.col("symbol").cast("int") % 7
    spoilt = rows.withColumn("selected", F.when(k == 1, ~F.col("selected")).otherwise(F.col("selected"))).withColumn("provider", F.when(k == 2, "other").otherwise(F.col("provider")))
    doubled = spoilt.select("*", F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
    return versions.role_violations(doubled).groupBy("problem").agg(F.count("*").alias("n"))


def broken_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of which some were spoilt, each with the first rule it breaks."""
    made = versions.described(_versions(Panel(spark, sf_dir))[0])
    k = F.col("symbol").cast("int") % 8
    change = lambda c, n, v: F.when(k == n, v).otherwise(F.col(c)).alias(c)
    spoilt = made.select(
        "version_id", "symbol", "canonical", "supplemental", "discrepancies", change("required", 7, F.lit(0).cast("long")), change("missing", 1, F.col("missing") + 1), change("selected", 2, F.col("selected") - 1),
        change("coverage_complete", 3, ~F.col("coverage_complete")), change("authority", 4, F.lit("reconciled")), change("reconciliation", 5, F.lit("reconciled_equal")), change("source", 6, F.lit("reconciled")),
    )
    return versions.state_violations(spoilt).join(made.select("version_id", "symbol"), "version_id").select("symbol", "problem")


def reconcile_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked of reconciliation, spoilt for some symbols, with the rule that each breaks."""
    p = Panel(spark, sf_dir)
    made, rows, _, _ = _versions(p)
    k = F.col("symbol").cast("int") % 11
    open_ = rows.where("role = 'supplemental'").join(made.select("version_id", "status"), "version_id")
    closed = rows.join(made.where("status = 'canonical_complete'").select("version_id", "status"), "version_id").where("role = 'canonical'")
    closed = closed.groupBy("version_id", "symbol").agg(F.min("trade_date").alias("trade_date"))
    canonical = rows.where("role = 'canonical'").groupBy("version_id", "symbol").agg(F.min("trade_date").alias("trade_date")).where(k == 6)
    future = made.where((k == 5) & (F.col("status") == "provisional_complete")).select("version_id", "symbol", F.date_add("target_date", 1).alias("trade_date"))
    asked = open_.select("version_id", "symbol", "trade_date").unionByName(closed).unionByName(canonical).unionByName(future).distinct()
    first = asked.groupBy("version_id").agg(F.min("trade_date").alias("first_date"))
    targets = asked.join(first, "version_id").where(~((k == 4) & (F.col("trade_date") == F.col("first_date")))).select("version_id", "trade_date", F.lit("r1").alias("run_id"))
    copies = F.explode(F.when(k == 1, F.array().cast("array<int>")).when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    arrived = asked.select("version_id", "symbol", "trade_date", F.when(k == 2, "secondary").otherwise("primary").alias("provider"), F.lit("canonical").alias("role"), F.lit(True).alias("selected"), F.when(k == 7, "r2").otherwise("r1").alias("run_id"), copies.alias("copy"))
    return versions.reconcile_problems(made, rows, arrived.drop("copy"), targets).join(made.select("version_id", "symbol"), "version_id").select("symbol", "problem")


def version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return versions.gate(p.members(), _versions(p)[0])


def plain_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return versions.from_plain_history(p.bars, p.day)


def _candidates(p: Panel) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Required dates, both sources' rows, and what is known of the other source's run of each symbol."""
    required = durable(asof.last_bars(p.recent.select("symbol", "trade_date", "supplier"), p.day, 60))
    of = lambda t: t.join(required.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_semi")
    canonical = of(p.recent.where((F.dayofmonth("trade_date") < 20) | (F.col("supplier") % 3 == 0)))
    other = of(p.recent_second.where(F.dayofmonth("trade_date") != 28)).where("dayofmonth(trade_date) <> 27 or cast(symbol as int) % 4 <> 0")
    key = F.col("symbol").cast("int")
    copies = F.explode(F.when(key % 23 == 6, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))  # dates that come twice
    other = other.withColumn("copy", copies).drop("copy")
    canonical = canonical.withColumn("copy", F.explode(F.when(key % 5 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    spans = required.groupBy("symbol").agg(F.min("trade_date").alias("start_date"))
    shaped = other.join(spans, "symbol").withColumn("target_date", F.lit(p.day)).withColumn("position", F.datediff("trade_date", F.lit("1970-01-01").cast("date")))
    shaped = shaped.withColumn("open", F.when((key % 17 == 5) & (F.dayofmonth("trade_date") == 25), -1.0).otherwise(F.col("open")))
    failures = (*versions.FILLABLE, *versions.NOT_FILLABLE[:2])
    failure = F.element_at(F.array(*[F.lit(f) for f in failures]), (key % 8 + 1).cast("int"))
    failure = F.when(key % 8 < 6, failure).otherwise("temporary")
    names = F.struct(F.col("symbol").alias("symbol"), F.lit("TSE").alias("market"), F.lit("TWSE").alias("exchange"), F.lit("TWD").alias("currency"), F.lit("EQUITY").alias("security_type"))
    returned = F.struct(*(F.when(key % 29 == n, "?").otherwise(names[d]).alias(d) for n, d in enumerate(versions.IDENTITY, 10)))
    known = spans.select("symbol", F.lit(p.day).alias("target_date"), failure.alias("failure"), (key % 31 != 9).alias("evidence_ok"), names.alias("requested"), F.when(key % 29 != 9, returned).alias("returned"), (key % 37 != 12).alias("security_ok"), F.lit(None).cast("string").alias("canonical_problem"))
    return required, canonical, other, known.join(versions.structure(shaped), "symbol", "left")


def identity_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _candidates(Panel(spark, sf_dir))[3]
    status = versions.identity_status(F.col("symbol"), F.col("requested"), F.col("returned"))
    return known.select("symbol", status.alias("status"), versions.identity_reason(status).alias("reason"))


def structure_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the other source, spoilt in one way for each remainder of the symbol, with what is wrong with them."""
    p = Panel(spark, sf_dir)
    rows = asof.last_bars(p.recent_second, p.day, 60)
    k, rn = F.col("symbol").cast("int") % 9, F.col("rn")
    later = F.lag("trade_date").over(windows.by_date())
    rows = rows.withColumn("before", later).select(
        "symbol", F.when((k == 2) & (rn == 1), F.col("before")).otherwise(F.col("trade_date")).alias("trade_date"), F.when(((k == 5) & (rn == 3)) | ((k == 6) & (rn == 2)), F.lit(None)).otherwise(F.col("open")).alias("open"),
        "high", "low", "close", F.when((k == 6) & (rn == 4), -1).otherwise(F.col("volume")).alias("volume"), F.when((k == 7) & (rn == 5), "ZZZZ").alias("row_symbol"),
        F.when(k == 4, F.lit(p.day)).otherwise(F.lit("1900-01-01").cast("date")).alias("start_date"), F.when(k == 3, F.date_sub(F.lit(p.day), 2000)).otherwise(F.lit(p.day)).alias("target_date"), F.when(k == 1, rn).otherwise(-rn).alias("position"),
    )
    return versions.structure(rows)


def _decisions(p: Panel) -> DataFrame:
    required, canonical, other, known = _candidates(p)
    return versions.eligibility(versions.date_sets(required, canonical, other), known)


def supplement_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(Panel(spark, sf_dir))


def supplement_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each symbol goes, some having a stored version already; those for another target date don't count."""
    p = Panel(spark, sf_dir)
    k = F.col("supplier")
    known = p.symbols.select("symbol", F.when(k % 5 == 0, "open").when(k % 5 == 1, "complete").when(k % 25 == 2, "ambiguous").alias("leaf_state"), F.lit(p.day).alias("target_date")).where("leaf_state is not null")
    known = known.unionByName(p.symbols.select("symbol", F.lit("complete").alias("leaf_state"), F.lit(p.before).alias("target_date")))
    return versions.routed(_decisions(p), known).groupBy("route", "reason").agg(F.count("*").alias("symbols"))


def daily_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen metrics of every symbol as of the day."""
    p = Panel(spark, sf_dir)
    return shown(results.daily_as_of(p.symbols, p.bars, p.day))


def result_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Panel(spark, sf_dir).bars.select("symbol", F.col("trade_date").alias("market_date"))
    return rows.select("symbol", "market_date", results.result_id("v1").alias("result_id"))


def result_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change worth telling, on every date of every symbol, by metric and kind."""
    found = results.history_changes(Panel(spark, sf_dir).bars)
    return shown(found.groupBy("symbol", "metric", "change").agg(F.count("*").alias("changes"), F.max("delta").alias("greatest"), F.max("market_date").alias("last_date")))


def ratio_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the ratios of the results on even days, so that values are carried forward in between."""
    p = Panel(spark, sf_dir)
    days = p.bars.where(F.dayofmonth("trade_date") % 2 == 0).select("symbol", F.col("trade_date").alias("market_date"))
    found = results.valuation_changes(results.daily_valuations(days, p.ratios.where(F.dayofmonth("metric_date") % 3 == 0)))
    return shown(found.groupBy("symbol", "name", "change").agg(F.count("*").alias("changes"), F.max("market_date").alias("last_date"), F.max("as_of_date").alias("as_of_date"), F.max("value").alias("greatest")))


def volume_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = windows.panel(Panel(spark, sf_dir).bars).select("symbol", F.col("trade_date").alias("market_date"), "volume_state")
    return results.state_changes(states, "volume_state")


def discrepancy_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    paired = compare.histories(p.bars, p.second, p.day)
    days = paired.where("presence = 'common'").select("symbol", F.col("trade_date").alias("market_date"))
    return results.discrepancy_changes(compare.history_differences(paired).withColumnRenamed("trade_date", "market_date"), days)


def result_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    outcome, differences = compare.latest_day(p.bars, p.second, p.day)
    return results.quality(asof.price_status(p.symbols, p.bars, p.day), outcome, differences)


def result_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    return results.provenance(p.bars.select("symbol", "trade_date", "source").unionByName(p.second.select("symbol", "trade_date", "source")), p.ratios)


def _runs(p: Panel) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run for each date: its candidates are bars with a large move against the open, its reasons say which way."""
    day = F.dayofmonth("trade_date")
    runs = p.bars.groupBy("trade_date").agg(F.count("*").alias("n")).select(F.col("trade_date").cast("string").alias("run_id"), F.col("trade_date").alias("market_date"), F.when(day % 2 == 0, "v2").otherwise("v1").alias("methodology"), F.when(day % 7 == 0, "failed").when(day % 11 == 0, "open").otherwise("succeeded").alias("status"))
    move = (F.col("close") / F.col("open") - 1) * 100
    picked = p.bars.withColumn("move", move).where(F.abs("move") >= 1.5)
    key = F.col("supplier")
    status = F.element_at(F.array(*[F.lit(s) for s in versions.STATES]), (key % 5 + 1).cast("int"))
    plain = (day == 17) | ((day == 13) & (key % 2 == 0))  # runs without versions, and runs that mix both kinds
    state = F.when((day == 19) & (key % 2 == 0) | (day == 18), "failed").when((day == 16) & (key % 3 == 0), "open").otherwise("done")
    candidates = picked.select(
        F.col("trade_date").cast("string").alias("run_id"), "symbol", F.lit(1).alias("rank"), F.when(F.col("volume") > 60, "warning").otherwise("clean").alias("quality"), status.alias("version_status"), F.when(~plain, F.concat("symbol", F.lit("-"), status)).alias("version_id"),
        (60 - key % 4).alias("canonical"), (key % 4).alias("supplemental"), (key % 4).alias("missing"), (key % 5).alias("discrepancies"), F.when(key % 8 < 4, "secondary").otherwise("third").alias("supplemental_source"), F.col("source").alias("provider"), state.alias("state"),
    )
    reasons = picked.select(F.col("trade_date").cast("string").alias("run_id"), "symbol", F.lit("first").alias("stage"), F.when(F.col("move") > 0, "rise").otherwise("fall").alias("code"), F.lit("move").alias("metric"))
    heavy = picked.where("volume > 60").select(F.col("trade_date").cast("string").alias("run_id"), "symbol", F.lit("second").alias("stage"), F.lit("heavy").alias("code"), F.lit("volume").alias("metric"))
    return runs, candidates, reasons.unionByName(heavy)


def selections_per_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, candidates, _ = _runs(Panel(spark, sf_dir))
    return history.selections_per_symbol(candidates, runs)


def reason_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, _, reasons = _runs(Panel(spark, sf_dir))
    return history.reason_frequency(reasons, runs)


def daily_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of the last sealed run up to the day."""
    p = Panel(spark, sf_dir)
    runs, candidates, _ = _runs(p)
    last = history.sealed(runs).where(F.col("market_date") <= F.lit(p.day)).agg(F.max("market_date").alias("d")).first().d
    return history.daily_candidates(candidates, runs, last).select("run_id", "symbol", "rank", "quality", "version_status", "market_date", "methodology")


def quality_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, candidates, _ = _runs(Panel(spark, sf_dir))
    return history.quality_frequency(candidates, runs)


def date_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, candidates, _ = _runs(Panel(spark, sf_dir))
    return history.date_totals(candidates, runs)


def symbol_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, candidates, reasons = _runs(Panel(spark, sf_dir))
    return history.symbol_history(candidates, reasons, runs)


def methodology_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, candidates, _ = _runs(Panel(spark, sf_dir))
    return history.methodology_comparison(candidates, runs, "v1", "v2")


def run_roll_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.run_status(_runs(Panel(spark, sf_dir))[1])


def run_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.run_quality(_runs(Panel(spark, sf_dir))[1])


def batch_roll_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch per order, a task per line."""
    lines = market.table(spark, sf_dir, "lineitem")
    tasks = lines.select(F.col("l_orderkey").alias("batch_id"), F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "skipped").otherwise("success").alias("outcome"))
    return history.batch_status(tasks)


def bar_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.coverage(Panel(spark, sf_dir).bars, "symbol")


def timestamp_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When both sources say that they were updated."""
    p = Panel(spark, sf_dir)
    day = F.dayofmonth("trade_date")
    at = p.bars.select("symbol", "trade_date", F.col("trade_date").cast("timestamp").alias("l"), F.when(day == 9, F.lit(None)).when(day == 11, F.timestamp_seconds(F.unix_seconds(F.col("trade_date").cast("timestamp")) + 1)).otherwise(F.col("trade_date").cast("timestamp")).alias("r"))
    return at.groupBy("symbol", compare.timestamp_state(F.col("l"), F.col("r")).alias("state")).agg(F.count("*").alias("n"))


def rendered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as text, as a difference is shown."""
    rows = Panel(spark, sf_dir).bars.select(F.col("close").alias("c")).distinct()
    return rows.select(F.round(F.col("c") * 100).cast("long").alias("cents"), compare.shown(F.col("c")).alias("text"))


def table_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = market.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return history.digest(orders).select("rows", F.col("digest").cast("string").alias("digest"))


ALL: tuple[Query, ...] = (
    bars, valuation_rows, bar_checks, repeated_orders, batch_identity, source_roles, text_forms, local_dates, price_status, last_bars, valuations_as_of,
    validation_runs, previous_results, merged_history, source_lists, market_days, resolved_days, latest_dates, short_histories, readiness, readiness_totals, panel_indicators, panel_drawdowns,
    whole_history_risk, research_summary, prior_dates, first_metrics, first_reasons, first_candidates, first_counts, input_gaps, screening_sources, previous_conflicts,
    universe_members, universe_conflicts, universe_counts, class_assignments, feed_dates, watchlist, second_metrics, second_reasons, second_ranking, failed_metrics, failed_ranking,
    report_reasons, report_totals, candidate_provenance, latest_day_outcomes, history_differences, history_summary, differences_by_field, coverage_condition, timestamp_states, rendered_values,
    version_coverage, version_roles, version_snapshots, validation_views, versions_of, version_reconciliation, version_leaves, version_lineage, target_reconciliation, reconciliation_dates, version_ids, version_ancestry, broken_rows, broken_versions, reconcile_inputs,
    version_gate, plain_versions, identity_statuses, structure_problems, supplement_decisions, supplement_routes, daily_results, result_ids, result_changes, ratio_changes,
    volume_state_changes, discrepancy_changes, result_quality, result_provenance, selections_per_symbol, reason_frequency, daily_candidates, quality_frequency,
    date_totals, symbol_reasons, methodology_comparison, run_roll_ups, run_quality, batch_roll_ups, bar_coverage, table_digests,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (*ALL, *reading.ALL, *kept.ALL)}
