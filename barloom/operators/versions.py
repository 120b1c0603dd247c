"""Dataset versions: which rows of which source a symbol's history is made of, and why.

A version is one symbol's history for a target date. Canonical rows are selected; supplemental rows of
the other source fill dates that the canonical one lacks, if that is allowed; validation rows are kept but
never selected. Versions don't change: a later one names its parent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import content_id, first_of, group_id
from barloom.functions.session import durable
from barloom.operators.validate import bar_problem
from barloom.schemas import OHLCV

# Failures of the canonical source after which the other may fill in, and those after which it may not.
FILLABLE = ("temporary", "delayed", "pacing_blocked", "timeout")
NOT_FILLABLE = ("malformed", "permanent", "identity_mismatch", "unavailable")

# What a version's status says of its sources, their authority, reconciliation and quality.
STATES = {
    "canonical_complete": ("canonical_complete", "complete", "not_applicable", "canonical"),
    "provisional_complete": ("provisional_mixed", "incomplete", "pending", "provisional"),
    "reconciliation_pending": ("provisional_mixed", "incomplete", "pending", "provisional"),
    "reconciled_equal": ("reconciled", "reconciled", "reconciled_equal", "reconciled"),
    "reconciled_discrepant": ("reconciled", "reconciled", "reconciled_discrepant", "reconciled"),
}
OPEN = ("provisional_complete", "reconciliation_pending")
COMPLETE = ("canonical_complete", "reconciled_equal", "reconciled_discrepant")

# The dimensions of an instrument's identity in order, and the reason each mismatch gives.
IDENTITY = {"symbol": "identity_mismatch", "market": "market_mismatch", "exchange": "identity_mismatch", "currency": "currency_mismatch", "security_type": "security_type_mismatch"}
KEY = ("symbol", "target_date")
# Which source may hold which role.
PROVIDERS = {"canonical": ("primary",), "supplemental": ("secondary",), "validation": ("primary", "secondary")}


def states(status: Column) -> Column:
    """(source, authority, reconciliation, quality) of a version's status; null for an unknown one."""
    part = lambda k: first_of(*((status == s, v[k]) for s, v in STATES.items()))
    return F.struct(*(part(k).alias(n) for k, n in enumerate(("source", "authority", "reconciliation", "quality"))))


def identity_status(symbol: Column, requested: Column, returned: Column) -> Column:
    """Whether the instrument that a source returned is the one asked for: five dimensions in their order, the
    first that differs names the status. Both are structs of the dimensions; one that lacks is unavailable."""
    differs = lambda k: ~requested[k].eqNullSafe(returned[k])
    own = ~requested["symbol"].eqNullSafe(symbol)
    cases = [((own | differs(k)) if k == "symbol" else differs(k), f"{k}_mismatch") for k in IDENTITY]
    return first_of((requested.isNull() | returned.isNull(), "unavailable"), *cases, otherwise="verified")


def identity_reason(status: Column) -> Column:
    """The reason of a decision that an identity status gives; none if it is verified."""
    return first_of((status == "verified", F.lit(None).cast("string")), (status == "unavailable", "instrument_unavailable"), *((status == f"{k}_mismatch", r) for k, r in IDENTITY.items()), otherwise="unknown_fail_closed")


def structure(rows: DataFrame, order: str = "position") -> DataFrame:
    """(symbol, problem) of a source's run: checks of the whole run first - dates there and ascending, once each,
    none in the future, none before the start - then of the first bad row.

    Rows have start_date and target_date beside the bar, ``order`` is their place in the source, and
    ``row_symbol``, if there is one, the symbol that the row itself names."""
    prices = [F.col(c).isNull().cast("int") for c in OHLCV[:4]]
    lacking = sum(prices[1:], prices[0])
    own = [(F.col("row_symbol").isNotNull() & (F.col("row_symbol") != F.col("symbol")), "identity_mismatch")] if "row_symbol" in rows.columns else []
    problem = first_of(*own, (lacking.between(1, 3), "partial_ohlc"), (bar_problem().isNotNull(), "malformed_payload"))
    back = F.lag("trade_date").over(Window.partitionBy("symbol").orderBy(order))
    judged = rows.select("symbol", "trade_date", "start_date", "target_date", F.col(order).alias("place"), back.alias("back"), problem.alias("row_problem"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = judged.groupBy("symbol").agg(
        some(F.col("trade_date").isNull() | (F.col("trade_date") < F.col("back"))).alias("unordered"), some(F.col("trade_date") == F.col("back")).alias("repeated"),
        some(F.col("trade_date") > F.col("target_date")).alias("future"), some(F.col("trade_date") < F.col("start_date")).alias("early"),
        F.min_by("row_problem", F.when(F.col("row_problem").isNotNull(), F.col("place"))).alias("row_problem"),
    )
    return per.select("symbol", first_of((F.col("unordered"), "malformed_payload"), (F.col("repeated"), "duplicate_trade_date"), (F.col("future"), "future_trade_date"), (F.col("early"), "unexpected_observation_date"), otherwise=F.col("row_problem")).alias("problem"))


def date_sets(required: DataFrame, canonical: DataFrame, other: DataFrame) -> DataFrame:
    """A row per symbol and date of either source or the required dates - and per target date, if the required dates
    have one: whether it is required, which source has it (c, s), and whether any of their rows differ. Rows
    that repeat a date make it no second one."""
    keys = [c for c in KEY if c in required.columns]
    of_targets = lambda t: t if "target_date" in t.columns or len(keys) == 1 else t.join(required.select(*keys).distinct(), "symbol").where("trade_date <= target_date")
    side = lambda t, n: of_targets(t).select(*keys, "trade_date", F.struct(*OHLCV).alias(n))
    need = required.select(*keys, "trade_date", F.lit(True).alias("required"))
    joined = need.join(side(canonical, "c"), [*keys, "trade_date"], "full").join(side(other, "s"), [*keys, "trade_date"], "full")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return joined.groupBy(*keys, "trade_date").agg(some(F.col("required")).alias("required"), (F.count("c") > 0).alias("c"), (F.count("s") > 0).alias("s"), some(F.col("c") != F.col("s")).alias("differs"))


def eligibility(sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """The decision per symbol, by the first case that applies, and the counts of dates behind it.

    Dates are counted once each, however often a source has them. With target dates in ``sets`` and
    ``candidates`` there is a decision for each. ``candidates`` has symbol, failure (class of the canonical source's failure), evidence_ok (null if there is
    no evidence to doubt), requested and returned (structs of the identity), security_ok, problem and
    canonical_problem (of the structure checks). Rejected are all dates of the other source where it was
    refused, and those that both have where it wasn't."""
    keys = [k for k in KEY if k in sets.columns]
    c, s = F.col("c"), F.col("s")
    missing = F.col("required") & ~c
    facts = sets.groupBy(*keys).agg(
        F.count_if(missing).alias("missing"), F.count_if(missing & s).alias("eligible"), F.count_if(c & s).alias("overlap"), F.count_if(s).alias("other"),
        F.count_if("differs").alias("differing"), F.count_if(s & ~c & ~F.col("required")).alias("unexpected"),
    )
    joined = candidates.join(facts, keys, "left").fillna(0, ["missing", "eligible", "overlap", "other", "differing", "unexpected"])
    joined = joined.withColumn("identity", identity_status(F.col("symbol"), F.col("requested"), F.col("returned")))
    before = [
        (F.col("missing") == 0, "not_needed"),
        (~F.coalesce(F.col("failure").isin(*FILLABLE), F.lit(False)), "failure_not_eligible"),
        (~F.col("evidence_ok"), "unknown_fail_closed"),
    ]
    after = [
        (F.col("identity") != "verified", identity_reason(F.col("identity"))),
        (~F.coalesce("security_ok", F.lit(False)), "security_boundary_failed"),
        (F.col("other") == 0, "insufficient_supplemental_coverage"),
        (F.col("problem").isNotNull(), F.col("problem")),
        (F.col("canonical_problem").isNotNull(), "unknown_fail_closed"),
        (F.col("unexpected") > 0, "unexpected_observation_date"),
        (F.col("differing") > 0, "overlap_discrepancy"),
    ]
    accepted = first_of(*((cond, F.lit(False)) for cond, _ in [*before, *after]), otherwise=F.lit(True))
    out = joined.select("*", accepted.alias("accepted"), first_of(*before, *after, (F.col("eligible") < F.col("missing"), "insufficient_supplemental_coverage"), otherwise="eligible_verified_supplemental").alias("reason"))
    through = F.col("accepted") & (F.col("eligible") > 0)
    looked = first_of(*((cond, F.lit("not_checked")) for cond, _ in before), otherwise=F.col("identity"))
    overlap = F.when(F.col("reason") == "overlap_discrepancy", "discrepancy").when(F.col("accepted") & (F.col("overlap") > 0), "exact_match").otherwise("not_applicable")
    return out.select(
        *(k for k in KEY if k in candidates.columns), "reason", through.alias("is_eligible"), looked.alias("identity_status"), overlap.alias("overlap_status"), "missing", F.when(through, F.col("eligible")).otherwise(0).alias("eligible_dates"),
        F.when(F.col("reason") == "not_needed", 0).when(F.col("accepted"), F.col("overlap")).otherwise(F.col("other")).alias("rejected_dates"),
        F.when(through, F.col("missing") - F.col("eligible")).otherwise(F.col("missing")).alias("remaining_dates"), F.col("reason").isin("not_needed", "eligible_verified_supplemental").alias("coverage_complete"),
    )


def row_hash() -> Column:
    return content_id(F.col("symbol"), F.col("trade_date"), *(F.col(c) for c in OHLCV), F.col("provider"))


def build(canonical: DataFrame, supplemental: DataFrame, validation: DataFrame, required: DataFrame, target=None) -> tuple[DataFrame, DataFrame]:
    """(versions, observations) with one version per symbol whose required dates are all covered: canonical, or
    provisional where the other source fills in. What is incomplete becomes no version.

    Without ``target`` the required dates have a target_date each, and a symbol gets a version for each, of the
    rows up to it. Supplemental rows on dates that are canonical, or not required, are left out of the selection."""
    if target is not None:
        required = required.withColumn("target_date", F.lit(target))
    targets = required.select(*KEY).distinct()
    given = lambda t: t.withColumn("target_date", F.lit(target)) if target is not None else t.join(targets, "symbol").where("trade_date <= target_date")
    role = lambda t, r, s: given(t).select(*KEY, "trade_date", *OHLCV, F.col("source").alias("provider"), F.lit(r).alias("role"), F.lit(s).alias("selected"))
    dates = [*KEY, "trade_date"]
    main = role(canonical, "canonical", True)
    fill = role(supplemental, "supplemental", True).join(required.select(dates).hint("merge"), dates, "left_semi").join(main.select(dates).hint("merge"), dates, "left_anti")  # both grow with the bars, so they aren't sent to all
    rows = durable(main.unionByName(fill).unionByName(role(validation, "validation", False)).withColumn("row_sha256", row_hash()))  # ids, counts and observations are made of them
    ids = rows.groupBy(*KEY).agg(group_id(F.concat_ws(":", "row_sha256", "role")).alias("provenance_sha256")).withColumn("version_id", content_id(F.col("symbol"), F.col("target_date"), F.col("provenance_sha256"), length=32))
    whole = coverage(rows, required).where("remaining = 0")
    versions = ids.join(whole, [*KEY]).select("version_id", *KEY, F.lit(None).cast("string").alias("parent_id"), "provenance_sha256", "required", "canonical", "supplemental", "missing", "remaining", status_of().alias("status"), F.lit(0).cast("long").alias("discrepancies"))
    return versions, rows.join(versions.select(*KEY, "version_id"), [*KEY]).drop("target_date")


def status_of() -> Column:
    return F.when(F.col("supplemental") > 0, "provisional_complete").otherwise("canonical_complete")


def coverage(rows: DataFrame, required: DataFrame) -> DataFrame:
    """Counts per symbol and target date over the required dates: missing is required less canonical, remaining what nothing
    selected covers."""
    chosen = rows.where("selected").select(*KEY, "trade_date", "role")
    dates = required.select(*KEY, "trade_date").join(chosen, [*KEY, "trade_date"], "left").groupBy(*KEY, "trade_date").agg(*(F.coalesce(F.bool_or(F.col("role") == r), F.lit(False)).alias(r) for r in ("canonical", "supplemental")))
    per = dates.groupBy(*KEY).agg(F.count("*").alias("required"), F.count_if("canonical").alias("canonical"), F.count_if("supplemental").alias("supplemental"))
    return per.withColumn("missing", F.col("required") - F.col("canonical")).withColumn("remaining", F.col("missing") - F.col("supplemental"))


def role_violations(rows: DataFrame) -> DataFrame:
    """(version_id, trade_date, problem): rows selected against their role or of a source that can't hold it,
    rows that repeat, and dates with more than one selected row."""
    allowed = F.lit(False)
    for role, sources in PROVIDERS.items():
        allowed = allowed | ((F.col("role") == role) & F.col("provider").isin(*sources))
    per = rows.groupBy("version_id", "trade_date").agg(
        F.bool_or(F.col("selected") != (F.col("role") != "validation")).alias("against"), F.bool_or(~F.coalesce(allowed, F.lit(False))).alias("foreign"),
        (F.count("*") > F.count_distinct("provider", "role", "selected", "row_sha256")).alias("twice"), F.count_if("selected").alias("n"),
    )
    problems = F.array_compact(F.array(F.when(F.col("against"), "selection_against_role"), F.when(F.col("foreign"), "source_against_role"), F.when(F.col("twice"), "row_repeated"), F.when(F.col("n") > 1, "two_selected")))
    return per.select("version_id", "trade_date", F.explode(problems).alias("problem"))


def described(made: DataFrame) -> DataFrame:
    """Versions with the statuses and counts that ``state_violations`` looks at."""
    state = states(F.col("status"))
    selected = F.col("canonical") + F.col("supplemental")
    return made.select("*", *(state[k].alias(k) for k in ("source", "authority", "reconciliation")), selected.alias("selected"), (selected == F.col("required")).alias("coverage_complete"))


def state_violations(made: DataFrame) -> DataFrame:
    """(version_id, problem) of versions whose counts and statuses don't go together, by the first rule they break:
    the identities of coverage, then the matrix of source, authority and reconciliation."""
    have = F.col("canonical") + F.col("supplemental")
    is_ = lambda source: F.col("source") == source
    gaps = F.col("canonical") != F.col("required")
    problem = first_of(
        ((F.col("required") <= 0) | (F.least("canonical", "supplemental", "missing", "discrepancies") < 0), "count_invalid"),
        (have > F.col("required"), "more_than_required"),
        (F.col("missing") != F.col("required") - F.col("canonical"), "missing_count"),
        (F.col("selected") != have, "selected_count"),
        (F.col("coverage_complete") != (have == F.col("required")), "coverage_flag"),
        (is_("canonical_complete") & (F.col("authority") != "complete"), "canonical_authority"),
        (is_("canonical_complete") & (F.col("reconciliation") != "not_applicable"), "canonical_reconciliation"),
        (is_("canonical_complete") & (F.col("supplemental") != 0), "canonical_with_supplement"),
        (is_("canonical_complete") & gaps, "canonical_with_gaps"),
        (is_("provisional_mixed") & (F.col("supplemental") <= 0), "provisional_without_supplement"),
        (is_("provisional_mixed") & (F.col("authority") != "incomplete"), "provisional_authority"),
        (is_("provisional_mixed") & (F.col("reconciliation") != "pending"), "provisional_reconciliation"),
        (is_("reconciled") & (F.col("authority") != "reconciled"), "reconciled_authority"),
        (is_("reconciled") & ~F.col("reconciliation").isin("reconciled_equal", "reconciled_discrepant"), "reconciled_reconciliation"),
        (is_("reconciled") & (F.col("supplemental") != 0), "reconciled_with_supplement"),
        (is_("reconciled") & gaps, "reconciled_with_gaps"),
        ((F.col("reconciliation") == "reconciled_equal") & (F.col("discrepancies") > 0), "equal_with_discrepancies"),
        ((F.col("reconciliation") == "reconciled_discrepant") & (F.col("discrepancies") <= 0), "discrepant_without_discrepancies"),
        (~F.coalesce(F.col("source").isin("canonical_complete", "provisional_mixed", "reconciled"), F.lit(False)), "source_unknown"),
    )
    return made.withColumn("problem", problem).where("problem is not null").select("version_id", "problem")


def reconcile_problems(parents: DataFrame, rows: DataFrame, arrived: DataFrame, targets: DataFrame, canonical: tuple[str, ...] = PROVIDERS["canonical"]) -> DataFrame:
    """(version_id, problem) of every asked reconciliation, null if it may run; the first rule it breaks counts.

    ``targets`` has version_id, trade_date and run_id: the dates asked for, of one source run. ``arrived`` has
    version_id, symbol, trade_date, provider, role, selected and run_id of the rows that came."""
    asked = targets.groupBy("version_id").agg(F.min("run_id").alias("asked_run"), (F.count_distinct("run_id") > 1).alias("runs"))
    came = arrived.join(parents.select("version_id", F.col("symbol").alias("own")), "version_id", "left").join(asked, "version_id", "left")
    proper = (F.col("symbol") == F.col("own")) & F.col("provider").isin(*canonical) & (F.col("role") == "canonical") & F.col("selected") & (F.col("run_id") == F.col("asked_run"))
    by_date = came.groupBy("version_id", "trade_date").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(proper, F.lit(False))).alias("proper"))
    filled = rows.where("selected and role = 'supplemental'").select("version_id", "trade_date", F.lit(True).alias("filled"))
    wanted = targets.select("version_id", "trade_date", F.lit(True).alias("wanted")).distinct()
    each = wanted.join(by_date, ["version_id", "trade_date"], "full").join(filled, ["version_id", "trade_date"], "left")
    each = each.join(parents.select("version_id", "target_date"), "version_id", "left")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = each.groupBy("version_id").agg(
        (F.sum("n").isNull()).alias("none"), some(~F.col("proper")).alias("improper"), some(F.col("n") > 1).alias("twice"), (F.count("wanted") == 0).alias("no_dates"),
        some(F.col("wanted").isNull() | F.col("n").isNull()).alias("differ"), some(F.col("wanted") & (F.col("trade_date") > F.col("target_date"))).alias("future"), some(F.col("wanted") & F.col("filled").isNull()).alias("unfilled"),
    )
    named = parents.select("version_id", states(F.col("status"))["source"].alias("source"))
    joined = per.join(named, "version_id", "left").join(asked.select("version_id", "runs"), "version_id", "left")
    problem = first_of(
        (F.col("source").isNull() | (F.col("source") != "provisional_mixed"), "parent_not_open"),
        (F.col("none"), "no_rows"),
        (F.col("improper") | F.coalesce("runs", F.lit(False)), "rows_not_canonical_of_the_run"),
        (F.col("twice"), "date_repeated"),
        (F.col("no_dates"), "no_dates"),
        (F.col("differ"), "dates_differ"),
        (F.col("future"), "date_in_the_future"),
        (F.col("unfilled"), "date_not_supplemental"),
    )
    return joined.select("version_id", problem.alias("problem"))


def _arrivals(versions: DataFrame, rows: DataFrame, arrived: DataFrame) -> DataFrame:
    """(version_id, trade_date, new_...) of the supplemental rows of open versions for which a canonical row has arrived, each
    with the fields that differ."""
    late = arrived.select("symbol", "trade_date", *(F.col(c).alias(f"new_{c}") for c in OHLCV), F.col("source").alias("new_provider"))
    open_ = versions.where(F.col("status").isin(*OPEN)).select("version_id")
    filled = rows.where("selected and role = 'supplemental'").join(open_, "version_id", "left_semi")
    fields = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"new_{c}")), c) for c in OHLCV]))
    return filled.join(late, ["symbol", "trade_date"]).select("version_id", "trade_date", *(f"new_{c}" for c in OHLCV), "new_provider", fields.alias("differing"))


def reconcile(versions: DataFrame, rows: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children of the open provisional versions for which canonical rows have arrived; parents stay as they are.

    A supplemental row that a canonical one now covers becomes validation, unselected. Counts go on from the
    parent's, as each row that moves makes one supplemental date of that version canonical; so versions of one
    symbol for several target dates don't touch each other."""
    came = _arrivals(versions, rows, arrived)
    per = came.groupBy("version_id").agg(F.count("*").alias("reconciled"), F.count_if(F.size("differing") > 0).alias("wrong"))
    touched = rows.join(per.select("version_id"), "version_id", "left_semi").join(came, ["version_id", "trade_date"], "left")
    moved = F.col("new_provider").isNotNull() & (F.col("role") == "supplemental")
    stays = F.struct(*OHLCV, "provider", F.when(moved, "validation").otherwise(F.col("role")).alias("role"), (F.col("selected") & ~moved).alias("selected"))
    comes = F.struct(*(F.col(f"new_{c}").alias(c) for c in OHLCV), F.col("new_provider").alias("provider"), F.lit("canonical").alias("role"), F.lit(True).alias("selected"))
    child_rows = touched.select("version_id", "symbol", "trade_date", F.explode(F.when(moved, F.array(stays, comes)).otherwise(F.array(stays))).alias("r")).select("version_id", "symbol", "trade_date", "r.*").withColumn("row_sha256", row_hash())
    ids = child_rows.groupBy("version_id", "symbol").agg(group_id(F.concat_ws(":", "row_sha256", "role")).alias("provenance_sha256"))
    ids = ids.withColumn("child_id", content_id(F.col("version_id"), F.col("symbol"), F.col("provenance_sha256"), length=32))
    canonical, supplemental, total = F.col("canonical") + F.col("reconciled"), F.col("supplemental") - F.col("reconciled"), F.col("discrepancies") + F.col("wrong")
    missing = F.col("required") - canonical
    status = F.when((supplemental > 0) | (missing > supplemental), "reconciliation_pending").when(total > 0, "reconciled_discrepant").otherwise("reconciled_equal")
    joined = ids.join(per, "version_id").join(versions.drop("symbol", "provenance_sha256", "parent_id", "status"), "version_id")
    children = joined.select(
        F.col("child_id").alias("version_id"), *KEY, F.col("version_id").alias("parent_id"), "provenance_sha256", "required", canonical.alias("canonical"), supplemental.alias("supplemental"), missing.alias("missing"),
        (missing - supplemental).alias("remaining"), status.alias("status"), total.alias("discrepancies"),
    )
    return children, child_rows.join(ids.select("version_id", "child_id"), "version_id").drop("version_id").withColumnRenamed("child_id", "version_id")


def reconciliation_dates(versions: DataFrame, rows: DataFrame, arrived: DataFrame) -> DataFrame:
    """(version_id, symbol, target_date, trade_date, outcome, fields, reconciled_through) for every supplemental date of the
    open versions for which something has arrived: equal, discrepant in the named fields, or pending; and the
    latest date that the version is reconciled on."""
    came = _arrivals(versions, rows, arrived).select("version_id", "trade_date", "differing")
    through = came.groupBy("version_id").agg(F.max("trade_date").alias("reconciled_through"))
    filled = rows.where("selected and role = 'supplemental'").select("version_id", "trade_date").join(through, "version_id")
    outcome = first_of((F.col("differing").isNull(), "pending"), (F.size("differing") > 0, "discrepant"), otherwise="equal")
    dated = filled.join(came, ["version_id", "trade_date"], "left").join(versions.select("version_id", *KEY), "version_id")
    return dated.select("version_id", *KEY, "trade_date", outcome.alias("outcome"), F.coalesce(F.array_join("differing", ","), F.lit("")).alias("fields"), "reconciled_through")


def leaves(versions: DataFrame) -> DataFrame:
    """Per symbol and target date the version to go on with: the complete one, else the one open version that is
    nobody's parent. Two of a kind are ambiguous, and none is named."""
    parents = versions.where("parent_id is not null").select(F.col("parent_id").alias("version_id")).distinct().withColumn("has_child", F.lit(True))
    done = F.col("status").isin(*COMPLETE)
    tips = versions.join(parents, "version_id", "left").where(done | F.col("has_child").isNull())
    per = tips.groupBy("symbol", "target_date").agg(F.count_if(done).alias("complete"), F.count_if(~done).alias("open"), F.max(F.when(done, F.col("version_id"))).alias("whole"), F.max(F.when(~done, F.col("version_id"))).alias("leaf"))
    state = F.when((F.col("complete") > 1) | ((F.col("complete") == 0) & (F.col("open") > 1)), "ambiguous").when(F.col("complete") == 1, "complete").otherwise("open")
    return per.select("symbol", "target_date", F.when(state != "ambiguous", F.coalesce("whole", "leaf")).alias("version_id"), state.alias("leaf_state"))


def lineage(versions: DataFrame, version_id: str) -> DataFrame:
    """A version and its ancestors with their distance, by a recursive query over a view of a name of its own."""
    spark, view = versions.sparkSession, f"barloom_lineage_{uuid.uuid4().hex}"
    versions.select("version_id", "parent_id").createOrReplaceTempView(view)
    found = spark.sql(
        f"WITH RECURSIVE up(version_id, parent_id, depth) AS (SELECT version_id, parent_id, 0 FROM {view} WHERE version_id = :id"
        f" UNION ALL SELECT v.version_id, v.parent_id, depth + 1 FROM {view} v JOIN up ON v.version_id = up.parent_id) SELECT version_id, depth FROM up",
        args={"id": version_id},
    )
    spark.catalog.dropTempView(view)
    return found


def ancestry(versions: DataFrame) -> DataFrame:
    """(version_id, root_id, depth, tips) of all versions at once: the first version of each one's chain, how far that is,
    and how many versions without a child there are below the root.

    Pointers double: in each round a version takes over the pointer of the one it points to, so chains of a
    million versions take twenty rounds, and versions that have reached their root drop out of the join. A
    parent that isn't stored ends the chain. A chain that comes back to itself has no root; its depth is null."""
    known = versions.select("version_id", "parent_id").distinct()
    parents = known.select(F.col("version_id").alias("up"))
    links = known.withColumnRenamed("parent_id", "up").join(parents.withColumn("stored", F.lit(True)), "up", "left")
    links = durable(links.select("version_id", F.when(F.col("stored"), F.col("up")).otherwise(F.col("version_id")).alias("up"), F.col("stored").isNotNull().cast("long").alias("depth")))
    done = links.where("depth = 0")
    left = links.where("depth > 0")
    finished = [done]
    most = max(1, known.count()).bit_length() + 1
    for _ in range(most):
        if left.isEmpty():
            break
        over = links.select(F.col("version_id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        jumped = durable(left.join(over, "up").select("version_id", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") == 0).alias("there")))
        finished.append(jumped.where("there").drop("there"))
        left = jumped.where("not there").drop("there")
        links = finished[0]
        for part in finished[1:]:
            links = links.unionByName(part)
        links = links.unionByName(left)
    settled = finished[0]
    for part in finished[1:]:
        settled = settled.unionByName(part)
    settled = settled.unionByName(left.select("version_id", F.lit(None).cast("string").alias("up"), F.lit(None).cast("long").alias("depth")))
    tips = settled.join(known.where("parent_id is not null").select(F.col("parent_id").alias("version_id")).distinct(), "version_id", "left_anti").groupBy("up").agg(F.count("*").alias("tips"))
    return durable(settled).join(tips, "up", "left").select("version_id", F.col("up").alias("root_id"), "depth", F.when(F.col("up").isNotNull(), F.coalesce("tips", F.lit(0))).alias("tips"))


def routed(decisions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Where each symbol goes: on with the complete version it has; where the canonical source is complete, to its
    reconciliation if a provisional version is open and to a canonical version if not; else to a provisional
    one if the other source covers all, or to failure. ``known`` has the leaves of stored versions;
    where both have target dates, a decision goes on with the leaf for its own."""
    keys = [k for k in KEY if k in decisions.columns and (known is None or k in known.columns)]
    out = decisions if known is None else decisions.join(known.select(*keys, "leaf_state"), keys, "left")
    leaf = F.lit(None).cast("string") if known is None else F.col("leaf_state")
    route = first_of(
        (leaf == "complete", "replay"),
        (leaf == "ambiguous", "ambiguous"),
        ((F.col("reason") == "not_needed") & (leaf == "open"), "reconcile"),
        (F.col("reason") == "not_needed", "canonical"),
        (F.col("is_eligible") & F.col("coverage_complete"), "supplement"),
        (F.col("is_eligible"), "supplement_incomplete"),
        otherwise="supplement_rejected",
    )
    return out.select(*(k for k in KEY if k in decisions.columns), route.alias("route"), "reason")


def gate(members: DataFrame, versions: DataFrame) -> DataFrame:
    """One row: whether every eligible member has a version, and how many lack one."""
    ready = versions.select("symbol").distinct()
    lacking = members.where("status = 'active_scan_eligible'").join(ready, "symbol", "left_anti")
    return lacking.agg(F.count("*").alias("lacking"), (F.count("*") == 0).alias("open"))


def from_plain_history(bars: DataFrame, target) -> DataFrame:
    """Histories from before versions: canonical and complete by definition."""
    counted = bars.where(F.col("trade_date") <= F.lit(target)).groupBy("symbol").agg(F.count("*").alias("required"))
    none = F.lit(0).cast("long")
    return described(counted.select("symbol", F.lit(target).alias("target_date"), F.lit("canonical_complete").alias("status"), "required", F.col("required").alias("canonical"), none.alias("supplemental"), none.alias("missing"), none.alias("remaining"), none.alias("discrepancies")))
