import datetime as dt

import pytest
from barloom.operators import asof, history, results, second_screen, validate, versions
from pyspark.sql import functions as F
from tests.test_windows_and_asof import series

D = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=3 * (k - 1))


def bars(spark, days, source="primary", close=10.0, symbol="0001"):
    rows = [(symbol, D(k), close, close, close, close, 100, source) for k in days]
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume long, source string")


def required(spark, n=5):
    return spark.createDataFrame([("0001", D(k)) for k in range(1, n + 1)], "symbol string, trade_date date")


IDENTITY = "struct<symbol:string,market:string,exchange:string,currency:string,security_type:string>"
OWN = ("0001", "TSE", "TWSE", "TWD", "EQUITY")


def decide(spark, canonical, other, **facts):
    facts = {"failure": "delayed", "evidence_ok": True, "requested": OWN, "returned": OWN, "security_ok": True, "problem": None, "canonical_problem": None} | facts
    kinds = {"evidence_ok": "boolean", "security_ok": "boolean", "requested": IDENTITY, "returned": IDENTITY}
    candidates = spark.createDataFrame([("0001", *facts.values())], "symbol string, " + ", ".join(f"{k} {kinds.get(k, 'string')}" for k in facts))
    return versions.eligibility(versions.date_sets(required(spark), canonical, other), candidates).first()


# whether the failure of the canonical source lets the other fill in, class by class
FAILURES = {"temporary": True, "delayed": True, "pacing_blocked": True, "timeout": True, "malformed": False, "permanent": False, "identity_mismatch": False, "unavailable": False, None: False, "anything else": False}


@pytest.mark.parametrize("failure", FAILURES)
def test_failure_classes(spark, failure):
    got = decide(spark, bars(spark, range(1, 4)), bars(spark, range(1, 6), "secondary"), failure=failure)
    want = ("eligible_verified_supplemental", True, 2) if FAILURES[failure] else ("failure_not_eligible", False, 0)
    assert (got.reason, got.is_eligible, got.eligible_dates) == want
    assert got.identity_status == ("verified" if FAILURES[failure] else "not_checked")


OTHERS = {"symbol": ("symbol_mismatch", "identity_mismatch"), "market": ("market_mismatch", "market_mismatch"), "exchange": ("exchange_mismatch", "identity_mismatch"), "currency": ("currency_mismatch", "currency_mismatch"), "security_type": ("security_type_mismatch", "security_type_mismatch")}


@pytest.mark.parametrize("place", range(5))
def test_identity_takes_the_first_dimension_that_differs(spark, place):
    """From the dimension on, all differ: the first of them names the status and the reason."""
    returned = tuple(v if k < place else "?" for k, v in enumerate(OWN))
    got = decide(spark, bars(spark, range(1, 4)), bars(spark, range(1, 6), "secondary"), returned=returned, security_ok=False)
    assert (got.identity_status, got.reason) == list(OTHERS.values())[place]


def test_identity_that_lacks(spark):
    got = decide(spark, bars(spark, range(1, 4)), bars(spark, range(1, 6), "secondary"), returned=None)
    assert (got.identity_status, got.reason, got.rejected_dates) == ("unavailable", "instrument_unavailable", 5)


@pytest.mark.parametrize(
    ("canonical", "other", "facts", "want"),
    [
        (range(1, 6), range(1, 6), {"failure": None}, ("not_needed", False, 0, 0, 0, "not_applicable", True)),
        (range(1, 4), range(1, 6), {}, ("eligible_verified_supplemental", True, 2, 0, 3, "exact_match", True)),
        (range(1, 4), range(4, 6), {}, ("eligible_verified_supplemental", True, 2, 0, 0, "not_applicable", True)),
        (range(1, 4), range(1, 5), {}, ("insufficient_supplemental_coverage", True, 1, 1, 3, "exact_match", False)),
        (range(1, 4), range(1, 4), {}, ("insufficient_supplemental_coverage", False, 0, 2, 3, "exact_match", False)),
        (range(1, 4), [], {"problem": None}, ("insufficient_supplemental_coverage", False, 0, 2, 0, "not_applicable", False)),
        (range(1, 4), range(1, 6), {"failure": "malformed"}, ("failure_not_eligible", False, 0, 2, 5, "not_applicable", False)),
        (range(1, 4), range(1, 6), {"evidence_ok": None}, ("eligible_verified_supplemental", True, 2, 0, 3, "exact_match", True)),
        (range(1, 4), range(1, 6), {"evidence_ok": False, "returned": None}, ("unknown_fail_closed", False, 0, 2, 5, "not_applicable", False)),
        (range(1, 4), range(1, 6), {"security_ok": False, "problem": "x"}, ("security_boundary_failed", False, 0, 2, 5, "not_applicable", False)),
        (range(1, 4), range(1, 6), {"security_ok": None}, ("security_boundary_failed", False, 0, 2, 5, "not_applicable", False)),
        (range(1, 4), range(1, 6), {"problem": "duplicate_trade_date"}, ("duplicate_trade_date", False, 0, 2, 5, "not_applicable", False)),
        (range(1, 4), range(1, 6), {"canonical_problem": "malformed_payload"}, ("unknown_fail_closed", False, 0, 2, 5, "not_applicable", False)),
        (range(1, 4), range(1, 8), {}, ("unexpected_observation_date", False, 0, 2, 7, "not_applicable", False)),
    ],
)
def test_eligibility(spark, canonical, other, facts, want):
    got = decide(spark, bars(spark, canonical), bars(spark, other, "secondary"), **facts)
    assert (got.reason, got.is_eligible, got.eligible_dates, got.remaining_dates, got.rejected_dates, got.overlap_status, got.coverage_complete) == want


def test_a_differing_overlap_rejects_all(spark):
    got = decide(spark, bars(spark, range(1, 4)), bars(spark, range(1, 6), "secondary", 11.0))
    assert (got.reason, got.overlap_status, got.rejected_dates) == ("overlap_discrepancy", "discrepancy", 5)


def test_structure_takes_the_whole_run_before_its_rows(spark):
    def problem(days, **changes):
        frame = bars(spark, days).withColumn("start_date", F.lit(D(1))).withColumn("target_date", F.lit(D(5))).withColumn("position", F.monotonically_increasing_id())
        frame = frame.coalesce(1).withColumn("position", F.datediff("trade_date", F.lit(D(1)))) if not changes.pop("given", False) else frame
        for c, v in changes.items():
            frame = frame.withColumn(c, v)
        return versions.structure(frame).first().problem

    days = F.datediff("trade_date", F.lit(D(1)))
    on = lambda k, v, c: F.when(F.col("trade_date") == D(k), v).otherwise(F.col(c))
    assert problem([1, 2, 3]) is None
    assert problem([1, 2, 2], low=F.lit(-1.0)) == "duplicate_trade_date"
    assert problem([1, 2, 2, 9], position=-days) == "malformed_payload"  # not ascending comes before all else
    assert problem([1, 2, 9], start_date=F.lit(D(2))) == "future_trade_date"
    assert problem([1, 2, 3], start_date=F.lit(D(2)), low=F.lit(None).cast("double")) == "unexpected_observation_date"
    assert problem([1, 2, 3], trade_date=on(2, None, "trade_date")) == "malformed_payload"
    assert problem([1, 2, 3], high=on(2, None, "high")) == "partial_ohlc"
    assert problem([1, 2, 3], **{c: on(2, None, c) for c in ("open", "high", "low", "close")}) == "malformed_payload"
    assert problem([1, 2, 3], high=on(3, None, "high"), volume=on(2, -1, "volume")) == "malformed_payload"  # the first bad row
    assert problem([1, 2, 3], high=on(2, None, "high"), volume=on(3, -1, "volume")) == "partial_ohlc"
    assert problem([1, 2, 3], row_symbol=on(2, "0002", "symbol"), high=on(2, None, "high")) == "identity_mismatch"
    assert problem([1, 2, 3], low=on(2, 11.0, "low")) == "malformed_payload"


def test_versions_build_and_reconcile(spark):
    need = required(spark)
    made, rows = versions.build(bars(spark, range(1, 4)), bars(spark, range(1, 6), "secondary"), bars(spark, range(1, 4), "secondary"), need, D(5))
    parent = made.first()
    assert (parent.status, parent.required, parent.canonical, parent.supplemental, parent.missing, parent.remaining) == ("provisional_complete", 5, 3, 2, 2, 0)
    assert versions.role_violations(rows).count() == 0 and versions.state_violations(versions.described(made)).count() == 0
    assert versions.build(bars(spark, range(1, 4)).repartition(3), bars(spark, range(1, 6), "secondary"), bars(spark, range(1, 4), "secondary"), need, D(5))[0].first().version_id == parent.version_id

    def child_of(late):
        children, child_rows = versions.reconcile(made, rows, late)
        return children.first(), child_rows

    equal, equal_rows = child_of(bars(spark, [4, 5]))
    assert (equal.status, equal.canonical, equal.supplemental, equal.discrepancies, equal.parent_id) == ("reconciled_equal", 5, 0, 0, parent.version_id)
    assert versions.role_violations(equal_rows).count() == 0 and equal_rows.where("role = 'validation'").count() == 5
    assert child_of(bars(spark, [4]))[0].status == "reconciliation_pending"
    wrong, _ = child_of(bars(spark, [4, 5], close=12.0))
    assert (wrong.status, wrong.discrepancies) == ("reconciled_discrepant", 2)
    assert versions.reconcile(made, rows, bars(spark, [1]))[0].count() == 0
    both = made.unionByName(versions.reconcile(made, rows, bars(spark, [4]))[0])
    assert versions.leaves(both).first().leaf_state == "open"
    assert versions.build(bars(spark, range(1, 4)), bars(spark, [4], "secondary"), bars(spark, [], "secondary"), need, D(5))[0].count() == 0  # incomplete
    assert [(r.version_id == parent.version_id, r.depth) for r in versions.lineage(both, both.where("parent_id is not null").first().version_id).orderBy("depth").collect()] == [(False, 0), (True, 1)]


def test_versions_for_two_target_dates_dont_touch_each_other(spark):
    need = spark.createDataFrame([("0001", D(t), D(k)) for t in (4, 5) for k in range(1, t + 1)], "symbol string, target_date date, trade_date date")
    none = bars(spark, [], "secondary")
    made, rows = versions.build(bars(spark, [1, 2]), bars(spark, range(1, 6), "secondary"), none, need)
    first, second = made.orderBy("target_date").collect()
    assert [(r.required, r.canonical, r.supplemental, r.remaining) for r in (first, second)] == [(4, 2, 2, 0), (5, 2, 3, 0)]
    children, child_rows = versions.reconcile(made, rows, bars(spark, [3, 4], close=12.0))
    got = {r.target_date: r for r in children.collect()}
    assert (got[D(4)].status, got[D(4)].supplemental, got[D(4)].canonical, got[D(4)].missing, got[D(4)].discrepancies) == ("reconciled_discrepant", 0, 4, 0, 2)
    assert (got[D(5)].status, got[D(5)].supplemental, got[D(5)].canonical, got[D(5)].missing) == ("reconciliation_pending", 1, 4, 1)
    assert child_rows.groupBy("version_id").count().count() == 2 and versions.role_violations(child_rows).count() == 0
    assert versions.state_violations(versions.described(children)).count() == 0
    only, _ = versions.reconcile(made, rows, bars(spark, [5]))  # in the later version alone
    assert [(r.target_date, r.supplemental, r.parent_id == second.version_id) for r in only.collect()] == [(D(5), 2, True)]
    told = {(r.target_date, r.trade_date): (r.outcome, r.fields, r.reconciled_through) for r in versions.reconciliation_dates(made, rows, bars(spark, [3, 4], close=12.0).where(F.col("trade_date") == F.lit(D(4))).unionByName(bars(spark, [3]))).collect()}
    assert told[D(5), D(3)] == ("equal", "", D(4)) and told[D(5), D(4)] == ("discrepant", "open,high,low,close", D(4)) and told[D(5), D(5)] == ("pending", "", D(4)) and len(told) == 5
    both = made.unionByName(children)
    states = {r.target_date: (r.leaf_state, r.version_id) for r in versions.leaves(both).collect()}
    assert states == {D(4): ("complete", got[D(4)].version_id), D(5): ("open", got[D(5)].version_id)}
    decisions = spark.createDataFrame([("0001", D(t), "not_needed", False, True) for t in (4, 5, 6)], "symbol string, target_date date, reason string, is_eligible boolean, coverage_complete boolean")
    assert {r.target_date: r.route for r in versions.routed(decisions, versions.leaves(both)).collect()} == {D(4): "replay", D(5): "reconcile", D(6): "canonical"}


def test_a_date_that_a_source_repeats_counts_once(spark):
    twice = bars(spark, [*range(1, 6), 4], "secondary")
    got = decide(spark, bars(spark, range(1, 4)), twice)
    assert (got.missing, got.eligible_dates, got.rejected_dates, got.remaining_dates, got.reason) == (2, 2, 3, 0, "eligible_verified_supplemental")
    refused = decide(spark, bars(spark, [1, 2, 2, 3]), twice, security_ok=False)
    assert (refused.missing, refused.eligible_dates, refused.rejected_dates, refused.remaining_dates) == (2, 0, 5, 2)
    differing = decide(spark, bars(spark, range(1, 4)), twice.unionByName(bars(spark, [3], "secondary", 11.0)))
    assert (differing.reason, differing.overlap_status) == ("overlap_discrepancy", "discrepancy")


@pytest.mark.parametrize("n", [1, 2, 5, 33])
def test_ancestry_of_chains_and_branches(spark, n):
    rows = [(f"v{k}", f"v{k - 1}" if k else None) for k in range(n)] + [("b", "v0"), ("lost", "unknown"), ("x", "y"), ("y", "x"), ("z", "x")]
    got = {r.version_id: (r.root_id, r.depth, r.tips) for r in versions.ancestry(spark.createDataFrame(rows, "version_id string, parent_id string")).collect()}
    tips = 1 if n == 1 else 2
    want = {f"v{k}": ("v0", k, tips) for k in range(n)} | {"b": ("v0", 1, tips), "lost": ("lost", 0, 1)} | {k: (None, None, None) for k in "xyz"}
    assert got == want
    assert versions.ancestry(spark.createDataFrame([], "version_id string, parent_id string")).count() == 0


def test_ids_come_from_content(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    made, rows = versions.build(bars(spark, range(1, 6)), bars(spark, [], "secondary"), bars(spark, [], "secondary"), required(spark), D(5))
    each = {r.trade_date: sha(f"0001|{r.trade_date}|10.0|10.0|10.0|10.0|100|primary") for r in rows.collect()}
    assert {r.trade_date: r.row_sha256 for r in rows.collect()} == each
    whole = sha(",".join(sorted(f"{h}:canonical" for h in each.values())))
    got = made.first()
    assert (got.provenance_sha256, got.version_id) == (whole, sha(f"0001|{D(5)}|{whole}")[:32])


def test_leaves(spark):
    rows = [
        ("a", "p", None, "provisional_complete"), ("a", "x", "p", "reconciliation_pending"), ("a", "y", "p", "reconciliation_pending"), ("b", "q", None, "provisional_complete"), ("b", "r", "q", "reconciled_equal"),
        ("c", "s", None, "provisional_complete"), ("d", "t", None, "canonical_complete"), ("d", "u", None, "reconciled_equal"), ("e", "v", None, "provisional_complete"), ("e", "w", None, "provisional_complete"), ("e", "z", "v", "reconciled_discrepant"),
    ]
    frame = spark.createDataFrame([(*r, D(1)) for r in rows] + [("b", "o", None, "canonical_complete", D(2))], "symbol string, version_id string, parent_id string, status string, target_date date")
    got = {(r.symbol, r.target_date): (r.version_id, r.leaf_state) for r in versions.leaves(frame).collect()}
    want = {"a": (None, "ambiguous"), "b": ("r", "complete"), "c": ("s", "open"), "d": (None, "ambiguous"), "e": ("z", "complete")}
    assert got == {(k, D(1)): v for k, v in want.items()} | {("b", D(2)): ("o", "complete")}


def test_two_lineages_at_once(spark):
    frame = spark.createDataFrame([("a", None), ("b", "a"), ("x", None)], "version_id string, parent_id string")
    one, two = versions.lineage(frame, "b"), versions.lineage(frame, "x")
    assert (sorted(r.version_id for r in one.collect()), [r.version_id for r in two.collect()]) == (["a", "b"], ["x"])


def test_states_and_coverage(spark):
    good = {"required": 5, "canonical": 3, "supplemental": 2, "missing": 2, "discrepancies": 0, "selected": 5, "coverage_complete": True, "source": "provisional_mixed", "authority": "incomplete", "reconciliation": "pending"}
    whole = good | {"canonical": 5, "supplemental": 0, "missing": 0, "source": "canonical_complete", "authority": "complete", "reconciliation": "not_applicable"}
    done = whole | {"source": "reconciled", "authority": "reconciled", "reconciliation": "reconciled_equal"}
    cases = [
        (good, {}, None), (whole, {}, None), (done, {}, None), (done, {"reconciliation": "reconciled_discrepant", "discrepancies": 1}, None),
        (good, {"required": 0}, "count_invalid"), (good, {"required": 4, "missing": 1}, "more_than_required"), (good, {"missing": 1}, "missing_count"), (good, {"selected": 4}, "selected_count"), (good, {"coverage_complete": False}, "coverage_flag"),
        (whole, {"authority": "incomplete"}, "canonical_authority"), (whole, {"reconciliation": "pending"}, "canonical_reconciliation"), (good, {"source": "canonical_complete", "authority": "complete", "reconciliation": "not_applicable"}, "canonical_with_supplement"),
        (whole, {"canonical": 4, "missing": 1, "selected": 4, "coverage_complete": False}, "canonical_with_gaps"), (whole, {"source": "provisional_mixed"}, "provisional_without_supplement"), (good, {"authority": "complete"}, "provisional_authority"), (good, {"reconciliation": "reconciled_equal"}, "provisional_reconciliation"),
        (done, {"authority": "complete"}, "reconciled_authority"), (done, {"reconciliation": "pending"}, "reconciled_reconciliation"), (good, {"source": "reconciled", "authority": "reconciled", "reconciliation": "reconciled_equal"}, "reconciled_with_supplement"),
        (done, {"canonical": 4, "missing": 1, "selected": 4, "coverage_complete": False}, "reconciled_with_gaps"), (done, {"discrepancies": 1}, "equal_with_discrepancies"), (done, {"reconciliation": "reconciled_discrepant"}, "discrepant_without_discrepancies"),
    ]
    frame = spark.createDataFrame([(str(k), *(base | change).values()) for k, (base, change, _) in enumerate(cases)], "version_id string, required long, canonical long, supplemental long, missing long, discrepancies long, selected long, coverage_complete boolean, source string, authority string, reconciliation string")
    got = {r.version_id: r.problem for r in versions.state_violations(frame).collect()}
    assert got == {str(k): want for k, (_, _, want) in enumerate(cases) if want}


def test_roles(spark):
    cases = [("primary", "canonical", True), ("secondary", "supplemental", True), ("secondary", "validation", False), ("secondary", "canonical", True), ("primary", "supplemental", True), ("primary", "canonical", False), ("secondary", "validation", True)]
    rows = [(str(k), D(1), *c, "h") for k, c in enumerate(cases)] + [("twice", D(1), *cases[0], "h")] * 2
    frame = spark.createDataFrame(rows, "version_id string, trade_date date, provider string, role string, selected boolean, row_sha256 string")
    got = sorted((r.version_id, r.problem) for r in versions.role_violations(frame).collect())
    assert got == [("3", "source_against_role"), ("4", "source_against_role"), ("5", "selection_against_role"), ("6", "selection_against_role"), ("twice", "row_repeated"), ("twice", "two_selected")]


def test_reconcile_problems(spark):
    made, rows = versions.build(bars(spark, range(1, 4)), bars(spark, range(1, 6), "secondary"), bars(spark, [], "secondary"), required(spark), D(5))
    v = made.first().version_id
    row = lambda k, **c: {"version_id": v, "symbol": "0001", "trade_date": D(k), "provider": "primary", "role": "canonical", "selected": True, "run_id": "r"} | c

    def problem(dates, came, parents=made):
        targets = spark.createDataFrame([(v, D(k), "r") for k in dates], "version_id string, trade_date date, run_id string")
        arrived = spark.createDataFrame([tuple(c.values()) for c in came], "version_id string, symbol string, trade_date date, provider string, role string, selected boolean, run_id string")
        return versions.reconcile_problems(parents, rows, arrived, targets).first().problem

    assert problem([4, 5], [row(4), row(5)]) is None and problem([4], [row(4)]) is None
    assert problem([4], [row(4)], made.withColumn("status", F.lit("reconciled_equal"))) == "parent_not_open"
    assert problem([4], []) == "no_rows"
    for change in ({"symbol": "0002"}, {"provider": "secondary"}, {"role": "validation"}, {"selected": False}, {"run_id": "other"}):
        assert problem([4], [row(4, **change)]) == "rows_not_canonical_of_the_run"
    assert problem([4], [row(4), row(4)]) == "date_repeated"
    assert problem([4, 5], [row(4)]) == problem([4], [row(4), row(5)]) == "dates_differ"
    assert problem([4, 6], [row(4), row(6)]) == "date_in_the_future"
    assert problem([1, 4], [row(1), row(4)]) == "date_not_supplemental"


def test_gate_and_routes(spark):
    members = spark.createDataFrame([("a", "active_scan_eligible"), ("b", "active_scan_eligible"), ("c", "inactive")], "symbol string, status string")
    made = spark.createDataFrame([("a", "canonical_complete")], "symbol string, status string")
    assert tuple(versions.gate(members, made).first()) == (1, False) and tuple(versions.gate(members.where("symbol = 'a'"), made).first()) == (0, True)
    decisions = [("a", "not_needed", False, True), ("b", "not_needed", False, True), ("c", "not_needed", False, True), ("d", "eligible_verified_supplemental", True, True), ("e", "insufficient_supplemental_coverage", True, False), ("f", "identity_mismatch", False, False), ("g", "timeout", False, False)]
    known = spark.createDataFrame([("b", "open"), ("c", "complete"), ("d", "open"), ("g", "ambiguous")], "symbol string, leaf_state string")
    got = {r.symbol: r.route for r in versions.routed(spark.createDataFrame(decisions, "symbol string, reason string, is_eligible boolean, coverage_complete boolean"), known).collect()}
    assert got == {"a": "canonical", "b": "reconcile", "c": "replay", "d": "supplement", "e": "supplement_incomplete", "f": "supplement_rejected", "g": "ambiguous"}


def test_validation_view(spark):
    made, rows = versions.build(bars(spark, range(1, 6)), bars(spark, [], "secondary"), bars(spark, [5], "secondary", 11.0), required(spark), D(5))
    got = asof.validation_view(rows, made).first()
    assert (got.status, got.outcome, got.left_provider, got.right_provider, got.fields) == ("source_discrepancy", "discrepancy", "primary", "secondary", "open,high,low,close")
    assert asof.validation_view(rows, made.withColumn("target_date", F.lit(D(4)))).first().status == "missing_source"


def test_run_roll_ups(spark):
    """By hand: a run goes on while one is open or none failed; a failure beside a success is a partial success."""
    runs = {"all done": "dd", "one failed": "df", "all failed": "ff", "one open": "dfo", "open": "o"}
    rows = [(k, str(n), {"d": "done", "f": "failed", "o": "open"}[c]) for k, v in runs.items() for n, c in enumerate(v)]
    got = {r.run_id: (r.status, r.error_code) for r in history.run_status(spark.createDataFrame(rows, "run_id string, symbol string, state string")).collect()}
    assert got == {"all done": ("running", None), "one failed": ("partial_success", "candidate_failure"), "all failed": ("failed", "all_candidates_failed"), "one open": ("running", None), "open": ("running", None)}


def test_run_quality(spark):
    states = {"canonical": ["canonical_complete"] * 2, "mended": ["canonical_complete", "reconciled_equal"], "wrong": ["reconciled_equal", "reconciled_discrepant"], "open": ["reconciled_discrepant", "provisional_complete", "canonical_complete"], "plain": [None, None], "mixed": [None, "canonical_complete"]}
    rows = [(k, str(n), s and f"{k}{n}", s, 5, 2 if s == "provisional_complete" else 0, 1, 3, "b") for k, v in states.items() for n, s in enumerate(v)]
    frame = spark.createDataFrame(rows, "run_id string, symbol string, version_id string, version_status string, canonical long, supplemental long, missing long, discrepancies long, supplemental_source string")
    got = {r.run_id: r for r in history.run_quality(frame).collect()}
    pick = lambda r: (r.problem, r.execution_status, r.source_status, r.quality, r.authority, r.reconciliation)
    assert {k: pick(r) for k, r in got.items()} == {
        "canonical": (None, "success", "canonical_complete", "canonical", "complete", "not_applicable"), "mended": (None, "success", "reconciled", "reconciled", "reconciled", "reconciled_equal"),
        "wrong": (None, "success", "reconciled", "reconciled", "reconciled", "reconciled_discrepant"), "open": (None, "provisional_success", "provisional_mixed", "provisional", "incomplete", "pending"),
        "plain": (None, "success", "canonical_complete", "canonical", "complete", "not_applicable"), "mixed": ("mixed_policies", None, None, None, None, None),
    }
    assert (got["open"].supplemental, got["open"].supplemental_candidates, got["open"].supplemental_sources, got["open"].version_ids, got["plain"].canonical) == (2, 1, "b", "open0,open1,open2", 0)


@pytest.mark.parametrize(
    ("price", "outcome", "want"),
    [
        ("available", "match", ("available", "clean")), ("available", "source_discrepancy", ("source_discrepancy", "warning")), ("available", None, ("missing_source", "warning")), ("available", "market_date_mismatch", ("market_date_mismatch", "warning")),
        ("market_date_mismatch", "match", ("available", "warning")), ("missing_source", "match", ("available", "unavailable")), ("missing_source", None, ("missing_source", "unavailable")),
    ],
)
def test_result_quality(spark, price, outcome, want):
    prices = spark.createDataFrame([("a", price, D(1))], "symbol string, price_status string, latest_date date")
    outcomes = spark.createDataFrame([("a", outcome)] if outcome else [], "symbol string, outcome string")
    got = results.quality(prices, outcomes, spark.createDataFrame([("a", "close")], "symbol string, field string")).first()
    assert (got.validation_status, got.quality) == want and (got.discrepancies, got.fields) == (1, "close")


def test_changes(spark):
    row = lambda m, k, status="available", value=None, state=None, v="v1": ("a", v, m, D(k), status, value, state, "u")
    rows = [
        row("return_20d", 1, "insufficient_history"), row("return_20d", 2, value=5.0), row("return_20d", 5, value=6.0), row("return_20d", 6, value=6.9), row("return_20d", 7, value=99.0, v="v2"), row("volume_ratio_20d", 1, value=1.0), row("volume_ratio_20d", 2, value=1.25), row("volume_ratio_20d", 3, value=1.49),
        row("max_drawdown_60d", 1, value=-4.0), row("max_drawdown_60d", 2, value=-5.0), row("volume_anomaly", 1, state="normal"), row("volume_anomaly", 2, state="high"), row("volume_anomaly", 3, state="high"), row("volume_anomaly", 4, "market_date_mismatch"), row("latest_close", 1, value=1.0), row("latest_close", 2, value=9.0),
    ]
    got = results.changes(spark.createDataFrame(rows, "symbol string, methodology string, metric string, market_date date, status string, value double, state string, unit string")).collect()
    assert sorted((r.metric, r.market_date, r.change) for r in got) == [
        ("max_drawdown_60d", D(2), "metric_changed"), ("return_20d", D(2), "availability_changed"), ("return_20d", D(5), "metric_changed"), ("volume_anomaly", D(2), "volume_anomaly_state_changed"), ("volume_anomaly", D(4), "availability_changed"), ("volume_ratio_20d", D(2), "metric_changed"),
    ]


def test_changes_straight_from_bars_are_those_of_the_results(spark):
    import math

    frame = series(spark, [100 + 9 * math.sin(k / 5) + (k % 7) for k in range(150)], volumes=[1000 + (k % 11 == 0) * 3000 for k in range(150)])
    stored, straight = results.changes(results.daily(frame)), results.history_changes(frame)
    assert sorted(map(tuple, stored.select(straight.columns).collect()), key=str) == sorted(map(tuple, straight.collect()), key=str) and stored.count() > 300


def test_valuations_are_carried_and_their_date_counts(spark):
    days = spark.createDataFrame([("a", D(k)) for k in (1, 2, 3, 4, 5)], "symbol string, market_date date")
    ratios = spark.createDataFrame([("a", D(2), "price_to_book_ratio", 1.5, "s"), ("a", D(4), "price_to_book_ratio", 1.5, "s"), ("a", D(4), "price_to_book_ratio", 1.0, "r")], "symbol string, metric_date date, name string, value double, source string")
    rows = results.daily_valuations(days, ratios)
    got = {(r.name, r.market_date): (r.status, r.value, r.as_of_date) for r in rows.collect()}
    assert len(got) == 15 and got["price_to_book_ratio", D(1)] == ("missing_source", None, None) and got["price_to_book_ratio", D(3)] == ("available", 1.5, D(2)) and got["price_to_book_ratio", D(5)] == ("available", 1.5, D(4))
    told = {(r.name, r.market_date, r.change) for r in results.valuation_changes(rows).collect()}
    assert told == {("price_to_book_ratio", D(2), "availability_changed"), ("price_to_book_ratio", D(4), "valuation_updated")}


def test_discrepancies_added_and_resolved(spark):
    days = spark.createDataFrame([("a", D(k)) for k in (1, 2, 3)], "symbol string, market_date date")
    found = spark.createDataFrame([("a", D(1), "close", "p"), ("a", D(2), "close", "p"), ("a", D(2), "volume", "v")], "symbol string, market_date date, field string, reason string")
    got = {r.market_date: (r.added, r.resolved) for r in results.discrepancy_changes(found, days).collect()}
    assert got == {D(2): ("volume:v", ""), D(3): ("", "close:p,volume:v")}


def test_daily_results(spark):
    """The fourteen metrics by hand: a straight rise has no drawdown, and what has too few bars says so."""
    frame = series(spark, [100 + k for k in range(130)])
    rows = results.daily(frame)
    assert rows.count() == 130 * 14 and rows.select("result_id").distinct().count() == 130
    last = frame.agg(F.max("trade_date")).first()[0]
    got = {r.metric: r for r in rows.where(F.col("market_date") == F.lit(last)).collect()}
    assert list(results.METRICS) == [r.metric for r in sorted(got.values(), key=lambda r: list(results.METRICS).index(r.metric))] and {r.status for r in got.values()} == {"available"}
    assert (got["latest_close"].value, got["latest_close"].unit, got["max_drawdown_120d"].value, got["volume_anomaly"].state, got["volume_anomaly"].value) == (229.0, "TWD", 0.0, "normal", None)
    assert abs(got["return_120d"].value - (229 / 109 - 1) * 100) < 1e-9 and abs(got["ma_distance_20d"].value - (229 / 219.5 - 1) * 100) < 1e-9
    early = {r.metric: r.status for r in rows.where(F.col("market_date") == F.lit(last - dt.timedelta(days=210))).collect()}  # the 60th bar: 59 returns
    assert (early["volatility_60d"], early["max_drawdown_60d"], early["return_60d"], early["max_drawdown_120d"]) == ("insufficient_history", "available", "insufficient_history", "insufficient_history")
    names = spark.createDataFrame([("0001",), ("0002",)], "symbol string")
    asked = {(r.symbol, r.metric): (r.status, r.value) for r in results.daily_as_of(names, frame, last + dt.timedelta(days=1)).collect()}
    assert asked["0001", "latest_close"] == ("market_date_mismatch", None) and asked["0002", "latest_close"] == ("missing_source", None) and len(asked) == 28


def test_failures_keep_their_place(spark):
    of = spark.createDataFrame([("a", "return_20d", None, "available", 1.0, 2.0, 1.0, 21), ("b", "return_20d", None, "available", 1.0, 2.0, 1.0, 21)], "symbol string, metric string, component string, status string, previous double, current double, delta double, observations int")
    failed = spark.createDataFrame([("b",)], "symbol string")
    rows = second_screen.isolated(of, failed).where("symbol = 'b'").collect()
    assert len(rows) == 16 and {(r.status, r.current, r.observations) for r in rows} == {("analysis_failed", None, 0)} and second_screen.isolated(of, failed).count() == 17


def test_only_sealed_runs_count(spark):
    runs = spark.createDataFrame([("r1", D(1), "v1", "succeeded"), ("r2", D(2), "v2", "open"), ("r3", D(3), "v2", "succeeded")], "run_id string, market_date date, methodology string, status string")
    picks = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r3", "a"), ("r3", "b")], "run_id string, symbol string")
    assert {r.symbol: r.selections for r in history.selections_per_symbol(picks, runs).collect()} == {"a": 2, "b": 1}
    assert {r.symbol: r.side for r in history.methodology_comparison(picks, runs, "v1", "v2").collect()} == {"a": "both", "b": "right_only"}
    tasks = spark.createDataFrame([(1, "success"), (1, "failed"), (2, "failed"), (3, "skipped"), (3, "success")], "batch_id int, outcome string")
    assert {r.batch_id: r.status for r in history.batch_status(tasks).collect()} == {1: "partial_success", 2: "failed", 3: "success"}
    assert history.digest(picks).first() == history.digest(picks.repartition(3)).first() != history.digest(picks.limit(3)).first()


def test_row_and_batch_checks(spark):
    rows = [("a", "1", 1.0, 1.0, 1.0, 1.0, 0), ("b", "1", 0.0, 1.0, 1.0, 1.0, 0), ("c", "1", 2.0, 1.0, 1.0, 1.0, 0), ("d", "1", 1.0, 2.0, 1.5, 1.0, 0), ("e", "1", 1.0, 1.0, 1.0, 1.0, None), ("f", "1", float("nan"), 1.0, 1.0, 1.0, 1)]
    frame = spark.createDataFrame(rows, "symbol string, k string, open double, high double, low double, close double, volume long")
    assert [r.problem for r in validate.checked_bars(frame).orderBy("symbol").collect()] == [None, "price_not_positive", "high_not_highest", "low_not_lowest", "volume_invalid", "price_not_finite"]
    raw = spark.createDataFrame([(" 0001 ", "2024-01-02", "1,000.5", "1000.5", "1000.5", "1000.5", "5.0", "s"), ("0001", "2024-13-02", "1", "1", "1", "1", "1", "s"), ("?", "2024-01-02", "1", "1", "1", "1", "1", "s"), ("0002", "2024-01-02", "--", "1", "1", "1", "1", "s")], "symbol string, trade_date string, open string, high string, low string, close string, volume string, source string")
    good, bad = validate.normalised(raw)
    assert good.first().open == 1000.5 and good.first().symbol == "0001" and sorted(r.problem for r in bad.collect()) == ["date_invalid", "price_not_finite", "symbol_invalid"]
    batches = spark.createDataFrame([(1, "0001", D(1), D(3), D(3)), (2, "0001", D(1), D(3), D(2)), (3, "0009", D(1), D(3), D(3))], "batch_id int, batch_symbol string, start_date date, end_date date, market_date date")
    inside = bars(spark, [1, 3]).withColumn("batch_id", F.lit(1)).unionByName(bars(spark, [1, 9]).withColumn("batch_id", F.lit(2)))
    assert {r.batch_id: r.problem for r in validate.batch_problems(inside, batches).collect()} == {1: None, 2: "date_out_of_range", 3: "empty"}
