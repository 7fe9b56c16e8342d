"""Cases the registered queries' fixtures do not hold: other units, unknown rules, missing ids, and large rule bases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dielens import session
from dielens.operators import clean, dq, ingest, query, rules, spatial, trace


def test_lineage_follows_a_long_chain_to_its_end(rows):
    edges = rows(
        "source_unit_id string, target_unit_id string, confidence double",
        *[(f"u{k}", f"u{k + 1}", 0.5) for k in range(15)],
        ("u15", "u3", 0.9),
    )
    start = rows("unit_id string", ("u0",))
    found = {r["node_id"]: r["depth"] for r in trace.trace_lineage(edges, start).collect()}
    assert found == {f"u{k}": k for k in range(1, 16)}
    assert trace.trace_lineage(edges, start, max_depth=4).count() == 4


def test_lineage_joins_only_pairs_that_lead_on(rows, monkeypatch):
    """Cycles, diamonds, parallel edges and nulls against a walk in Python; no level is made for pairs without a further edge."""
    listed = [
        ("a", "b", 0.5), ("a", "b", 0.9), ("a", "c", 0.8), ("b", "d", 0.5), ("c", "d", 0.7), ("d", "a", 0.9), ("d", "d", 1.0),
        ("x", "y", 0.5), (None, "z", 0.5), ("x", None, 0.4), ("b", "c", 0.9), ("y", "leaf", -0.5), ("y", "leaf", 0.5), ("p", "q", -0.5), ("q", "r", 0.1), ("q", "r", 0.9),
    ]
    edges = rows("source_unit_id string, target_unit_id string, confidence double", *listed)
    start = rows("unit_id string", ("a",), ("a",), ("x",), ("p",), (None,), ("alone",))
    want = {}
    for s in ("a", "x", "p"):
        seen, frontier, depth = {s}, {s: 1.0}, 0
        while frontier:
            depth, new = depth + 1, {}
            for u, v, c in listed:
                if u in frontier and u is not None and v not in seen:
                    new[v] = max(new.get(v, -9.0), frontier[u] * c)
            seen |= set(new)
            want |= {(s, v): (c, depth) for v, c in new.items()}
            frontier = new
    found = trace.trace_lineage(edges, start).collect()
    assert {(r.start_unit_id, r.node_id): (r.confidence, r.depth) for r in found} == want
    assert len(found) == len(want)
    made = []
    monkeypatch.setattr(trace, "settled", lambda df, purpose: made.append(purpose) or df.localCheckpoint())
    one = trace.trace_lineage(rows("source_unit_id string, target_unit_id string, confidence double", ("x", "y", 0.5)), start)
    assert [tuple(r) for r in one.collect()] == [("x", "y", 0.5, 1)]
    assert "trace-1" not in made and not [p for p in made if p == "trace-3"]


@pytest.mark.parametrize("n", [3, 260])
def test_formats_are_detected_alike_for_any_number_of_profiles(rows, n):
    schema = "format_code string, profile_version string, status string, signature string"
    twins = [("TWIN", "1", "RELEASED", "twin"), ("TWIN", "1", "RELEASED", "twin")]
    others = [(f"F{k}", "1", "RELEASED", f"^head{k}$") for k in range(n)] + [("D", "1", "DRAFT", "head")]
    files = rows("receipt_id long, content string", (1, "a twin"), (2, "head2"), (3, "nothing"), (4, None))
    found = {r["receipt_id"]: r for r in ingest.detect_format(files, rows(schema, *twins, *others)).collect()}
    assert [found[k]["detection_status"] for k in (1, 2, 3, 4)] == ["NEEDS_CONFIRMATION", "DETECTED", "UNKNOWN", "UNKNOWN"]
    assert found[1]["n_candidates"] == 2
    assert found[2]["candidates"] == "F2 1"


def test_time_slots_of_many_boundaries(rows):
    day = datetime(2020, 1, 1)
    bounds = [(day + timedelta(days=k), day + timedelta(days=k + 1, hours=k % 3)) for k in range(0, 900)]
    rule = rows("effective_from_utc timestamp_ntz, effective_to_utc timestamp_ntz", *bounds, (None, None))
    events = [day + timedelta(hours=7 * k) for k in range(-5, 200)]
    facts = rows("at timestamp_ntz", *[(e,) for e in events], (None,))
    known = sorted({b for pair in bounds for b in pair})
    for r in rules.slotted(facts, "at", rule).collect():
        assert r["__slot"] == (-1 if r["at"] is None else sum(b <= r["at"] for b in known))
    assert {r["__slot"] for r in rules.slotted(facts, "at", rule.limit(0)).collect()} == {0, -1}


def test_a_long_filter_list_keeps_its_rows(rows):
    df = rows("lot_id string", *[(f"L{k}",) for k in range(5000)])
    assert query.apply_global_filter(df, {"lot": [f"L{k}" for k in range(0, 5000, 2)]}).count() == 2500


LIMITS = "unit_code string, unit_raw string, limit_source string, lsl_applied double, usl_applied double"


@pytest.mark.parametrize(
    ("limit_unit", "value_unit", "lsl", "usl", "value", "result"),
    [
        ("mV", "mV", 10.0, 20.0, 15.0, "PASS"),
        ("mV", "V", 10.0, 20.0, 0.015, "PASS"),
        ("V", "mV", 0.010, 0.020, 15.0, "PASS"),
        ("V", "mV", 0.010, 0.020, 25.0, "FAIL"),
        ("V", "uA", 0.010, 0.020, 15.0, "NOT_EVALUATED"),
        ("V", "??", 0.010, 0.020, 15.0, "NOT_EVALUATED"),
    ],
)
def test_values_and_limits_meet_in_one_unit(rows, limit_unit, value_unit, lsl, usl, value, result):
    factors = rows("unit_raw string, unit_code string, factor double", ("V", "V", 1.0), ("mV", "V", 0.001), ("uA", "uA", 1.0))
    limits = rules.convert_limits(rows(LIMITS, (limit_unit, value_unit, "SPEC", lsl, usl)), factors)
    ready = limits.withColumns(
        {
            "value_numeric": F.lit(value), "raw_value": F.lit(str(value)), "measurement_status": F.lit("MEASURED"),
            "binding_status": F.lit("MATCHED"), "n_candidates": F.lit(1),
            "lower_operator_applied": F.lit(None).cast("string"), "upper_operator_applied": F.lit(None).cast("string"),
        }
    )
    judged = rules.evaluate_spec(ready).first()
    assert judged["evaluation_result"] == result
    if (limit_unit, value_unit) == ("V", "mV"):
        assert (judged["lsl_applied"], judged["usl_applied"]) == pytest.approx((10.0, 20.0))


ISSUES = "rule_code string, run_id string, resolution_status string"


@pytest.mark.parametrize(
    ("issue", "open_runs"),
    [
        (("NEVER_HEARD_OF", "r1", "OPEN"), {"r2", "r3"}),
        (("DQ_UNKNOWN_FORMAT", "batch1", "OPEN"), {"r3"}),
        (("DQ_UNKNOWN_FORMAT", "nowhere", "OPEN"), set()),
        (("DQ_UNKNOWN_FORMAT", "batch1", "RESOLVED"), {"r1", "r2", "r3"}),
        (("WARN", "r1", "OPEN"), {"r1", "r2", "r3"}),
    ],
)
def test_the_gate_fails_closed(rows, issue, open_runs):
    version = rows(
        "rule_code string, severity string, is_blocking boolean, waivable boolean",
        ("DQ_UNKNOWN_FORMAT", "BLOCKER", True, False),
        ("WARN", "WARNING", False, True),
    )
    runs = rows("run_id string, reconciled boolean", ("r1", True), ("r2", True), ("r3", True), ("r4", False))
    scopes = rows("run_id string, scope_key string", ("r1", "batch1"), ("r2", "batch1"), ("r3", "batch2"))
    gate = dq.publish_gate(dq.dq_issues([rows(ISSUES, issue)], version), runs, scopes)
    assert {r["run_id"] for r in gate.where("can_publish").collect()} == open_runs


def test_every_scope_judges_every_measurement(rows):
    meas = rows(
        "measurement_id long, test_item_id long, value_numeric double, raw_value string, measurement_status string",
        (1, 1, 5.0, "5", "MEASURED"), (2, 2, 5.0, "5", "MEASURED"), (3, 3, 5.0, "5", "MEASURED"),
    )
    limits = rows(
        "evaluation_type string, evaluation_scope_key string, test_item_id long, lsl_applied double, usl_applied double, "
        "lower_operator_applied string, upper_operator_applied string",
        ("SPEC", "A", 1, 0.0, 9.0, None, None), ("SPEC", "A", 2, 0.0, 9.0, None, None), ("SPEC", "A", 2, 6.0, 9.0, None, None),
        ("SPEC", "B", 3, 6.0, 9.0, None, None),
    )
    found = {
        (r["measurement_id"], r["evaluation_scope_key"]): r["evaluation_result"]
        for r in rules.evaluate_multi_scope(meas, limits).collect()
    }
    assert found == {
        (1, "A"): "PASS", (2, "A"): "CONFIG_AMBIGUOUS", (3, "A"): "NO_MATCH",
        (1, "B"): "NO_MATCH", (2, "B"): "NO_MATCH", (3, "B"): "FAIL",
    }


def test_units_without_ids_do_not_share_a_key(rows):
    schema = (
        "product_code string, lot_id string, wafer_id string, x_coord int, y_coord int, run_id string, vendor_unit_id string, "
        "unit_sequence long, source_row_no long, unit_id string"
    )
    nothing = ("P", "L", "W", None, 1, "r", None, None)
    found = clean.logical_unit_key(
        rows(schema, (*nothing, None, "u1"), (*nothing, None, "u2"), (*nothing, 7, "u3"), (*nothing[:-1], 7, 7, "u4")), "CP"
    )
    keys = [r["logical_unit_key"] for r in found.collect()]
    assert len(set(keys)) == 4
    assert None not in keys
    same = ("P", "L", "W", None, 1, "r")
    mixed = rows(schema, (*same, "5", 9, None, "u1"), (*same, None, 5, None, "u2"), (*same, None, None, 5, "u3"), *[(*same, *[None] * 4)] * 2)
    assert clean.logical_unit_key(mixed, "CP").select("logical_unit_key").distinct().count() == 5
    with pytest.raises(ValueError, match="vendor_unit_id"):
        clean.logical_unit_key(mixed.drop("vendor_unit_id", "unit_sequence", "source_row_no", "unit_id"), "CP")


FACTORS = [("V", "V", 1.0), ("mV", "V", 1e-3), ("A", "uA", 1e6), ("uA", "uA", 1.0), ("nA", "uA", 1e-3), ("pA", "uA", 1e-6), ("ft", "m", 0.3048), ("m", "m", 1.0)]


@pytest.mark.parametrize(("limit_unit", "value_unit", "places"), [("V", "mV", 3), ("mV", "V", -3), ("A", "nA", 9), ("uA", "nA", 3), ("nA", "uA", -3), ("pA", "A", -12)])
def test_a_value_on_the_limit_passes_in_every_unit(rows, spark, limit_unit, value_unit, places):
    """All limits of two decimals from 0.01 to 29.99; the value is the same number written in its own unit."""
    factors = rows("unit_raw string, unit_code string, factor double", *FACTORS)
    from decimal import Decimal

    sweep = [(limit_unit, value_unit, "SPEC", k / 100, k / 100, float(Decimal(k).scaleb(places - 2))) for k in range(1, 3000)]
    limits = rules.convert_limits(rows(LIMITS + ", value_numeric double", *sweep), factors).withColumns(
        {
            "raw_value": F.lit(""), "measurement_status": F.lit("MEASURED"), "binding_status": F.lit("MATCHED"), "n_candidates": F.lit(1),
            "lower_operator_applied": F.lit(">="), "upper_operator_applied": F.lit("<="),
        }
    )
    assert rules.evaluate_spec(limits).where("evaluation_result <> 'PASS'").count() == 0


def test_units_without_a_power_of_ten_are_multiplied(rows):
    factors = rows("unit_raw string, unit_code string, factor double", *FACTORS)
    got = rules.convert_limits(rows(LIMITS, ("ft", "m", "SPEC", 10.0, float("inf"))), factors).first()
    assert got["lsl_applied"] == pytest.approx(3.048) and got["usl_applied"] == float("inf") and got["unit_ok"]


def test_ten_thousand_boundaries_in_any_order(rows):
    """Most boundaries in one hour, some years away, some on microseconds; every event has the slot a search gives."""
    import bisect
    import random

    rng, base = random.Random(2), datetime(2020, 1, 1)
    bounds = [base + timedelta(microseconds=rng.randrange(3_600_000_000)) for _ in range(9_990)]
    bounds += [datetime(1900 + 17 * k, 1, 1) for k in range(10)]
    rule = rows("effective_from_utc timestamp_ntz, effective_to_utc timestamp_ntz", *[(b, None) for b in bounds])
    events = [base + timedelta(seconds=rng.uniform(-100, 4000)) for _ in range(3000)] + rng.sample(bounds, 500)
    facts = rows("at timestamp_ntz, k long", *[(e, i) for i, e in enumerate(events)], (None, -1))
    known = sorted(set(bounds))
    got = {r["k"]: r["__slot"] for r in rules.slotted(facts, "at", rule).collect()}
    assert got == {-1: -1, **{i: bisect.bisect_right(known, e) for i, e in enumerate(events)}}


def test_scopes_in_their_own_units(rows):
    meas = rows(
        "measurement_id long, test_item_id long, unit_raw string, value_numeric double, raw_value string, measurement_status string",
        (1, 1, "V", 4.03, "4.03", "MEASURED"), (2, 1, "mV", 4030.0, "4030", "MEASURED"), (3, 2, "uA", 5.0, "5", "MEASURED"),
    )
    limits = rows(
        "evaluation_type string, evaluation_scope_key string, test_item_id long, lsl_applied double, usl_applied double, "
        "lower_operator_applied string, upper_operator_applied string, unit_code string",
        ("SPEC", "A", 1, 4.03, 9.0, None, None, "V"), ("SPEC", "B", 1, 1.0, 4030.0, None, None, "mV"), ("SPEC", "B", 2, 1.0, 9.0, None, None, "V"),
    )
    judged = rules.evaluate_multi_scope(meas, limits, rows("unit_raw string, unit_code string, factor double", *FACTORS))
    found = {(r["measurement_id"], r["evaluation_scope_key"]): r["evaluation_reason"] for r in judged.collect()}
    assert found == {(1, "A"): "SPEC", (2, "A"): "SPEC", (1, "B"): "SPEC", (2, "B"): "SPEC", (3, "A"): "NO_BINDING", (3, "B"): "UNIT"}


def test_numbers_are_read_as_a_whole(rows):
    limits = rows("lower_limit_raw string, upper_limit_raw string", ("1,000", ">= 2.5"), ("1,5", "<3e2 "), ("2..3", "-.5"))
    found = clean.parse_limits(limits).collect()
    assert [r["program_lsl"] for r in found] == [None, None, None]
    assert [(r["program_usl"], r["upper_operator"]) for r in found] == [(2.5, ">="), (300.0, "<"), (-0.5, None)]
    values = rows("raw_value string", ("1d",), ("3f",), ("12D",), ("1.5",), (" 2e3 ",), ("5.",))
    assert [r["measurement_status"] for r in clean.parse_measurement_value(values).collect()] == ["INVALID"] * 3 + ["MEASURED"] * 3


def test_dice_without_a_position_are_in_no_zone(rows):
    rule = {"center_x": 5, "center_y": 5, "radius_x": 5, "radius_y": 5, "center_share": 0.5, "edge_share": 0.8}
    dice = rows("x_coord int, y_coord int", (5, 5), (None, 5), (10, 10))
    found = [[z["zone"] for z in r["z"]] for r in dice.select(spatial.zones(rule).alias("z")).collect()]
    assert found == [["CENTER", "UPPER_RIGHT"], ["NO_POSITION", "NO_POSITION"], ["EDGE", "UPPER_RIGHT"]]


def test_scratch_folders_are_shared_or_local():
    class Far:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        session.scratch_folder(Far, "any")


def test_overlapping_program_versions_are_reported_and_do_not_multiply(rows):
    day = datetime(2020, 1, 1)
    schema = "program_version_id long, program_code string, version_code string, valid_from_utc timestamp_ntz, valid_to_utc timestamp_ntz"
    versions = rows(
        schema, (1, "P", "a", None, day + timedelta(days=9)), (2, "P", "b", day + timedelta(days=5), None), (3, "Q", "c", None, None)
    )
    facts = rows("program_code string, at timestamp_ntz", *[(p, day + timedelta(days=k)) for p in "PQR" for k in (1, 6, 9)], ("P", None))
    found = clean.map_program_version(facts, versions, "at").collect()
    assert len(found) == 10
    got = {(r["program_code"], r["at"].day): (r["program_version_id"], r["version_status"]) for r in found if r["at"]}
    assert got == {
        ("P", 2): (1, "MATCHED"), ("P", 7): (None, "CONFIG_AMBIGUOUS"), ("P", 10): (2, "MATCHED"),
        ("Q", 2): (3, "MATCHED"), ("Q", 7): (3, "MATCHED"), ("Q", 10): (3, "MATCHED"),
        **{("R", d): (None, "NO_MATCH") for d in (2, 7, 10)},
    }


def test_an_issue_of_one_run_does_not_close_its_lot(rows):
    runs = rows("run_id string, lot_id string, receipt_id long", ("a", "L", 1), ("b", "L", 2), ("c", "M", None))
    files = rows("receipt_id long, import_batch_id string", (1, "in"), (2, "in"), (9, "in"), (8, "alone"))
    closure = dq.scope_closure(runs, files)
    state = rows("run_id string, reconciled boolean", ("a", True), ("b", True), ("c", True))
    version = rows("rule_code string, severity string, is_blocking boolean, waivable boolean", ("X", "BLOCKER", True, False))

    def open_runs(kind, key):
        issue = rows("rule_code string, scope_type string, scope_key string, resolution_status string", ("X", kind, key, "OPEN"))
        gate = dq.publish_gate(dq.dq_issues([issue], version, "v1"), state, closure)
        return {r["run_id"] for r in gate.where("can_publish").collect()}

    assert open_runs("RUN", "a") == {"b", "c"}
    assert open_runs("LOT", "L") == {"c"}
    assert open_runs("FILE", "2") == {"a", "c"}
    assert open_runs("BATCH", "in") == {"c"}
    assert open_runs("FILE", "9") == open_runs("BATCH", "alone") == {"a", "b", "c"}
    assert open_runs("FILE", "77") == open_runs("ALL", None) == open_runs("RUN", "zz") == set()
    summary = dq.dq_summary(
        dq.dq_issues([rows("rule_code string, scope_type string, scope_key string, resolution_status string", ("X", "BATCH", "in", "OPEN"), ("X", "ALL", None, "OPEN"))], version),
        closure,
    )
    assert {(r["run_id"], r["blocker"]) for r in summary.collect()} == {("a", 1), ("b", 1), (None, 2)}


def test_row_counts_are_held_against_the_program_of_the_run(rows):
    counts = rows(
        "run_id string, row_count_input long, unit_count_output long, measurement_count_output long",
        ("a", 5, 5, 20), ("b", 5, 5, 20), ("c", 5, 5, 20), ("d", 6, 5, 20),
    )
    found = dq.dq_row_reconciliation(counts, rows("run_id string, n_items long", ("a", 4), ("b", 5), ("d", 4)))
    assert {r["scope_key"] for r in found.collect()} == {"b", "c", "d"}


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_reconciliation_finds_every_difference(rows, buckets):
    schema = "k string, j long, v long, t string"
    base = [(f"k{i}", i % 3, i, "t") for i in range(200)]
    observed = rows(schema, *base[5:], ("extra", 1, 1, "t"), ("k9", 0, 9, "t"), (None, 1, 1, None))
    expected = rows(schema, *base[:50], *[(k, j, v + (v == 60), t) for k, j, v, t in base[50:]], (None, 1, 1, "x"))
    same = dq.Level("SAME", observed, observed, ["k", "j"])
    found = dq.golden_reconcile([dq.Level("ROW", observed, expected, ["k", "j"]), same], buckets).collect()
    assert {(r["level"], r["entity_key"], r["problem"], r["observed"], r["expected"]) for r in found} == {
        *[("ROW", f"k{i}|{i % 3}", "MISSING", None, f"{i}|t") for i in range(5)],
        ("ROW", "extra|1", "EXTRA", "1|t", None),
        ("ROW", "k9|0", "CHANGED", "2 rows", "9|t"),
        ("ROW", "k60|0", "CHANGED", "60|t", "61|t"),
        ("ROW", "-|1", "CHANGED", "1|-", "1|x"),
    }


def test_refused_wafers_are_on_no_map(rows):
    schema = (
        "unit_id string, logical_unit_key string, lot_id string, wafer_id string, product_code string, x_coord int, y_coord int, "
        "run_attempt_no int, attempt_no int, unit_sequence long, soft_bin string, outcome string"
    )

    def die(i, lot, wafer, x, outcome="FAIL"):
        return (f"u{i}", f"k{i}", lot, wafer, "P", x, 1, 0, 0, i, "1", outcome)

    dice = rows(schema, die(1, "L", "A", 1), die(2, "L", "A", 2), die(3, "L", "B", 1), die(4, "L", "B", None), die(5, None, "C", 1), die(6, "L", None, 1))
    meas = rows(
        "unit_id string, lot_id string, wafer_id string, parameter_code string, value_numeric double, measurement_status string",
        *[(f"u{i}", "L", "A", "VTH", float(i), "MEASURED") for i in range(1, 7)],
    )
    rule = {"center_x": 1, "center_y": 1, "radius_x": 5, "radius_y": 5, "center_share": 0.5, "edge_share": 0.8}
    maps = [
        spatial.wafer_map_bin(dice), spatial.wafer_map_parameter(dice, meas, "VTH"), spatial.stacked_fail_map(dice),
        spatial.parameter_fail_overlay(dice, meas, "VTH", ["1"]), spatial.neighbour_fail_count(dice),
    ]
    for shown in maps:
        found = shown.collect()
        assert len(found) == 2 and {r["basis"] for r in found} == {"final"}
    zone = spatial.zone_summary(dice, meas, rule, ["VTH"]).where("zone_kind = 'RING'").collect()
    assert [(r["n_units"], r["mean_vth"]) for r in zone] == [(2, 1.5)]
    everything = spatial.spatial_eligibility(dice).withColumn("eligible", F.lit(True))
    assert spatial.wafer_map_bin(dice, eligible=everything).where("lot_id = 'L' AND wafer_id = 'B'").count() == 2
