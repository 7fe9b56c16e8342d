"""Retest vectors by hand, gate vectors, and the invariants of the query surface."""

import pytest
from pyspark.sql import functions as F

from dielens.operators import dq, query, spatial, stats, units, versions
from dielens.plans import fixtures as fx

UNIT = "unit_id string, logical_unit_key string, lot_id string, run_attempt_no int, attempt_no int, unit_sequence int, outcome string"


@pytest.fixture
def retests(rows):
    """Ten tests of four dice; die A passes as attempt 3 of run 0 and fails in the later run."""
    return rows(
        UNIT,
        ("a0", "A", "L1", 0, 0, 1, "FAIL"),
        ("a1", "A", "L1", 0, 1, 7, "FAIL"),
        ("a2", "A", "L1", 0, 2, 8, "FAIL"),
        ("a3", "A", "L1", 0, 3, 9, "PASS"),
        ("a4", "A", "L1", 1, 0, 1, "FAIL"),
        ("b0", "B", "L1", 0, 0, 2, "PASS"),
        ("c0", "C", "L1", 0, 0, 3, "FAIL"),
        ("c1", "C", "L1", 1, 0, 2, "PASS"),
        ("d0", "D", "L1", 0, 0, 4, "UNRESOLVED"),
        ("d1", "D", "L1", 0, 0, 5, "PASS"),
    )


def test_final_is_the_tuple_not_the_attempt_number(retests):
    assert {r["unit_id"] for r in units.final_units(retests).collect()} == {"a4", "b0", "c1", "d1"}
    assert {r["unit_id"] for r in units.first_pass_units(retests).collect()} == {"a0", "b0", "c0", "d0"}


def test_yield_and_gain(retests):
    first = units.yield_by(retests, ["lot_id"], "first").first()
    assert (first["total"], first["n_pass"], first["n_fail"], first["unresolved"], first["yield"]) == (4, 1, 2, 1, 0.25)
    gain = units.retest_gain(retests, ["lot_id"]).first()
    assert (gain["first_pass"], gain["final_pass"], gain["recovered"], gain["lost"]) == (1, 3, 2, 0)
    assert units.yield_by(retests, ["lot_id"], "all").first()["total"] == 10


def test_all_attempts_keeps_every_row(retests):
    marked = units.all_attempts(retests)
    assert marked.count() == 10
    assert marked.where("is_first").count() == 4 and marked.where("is_final AND is_first").count() == 1


ISSUE = "run_id string, severity string, is_blocking boolean, waivable boolean, resolution_status string"


@pytest.mark.parametrize(
    "issue, passes",
    [
        (("r", "BLOCKER", True, False, "OPEN"), False),
        (("r", "BLOCKER", True, False, "WAIVED"), False),
        (("r", "BLOCKER", True, False, "IGNORED"), False),
        (("r", "BLOCKER", True, False, "RESOLVED"), True),
        (("r", "ERROR", False, True, "OPEN"), False),
        (("r", "ERROR", False, True, "WAIVED"), True),
        (("r", "ERROR", False, False, "WAIVED"), False),
        (("r", "WARNING", False, True, "OPEN"), True),
        (("r", "INFO", True, True, "OPEN"), False),
    ],
)
def test_publish_gate(rows, issue, passes):
    gate = dq.publish_gate(rows(ISSUE, issue), rows("run_id string, reconciled boolean", ("r", True), ("clean", True), ("bad", False)))
    got = {r["run_id"]: r["can_publish"] for r in gate.collect()}
    assert got == {"r": passes, "clean": True, "bad": False}


DV = (
    "dataset_id long, dataset_version_id long, version_no int, status string, is_current boolean, published_by long, "
    "published_at_utc timestamp_ntz, row_count long, unit_count long, measurement_count long"
)


def test_publish_switch_and_snapshots(spark, rows, tmp_path):
    table = rows(
        DV,
        (1, 11, 1, "PUBLISHED", True, 1, None, 10, 5, 20),
        (1, 12, 2, "VALIDATING", False, None, None, 14, 7, 28),
        (2, 21, 1, "VALIDATING", False, None, None, 1, 1, 1),
        (2, 22, 2, "VALIDATING", False, None, None, 1, 1, 1),
        (3, 31, 1, "VALIDATING", False, None, None, 1, 1, 1),
    )
    candidates = rows("dataset_version_id long, can_publish boolean", (12, True), (21, True), (22, True), (31, False))
    state = versions.publish_version(table, candidates, 9, "2024-01-01 00:00:00")
    got = {r["dataset_version_id"]: (r["status"], r["is_current"]) for r in state.collect()}
    assert got[11] == ("SUPERSEDED", False) and got[12] == ("PUBLISHED", True)
    assert got[21][0] == got[22][0] == got[31][0] == "VALIDATING"
    root = str(tmp_path / "dv")
    versions.publish_snapshot(table, root)
    versions.publish_snapshot(state, root)
    (tmp_path / "dv" / "snapshot=00000003").mkdir()
    current = versions.current_snapshot(spark, root)
    assert current.where("is_current").first()["dataset_version_id"] == 12
    again = versions.seed_upsert(table, state, ["dataset_version_id"])
    assert sorted(again.collect()) == sorted(table.collect())


def test_pages_add_up_and_filters_split(spark, sf):
    rows_ = fx.cp_rows(spark, sf).select("unit_id", "lot_id", "soft_bin", "wafer_id")
    picked = query.apply_global_filter(rows_, {"lot": ["L1"], "wafer": []})
    total = picked.count()
    seen = set()
    for number in range(1, total // 200 + 2):
        page = query.page(picked, ["-soft_bin"], number).collect()
        assert all(r["total"] == total for r in page)
        assert not seen & {r["unit_id"] for r in page}
        seen |= {r["unit_id"] for r in page}
    assert len(seen) == total
    lots = [r[0] for r in rows_.select("lot_id").distinct().collect()]
    assert sum(query.apply_global_filter(rows_, {"lot": [x]}).count() for x in lots) == rows_.count()
    long_list = lots + [f"X{i}" for i in range(2000)]
    assert query.apply_global_filter(rows_, {"lot": long_list}).count() == rows_.count()
    with pytest.raises(ValueError):
        query.apply_global_filter(rows_, {"colour": ["red"]})
    with pytest.raises(ValueError):
        query.page(rows_, [], 1, 300)


MEAS = "unit_id string, parameter_code string, lot_id string, value_numeric double, measurement_status string"


def test_capability_edge_cases(rows):
    data = [("u", "FLAT", "a", 5.0, "MEASURED")] * 4 + [("u", "ONE", "a", 5.0, "MEASURED")]
    data += [("u", "NONE", "a", None, "NOT_TESTED")]
    data += [(f"u{i}", "UPPER", lot, v, "MEASURED") for lot in "ab" for i, v in enumerate((9.0, 10.0, 11.0))]
    limits = rows("parameter_code string, lsl double, usl double", *[(p, None if p == "UPPER" else 1.0, 13.0) for p in ("FLAT", "ONE", "UPPER")])
    got = {r["parameter_code"]: r for r in stats.capability(rows(MEAS, *data), limits, ["parameter_code"], ["lot_id"]).collect()}
    assert (got["FLAT"]["cpk"], got["FLAT"]["reason"]) == (None, "NO_SPREAD")
    assert (got["ONE"]["ppk"], got["ONE"]["reason"]) == (None, "TOO_FEW")
    upper = got["UPPER"]
    assert upper["cp"] is None and upper["cpk"] == pytest.approx(1.0) and upper["std_within"] == pytest.approx(1.0)
    assert upper["std_overall"] == pytest.approx((4 / 5) ** 0.5) and upper["reason"] is None


def test_empty_input_gives_empty_results(rows):
    none = rows(MEAS)
    assert stats.parameter_summary(none, ["parameter_code"]).count() == 0
    assert stats.zscore_anomalies(none, ["parameter_code"], 3).count() == 0


def test_neighbours_and_rotation(rows):
    dice = rows(
        "unit_id string, lot_id string, wafer_id string, x_coord int, y_coord int, outcome string",
        *[(f"{x},{y}", "L", "W", x, y, "FAIL" if (x, y) in {(0, 0), (1, 1)} else "PASS") for x in range(3) for y in range(3)],
    )
    got = {r["unit_id"]: r["n_fail_neighbours"] for r in spatial.neighbour_fail_count(dice, "all").collect()}
    assert (got["0,0"], got["1,0"], got["2,2"], got["2,0"]) == (1, 2, 1, 1)
    frames = rows(
        "run_id string, origin_position string, x_direction string, y_direction string, rotation_degree int, notch_orientation string",
        ("r90", "LOWER_LEFT", None, None, 90, None),
        ("up", "UPPER_LEFT", None, None, None, "DOWN"),
        ("odd", "CENTER", None, None, 45, None),
    )
    placed = spatial.normalize_coordinates(rows("run_id string, x_coord int, y_coord int", ("r90", 3, 1), ("up", 3, 1), ("odd", 3, 1)), frames)
    where = {r["run_id"]: (r["x_norm"], r["y_norm"]) for r in placed.collect()}
    assert where == {"r90": (1, -3), "up": (3, -1), "odd": (None, None)}


def test_wafer_without_a_position_is_refused(rows):
    dice = rows("lot_id string, wafer_id string, x_coord int, y_coord int", ("L", "W1", 1, 1), ("L", "W2", 1, None), ("L", None, 1, 1))
    got = {r["wafer_id"]: r["reason"] for r in spatial.spatial_eligibility(dice).collect()}
    assert got == {"W1": None, "W2": "NO_POSITION", None: "NO_WAFER"}
    assert dice.where(F.col("x_coord").isNull()).count() == 0


def test_dice_are_shuffled_as_they_are_read(spark, sf):
    """The texts of a die are made after its numbers, so no exchange carries them."""
    dice = fx.cp(spark, sf)
    assert dice.columns == [*fx.cp_rows(spark, sf).columns, "unit_sequence", "attempt_no"]
    plan = dice._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [k for k, line in enumerate(plan) if "Window " in line]
    made = [k for k, line in enumerate(plan) if "AS unit_id" in line]
    assert made and max(made) < min(windows)
    want = fx.cp_rows(spark, sf).exceptAll(dice.drop("unit_sequence", "attempt_no"))
    assert want.isEmpty() and dice.count() == fx.cp_rows(spark, sf).count()


def test_publish_gate_finds_the_runs_once(spark, rows):
    """What a run's state is made from may be all facts; it is read once for scopes and result together."""
    seen = spark.sparkContext.accumulator(0)

    def counted(value):
        seen.add(1)
        return value

    state = rows("run_id string, ok boolean", ("r", True), ("bad", False)).repartition(1)
    state = state.select(F.udf(counted, "string")("run_id").alias("run_id"), F.col("ok").alias("reconciled"))
    gate = dq.publish_gate(rows(ISSUE, ("r", "INFO", False, True, "OPEN")), state)
    assert {r["run_id"]: r["can_publish"] for r in gate.collect()}["bad"] is False
    assert seen.value == 2


def test_issues_are_counted_where_they_are_found(spark, sf):
    """All issues are read from the tables by whoever counts them, and not written with all their texts first."""
    from dielens.plans import dq_queries

    assert any("lineitem" in f for f in dq_queries.all_issues(spark, sf).inputFiles())
