"""Conflict vectors: none, one and several candidates, inactive, expired and draft rules."""

import pytest
from pyspark.sql import functions as F

from dielens.operators import rules
from dielens.plans.inline import inline

BINDING = (
    "spec_binding_id long, spec_set_id long, scope_code string, supplier_id long, product_code string, test_stage string, "
    "program_version_id long, customer_code string, quality_grade string, package_code string, "
    "effective_from_utc timestamp_ntz, effective_to_utc timestamp_ntz, active boolean"
)


def resolve(spark, rows, bindings, context, sets=((1, "RELEASED"), (2, "RELEASED"), (3, "DRAFT"))):
    from datetime import datetime

    full = []
    for b in bindings:
        b = {"active": True, **b}
        full.append(
            tuple(
                datetime.fromisoformat(b[n]) if n.startswith("effective") and b.get(n) else b.get(n)
                for n in [c.split()[0] for c in BINDING.split(", ")]
            )
        )
    schema = "supplier_id long, product_code string, test_stage string, at timestamp_ntz"
    made = spark.createDataFrame([(*context[:3], datetime.fromisoformat(context[3]))], schema)
    got = rules.resolve_spec_binding(
        made, spark.createDataFrame(full, BINDING), rows("spec_set_id long, status string", *sets), inline(spark, "scopes"), "at"
    ).first()
    return got["binding_status"], got["spec_binding_id"], got["n_candidates"]


CONTEXT = (7, "P1", "CP", "2020-05-05 00:00:00")


def b(id_, set_=1, scope="GLOBAL", **fields):
    return {"spec_binding_id": id_, "spec_set_id": set_, "scope_code": scope, **fields}


@pytest.mark.parametrize(
    "bindings, want",
    [
        ([b(1)], ("MATCHED", 1, 1)),
        ([b(1, product_code="P2")], ("NO_MATCH", None, 0)),
        ([b(1), b(2, scope="PRODUCT", product_code="P1")], ("MATCHED", 2, 1)),
        ([b(1, scope="PRODUCT", product_code="P1"), b(2, 2, "PRODUCT", supplier_id=7)], ("CONFIG_AMBIGUOUS", None, 2)),
        ([b(1), b(2, scope="PRODUCT", product_code="P1", active=False)], ("MATCHED", 1, 1)),
        ([b(1), b(2, 3, "PRODUCT", product_code="P1")], ("MATCHED", 1, 1)),
        ([b(1, effective_to_utc="2020-05-05 00:00:00")], ("NO_MATCH", None, 0)),
        ([b(1, effective_from_utc="2020-05-05 00:00:00")], ("MATCHED", 1, 1)),
        ([b(1, customer_code="C9")], ("NO_MATCH", None, 0)),
        ([b(1, scope="NOWHERE")], ("NO_MATCH", None, 0)),
    ],
)
def test_candidates(spark, rows, bindings, want):
    assert resolve(spark, rows, bindings, CONTEXT) == want


def test_filled_field_never_matches_a_null_context(spark, rows):
    context = (None, "P1", "CP", "2020-05-05 00:00:00")
    assert resolve(spark, rows, [b(1, supplier_id=7)], context)[0] == "NO_MATCH"
    assert resolve(spark, rows, [b(1, product_code="P1")], context)[0] == "MATCHED"


MEAS = (
    "measurement_status string, value_numeric double, raw_value string, binding_status string, n_candidates int, limit_source string, "
    "lsl_applied double, usl_applied double, lower_operator_applied string, upper_operator_applied string, unit_ok boolean"
)


@pytest.mark.parametrize(
    "row, want",
    [
        (("MEASURED", 5.0, "5", "CONFIG_AMBIGUOUS", 2, "NONE", None, None, None, None, True), ("CONFIG_AMBIGUOUS", "2")),
        (("INVALID", None, "x", "NO_MATCH", 0, "NONE", None, None, None, None, True), ("NO_MATCH", "NO_BINDING")),
        (("INVALID", None, "x", "MATCHED", 1, "SPEC", 1.0, 9.0, None, None, True), ("INVALID_VALUE", "x")),
        (("NOT_TESTED", None, "", "MATCHED", 1, "SPEC", 1.0, 9.0, None, None, True), ("NOT_EVALUATED", "NOT_TESTED")),
        (("OVER_RANGE", None, "OVER", "MATCHED", 1, "SPEC", 1.0, 9.0, None, None, True), ("NOT_EVALUATED", "OVER_RANGE")),
        (("MEASURED", 5.0, "5", "MATCHED", 1, "SPEC", 1.0, 9.0, None, None, False), ("NOT_EVALUATED", "UNIT")),
        (("MEASURED", 5.0, "5", "MATCHED", 1, "SPEC", None, None, None, None, True), ("NOT_EVALUATED", "NO_LIMIT")),
        (("MEASURED", 5.0, "5", "MATCHED", 1, "SPEC", 1.0, 9.0, "~", None, True), ("NOT_EVALUATED", "BAD_OPERATOR")),
        (("MEASURED", 9.0, "9", "MATCHED", 1, "SPEC", None, 9.0, None, None, True), ("PASS", "SPEC")),
        (("MEASURED", 9.0, "9", "MATCHED", 1, "SPEC", None, 9.0, None, "<", True), ("FAIL", "HIGH")),
        (("MEASURED", 1.0, "1", "MATCHED", 1, "SPEC", 1.0, None, ">", None, True), ("FAIL", "LOW")),
        (("MEASURED", 1.0, "1", "NO_MATCH", 0, "PROGRAM", 1.0, None, None, None, True), ("PASS", "PROGRAM_LIMIT_FALLBACK")),
    ],
)
def test_evaluate_spec_precedence(rows, row, want):
    got = rules.evaluate_spec(rows(MEAS, row)).first()
    assert (got["evaluation_result"], got["evaluation_reason"]) == want


def test_two_items_under_one_key_are_ambiguous(rows):
    resolved = rows(
        "spec_set_id long, test_item_id long, parameter_code string, binding_status string, n_candidates long", (1, 5, "A", "MATCHED", 1)
    )
    fields = "spec_item_id long, spec_set_id long, test_item_id long, parameter_code string, lsl double, usl double, lower_operator string, upper_operator string, unit_code string"
    items = rows(fields, (1, 1, None, "A", 1.0, 2.0, None, None, "V"), (2, 1, None, "A", 1.0, 3.0, None, None, "V"))
    got = rules.match_spec_item(resolved, items).first()
    assert (got["binding_status"], got["spec_item_id"], got["n_candidates"]) == ("CONFIG_AMBIGUOUS", None, 2)


def test_equal_filters_have_equal_keys(spark):
    maps = spark.sql(
        """SELECT map('lot', array('L2','L1','L2'), 'bin', array()) AS f, 'R' AS r, 'D' AS d
        UNION ALL SELECT map('lot', array('L1','L2')), 'R', 'D'"""
    )
    keys = rules.evaluation_run_key(maps, "f", "r", "d")
    assert keys.select("cache_key").distinct().count() == 1
    assert keys.first()["filter_json"] == '{"lot":["L1","L2"]}'
    assert keys.where(F.length("filter_hash") == 64).count() == 2


def test_current_evaluation_sorts_no_rows_before_they_are_shuffled(rows):
    schema = "measurement_id string, evaluation_type string, evaluation_scope_key string, evaluated_at_utc long, evaluation_run_id long, result string"
    evals = rows(
        schema, ("m", "SPEC", "D", 1, 9, "old"), ("m", "SPEC", "D", 2, 1, "x"), ("m", "SPEC", "D", 2, 3, "new"), ("m", "SPEC", "D", None, 5, "y"),
        ("m", "SPEC", "E", 1, 1, "one"), (None, "SPEC", "D", 1, 1, "p"), (None, "SPEC", "D", 2, 1, "q"), ("k", "SPEC", "D", 1, 1, "k"), ("k", "SPEC", "D", 1, 1, "k"),
    )
    current = rules.current_evaluation(evals)
    assert current.columns == evals.columns
    found = sorted((str(r["measurement_id"]), r["evaluation_scope_key"], r["result"]) for r in current.collect())
    assert found == [("None", "D", "q"), ("k", "D", "k"), ("m", "D", "new"), ("m", "E", "one")]
    assert "WindowGroupLimit" not in current._jdf.queryExecution().toString()
