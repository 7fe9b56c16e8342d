"""Rule resolution and evaluation over dice and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from dielens.functions.columns import ntz
from dielens.operators import rules, units
from dielens.plans import fixtures as fx
from dielens.plans.inline import inline
from dielens.plans.registry import query

_SPEC_KEY = """a.supplier_id = m.supplier_id AND a.product_code = m.product_code AND a.lot_id = m.lot_id
 AND a.tested_at_utc = m.tested_at_utc"""


def bound(spark, rows):
    return rules.resolve_spec_binding(
        rows, inline(spark, "bindings"), inline(spark, "spec_sets"), inline(spark, "scopes"), "tested_at_utc"
    )


@query(
    "resolve_spec_binding",
    f"""SELECT m.unit_id, a.spec_binding_id, a.spec_set_id, a.binding_status, a.n_candidates
FROM cp_rows m JOIN spec_res a ON {_SPEC_KEY}""",
)
def _(spark, sf):
    return bound(spark, fx.cp_rows(spark, sf)).select(
        "unit_id", "spec_binding_id", "spec_set_id", "binding_status", "n_candidates"
    )


@query(
    "match_spec_item",
    f"""SELECT m.measurement_id, a.binding_status, a.spec_item_id, a.lsl, a.usl, a.lower_operator, a.upper_operator,
 a.limit_unit AS unit_code FROM meas m JOIN spec_lim a ON {_SPEC_KEY} AND a.test_item_id = m.test_item_id""",
)
def _(spark, sf):
    matched = rules.match_spec_item(bound(spark, fx.meas(spark, sf)), inline(spark, "spec_items"))
    return matched.select(
        "measurement_id", "binding_status", "spec_item_id", "lsl", "usl", "lower_operator", "upper_operator", "unit_code"
    )


@query(
    "program_limit_fallback",
    f"""SELECT m.measurement_id, a.limit_source, CASE a.limit_source WHEN 'SPEC' THEN a.lsl WHEN 'PROGRAM' THEN a.program_lsl END AS lsl_applied,
 CASE a.limit_source WHEN 'SPEC' THEN a.usl WHEN 'PROGRAM' THEN a.program_usl END AS usl_applied
FROM meas m JOIN spec_applied a ON {_SPEC_KEY} AND a.test_item_id = m.test_item_id""",
)
def _(spark, sf):
    matched = rules.match_spec_item(bound(spark, fx.meas(spark, sf)), inline(spark, "spec_items"))
    limits = rules.program_limit_fallback(matched, inline(spark, "items"), True)
    return limits.select("measurement_id", "limit_source", "lsl_applied", "usl_applied")


@query(
    "evaluate_spec",
    """SELECT measurement_id, spec_binding_id, spec_item_id, lsl_applied, usl_applied, evaluation_result, evaluation_reason,
 'SPEC' AS evaluation_type, 'DEFAULT' AS evaluation_scope_key FROM evals""",
)
def _(spark, sf):
    return fx.evals(spark, sf).select(
        "measurement_id",
        "spec_binding_id",
        "spec_item_id",
        "lsl_applied",
        "usl_applied",
        "evaluation_result",
        "evaluation_reason",
        "evaluation_type",
        "evaluation_scope_key",
    )


JUDGED = """SELECT m.measurement_id, k.evaluation_type, k.evaluation_scope_key,
 CASE WHEN s.test_item_id IS NULL THEN 'NO_MATCH' WHEN m.measurement_status <> 'MEASURED' OR NOT s.unit_ok THEN 'NOT_EVALUATED' WHEN s.lsl_applied IS NULL AND s.usl_applied IS NULL THEN 'NOT_EVALUATED'
  WHEN s.upper_operator_applied = '==' THEN 'NOT_EVALUATED'
  WHEN m.value_numeric < s.lsl_applied OR (s.lower_operator_applied = '>' AND m.value_numeric <= s.lsl_applied) THEN 'FAIL'
  WHEN m.value_numeric > s.usl_applied OR (s.upper_operator_applied = '<' AND m.value_numeric >= s.usl_applied) THEN 'FAIL'
  ELSE 'PASS' END AS evaluation_result
FROM meas m CROSS JOIN (SELECT DISTINCT evaluation_type, evaluation_scope_key FROM scope_limits) k
LEFT JOIN scope_applied s ON s.test_item_id = m.test_item_id AND s.evaluation_type = k.evaluation_type
 AND s.evaluation_scope_key = k.evaluation_scope_key"""


@query("evaluate_multi_scope", JUDGED)
def _(spark, sf):
    judged = rules.evaluate_multi_scope(fx.meas(spark, sf), inline(spark, "scope_limits"), inline(spark, "factors"))
    return judged.select("measurement_id", "evaluation_type", "evaluation_scope_key", "evaluation_result")


def two_runs(spark, sf):
    """A first evaluation run over everything and a second, stricter one over every other supplier."""
    stamp = [("evaluated_at_utc", "2024-01-01 00:00:00"), ("evaluated_at_utc", "2024-02-01 00:00:00")]
    first = fx.evals(spark, sf).withColumns({stamp[0][0]: ntz(stamp[0][1]), "evaluation_run_id": F.lit(1)})
    second = (
        fx.evals(spark, sf, allow=False)
        .where("supplier_id % 2 = 0")
        .withColumns({stamp[1][0]: ntz(stamp[1][1]), "evaluation_run_id": F.lit(2)})
    )
    return first.unionByName(second)


_STRICT = "CASE WHEN limit_source = 'PROGRAM' THEN 'NO_MATCH' ELSE evaluation_result END"


@query(
    "current_evaluation",
    f"""SELECT measurement_id, 'SPEC' AS evaluation_type, 'DEFAULT' AS evaluation_scope_key,
 CASE WHEN supplier_id % 2 = 0 THEN 2 ELSE 1 END AS evaluation_run_id,
 CASE WHEN supplier_id % 2 = 0 THEN {_STRICT} ELSE evaluation_result END AS evaluation_result FROM evals""",
)
def _(spark, sf):
    wanted = ["measurement_id", "evaluation_type", "evaluation_scope_key", "evaluation_run_id", "evaluation_result"]
    return rules.current_evaluation(two_runs(spark, sf).select(*wanted, "evaluated_at_utc")).select(*wanted)


@query(
    "resolve_bin",
    """SELECT m.unit_id, r.bin_mapping_set_id, r.set_status, r.n_candidates FROM cp_rows m JOIN bin_res r
 ON r.supplier_id = m.supplier_id AND r.product_code = m.product_code AND r.tested_at_utc = m.tested_at_utc""",
)
def _(spark, sf):
    resolved = rules.resolve_bin(fx.cp_rows(spark, sf), inline(spark, "bin_sets"), inline(spark, "scopes"))
    return resolved.select("unit_id", "bin_mapping_set_id", "set_status", "n_candidates")


@query(
    "evaluate_bin",
    """SELECT unit_id, soft_bin, bin_mapping_set_id, bin_definition_id, mapping_status, is_pass_snapshot, failure_mode_snapshot,
 outcome FROM outcomes""",
)
def _(spark, sf):
    return fx.with_outcome(spark, fx.cp_rows(spark, sf)).select(
        "unit_id",
        "soft_bin",
        "bin_mapping_set_id",
        "bin_definition_id",
        "mapping_status",
        "is_pass_snapshot",
        "failure_mode_snapshot",
        "outcome",
    )


@query(
    "spec_per_lot",
    f"""SELECT m.lot_id, a.spec_set_id, a.binding_status, count(*) AS n_rows, count(DISTINCT m.wafer_id) AS n_wafers
FROM cp_rows m JOIN spec_res a ON {_SPEC_KEY} GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rules.spec_per_lot(
        fx.cp_rows(spark, sf), inline(spark, "bindings"), inline(spark, "spec_sets"), inline(spark, "scopes")
    )


@query(
    "evaluation_run_key",
    """WITH t AS (SELECT o_orderkey, concat('DV', o_custkey % 5) AS dataset_version, concat('R', o_orderkey % 3) AS rule_version,
 concat('{', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('"bin":["', o_custkey % 7, '"],') END, '"lot":[',
  CASE WHEN o_custkey % 10 = o_orderkey % 10 THEN concat('"L', o_custkey % 10, '"')
       ELSE concat('"L', least(o_custkey % 10, o_orderkey % 10), '","L', greatest(o_custkey % 10, o_orderkey % 10), '"') END,
  '],"wafer":["W1","W2"]}') AS filter_json FROM orders)
SELECT o_orderkey, filter_json, sha256(filter_json) AS filter_hash,
 concat(dataset_version, '/', rule_version, '/', sha256(filter_json)) AS cache_key FROM t""",
)
def _(spark, sf):
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    lots = F.array(F.concat(F.lit("L"), cust % 10), F.concat(F.lit("L"), order % 10))
    bins = F.when(order % 3 == 0, F.array().cast("array<string>")).otherwise(F.array((cust % 7).cast("string")))
    asked = fx.table(spark, sf, "orders").select(
        order,
        F.concat(F.lit("DV"), cust % 5).alias("dataset_version"),
        F.concat(F.lit("R"), order % 3).alias("rule_version"),
        F.create_map(
            F.lit("wafer"), F.array(F.lit("W2"), F.lit("W1"), F.lit("W2")), F.lit("lot"), lots, F.lit("bin"), bins
        ).alias("filters"),
    )
    keyed = rules.evaluation_run_key(asked, "filters", "rule_version", "dataset_version")
    return keyed.select("o_orderkey", "filter_json", "filter_hash", "cache_key")


@query(
    "apply_exclusions",
    """SELECT measurement_id, coalesce(value_numeric > 90000 AND parameter_code = 'BVDSS', false) AS excluded,
 CASE WHEN value_numeric > 90000 AND parameter_code = 'BVDSS' THEN 'BVDSS above 90 kV' END AS exclusion_reason FROM meas""",
)
def _(spark, sf):
    high = (F.col("value_numeric") > 90000) & (F.col("parameter_code") == "BVDSS")
    flagged = rules.apply_exclusions(fx.meas(spark, sf), "BVDSS above 90 kV", high)
    return flagged.select("measurement_id", "excluded", "exclusion_reason")


@query(
    "compare_rule_versions",
    f"SELECT evaluation_result AS old_result, {_STRICT} AS new_result, count(*) AS n FROM evals GROUP BY 1, 2",
)
def _(spark, sf):
    return rules.compare_rule_versions(fx.evals(spark, sf), fx.evals(spark, sf, allow=False))


@query(
    "persist_metric",
    """WITH t AS (SELECT lot_id, wafer_id, count(*) AS total, count(*) FILTER (outcome = 'PASS') AS n_pass FROM final_u GROUP BY 1, 2)
SELECT sha256(concat('YIELD/', lot_id)) AS evaluation_run_id, 'YIELD' AS metric_code, concat(lot_id, '/', wafer_id) AS scope_key,
 concat('{"total":', total, ',"n_pass":', n_pass, '}') AS result_json FROM t""",
)
def _(spark, sf):
    yields = units.yield_by(fx.outcomes(spark, sf), ["lot_id", "wafer_id"]).select("lot_id", "wafer_id", "total", "n_pass")
    run = F.sha2(F.concat(F.lit("YIELD/"), "lot_id"), 256)
    return rules.persist_metric(yields, run, "YIELD", ["lot_id", "wafer_id"])
