"""Retest, yield and bin reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from dielens.functions.columns import rounded, steady
from dielens.operators import units
from dielens.plans import fixtures as fx
from dielens.plans.registry import query, r4

BINS = [str(b) for b in range(11)]
_ID = "unit_id, logical_unit_key, run_id, attempt_no, unit_sequence, soft_bin"
_COUNTS = """count(*) AS total, count(*) FILTER (outcome = 'PASS') AS n_pass,
 count(*) FILTER (outcome = 'FAIL') AS n_fail, count(*) FILTER (outcome = 'UNRESOLVED') AS unresolved"""
_YIELD = "round(count(*) FILTER (outcome = 'PASS') / count(*), 6) AS \"yield\""
_ID_COLUMNS = _ID.split(", ")


@query("first_pass_units", f"SELECT {_ID} FROM first_u")
def _(spark, sf):
    return units.first_pass_units(fx.cp(spark, sf)).select(*_ID_COLUMNS)


@query("final_units", f"SELECT {_ID} FROM final_u")
def _(spark, sf):
    return units.final_units(fx.cp(spark, sf)).select(*_ID_COLUMNS)


@query(
    "final_units_disposition",
    f"""SELECT {_ID}, CASE WHEN hard_bin = 'A' THEN 'VENDOR_FLAG' ELSE 'ATTEMPT_ORDER' END AS selected_by,
        'disposition 1.0' AS disposition_rule
 FROM cp QUALIFY row_number() OVER (PARTITION BY logical_unit_key ORDER BY (hard_bin = 'A') DESC,
   run_attempt_no DESC, attempt_no DESC, unit_sequence DESC, unit_id DESC) = 1""",
)
def _(spark, sf):
    chosen = units.final_units_disposition(fx.cp(spark, sf), "hard_bin", "A", "disposition 1.0")
    return chosen.select(*_ID_COLUMNS, "selected_by", "disposition_rule")


@query(
    "all_attempts",
    f"""SELECT {_ID}, unit_id IN (SELECT unit_id FROM first_u) AS is_first,
 unit_id IN (SELECT unit_id FROM final_u) AS is_final FROM cp""",
)
def _(spark, sf):
    return units.all_attempts(fx.cp(spark, sf)).select(*_ID_COLUMNS, "is_first", "is_final")


@query(
    "yield_by",
    f"SELECT lot_id, wafer_id, {_COUNTS}, {_YIELD}, 'final' AS basis FROM final_u GROUP BY lot_id, wafer_id",
)
def _(spark, sf):
    return rounded(units.yield_by(fx.outcomes(spark, sf), ["lot_id", "wafer_id"]), 6, "yield")


@query(
    "yield_rollup",
    f"""SELECT product_code, lot_id, wafer_id, {_COUNTS}, grouping(product_code, lot_id, wafer_id) AS level,
 {_YIELD}, 'first' AS basis FROM first_u GROUP BY ROLLUP (product_code, lot_id, wafer_id)""",
)
def _(spark, sf):
    rolled = units.yield_rollup(fx.outcomes(spark, sf), ["product_code", "lot_id", "wafer_id"], "first")
    return rounded(rolled, 6, "yield")


@query(
    "retest_gain",
    """SELECT f.lot_id, count(*) AS total, count(*) FILTER (f.outcome = 'PASS') AS first_pass,
 count(*) FILTER (l.outcome = 'PASS') AS final_pass,
 count(*) FILTER (f.outcome <> 'PASS' AND l.outcome = 'PASS') AS recovered,
 count(*) FILTER (f.outcome = 'PASS' AND l.outcome <> 'PASS') AS lost,
 round(count(*) FILTER (f.outcome = 'PASS') / count(*), 6) AS first_yield,
 round(count(*) FILTER (l.outcome = 'PASS') / count(*), 6) AS final_yield
FROM first_u f JOIN final_u l ON l.logical_unit_key = f.logical_unit_key GROUP BY f.lot_id""",
)
def _(spark, sf):
    return rounded(units.retest_gain(fx.outcomes(spark, sf), ["lot_id"]), 6, "first_yield", "final_yield")


@query(
    "yield_trend",
    f"""WITH t AS (SELECT product_code, CAST(date_trunc('month', tested_at_utc) AS TIMESTAMP) AS period_start, {_COUNTS},
 count(*) FILTER (outcome = 'PASS') / count(*) AS y FROM final_u GROUP BY 1, 2)
SELECT product_code, period_start, total, n_pass, n_fail, unresolved, round(y, 6) AS "yield",
 round(y - lag(y) OVER (PARTITION BY product_code ORDER BY period_start), 6) AS yield_change, 'final' AS basis FROM t""",
)
def _(spark, sf):
    trend = units.yield_trend(fx.outcomes(spark, sf), ["product_code"], "month")
    return rounded(trend, 6, "yield", "yield_change")


@query(
    "result_counts",
    """SELECT lot_id, count(*) FILTER (overall_result = 'PASS') AS pass, count(*) FILTER (overall_result = 'FAIL') AS fail,
 count(*) FILTER (overall_result = 'ABORT') AS abort, count(*) FILTER (overall_result = 'UNKNOWN') AS unknown
FROM ft GROUP BY lot_id""",
)
def _(spark, sf):
    return units.result_counts(fx.ft(spark, sf), ["lot_id"])


@query(
    "bin_summary",
    """SELECT product_code, soft_bin, mapping_status, failure_mode_snapshot, is_pass_snapshot, count(*) AS n_units
FROM outcomes GROUP BY ALL""",
)
def _(spark, sf):
    dice = fx.with_outcome(spark, fx.cp_rows(spark, sf))
    return units.bin_summary(dice, ["product_code"])


@query(
    "wafer_yield_wide",
    "SELECT lot_id, wafer_id, "
    + _COUNTS
    + ", "
    + ", ".join(f"count(*) FILTER (outcome = 'FAIL' AND soft_bin = '{b}') AS fail_bin_{b}" for b in BINS[:9])
    + ", count(*) FILTER (outcome = 'FAIL' AND soft_bin IN ('9', '10')) AS fail_other, "
    + _YIELD
    + " FROM final_u GROUP BY lot_id, wafer_id",
)
def _(spark, sf):
    return rounded(units.wafer_yield_wide(fx.outcomes(spark, sf), BINS[:9]), 6, "yield")


@query(
    "bin_pareto",
    """WITH t AS (SELECT product_code, soft_bin, count(*) AS n FROM final_u WHERE outcome = 'FAIL' GROUP BY 1, 2)
SELECT product_code, soft_bin, n, round(n / sum(n) OVER (PARTITION BY product_code), 6) AS share,
 round(sum(n) OVER (PARTITION BY product_code ORDER BY n DESC, soft_bin ROWS UNBOUNDED PRECEDING)
       / sum(n) OVER (PARTITION BY product_code), 6) AS cum_share,
 row_number() OVER (PARTITION BY product_code ORDER BY n DESC, soft_bin) AS rank FROM t""",
)
def _(spark, sf):
    return rounded(units.bin_pareto(fx.outcomes(spark, sf), ["product_code"]), 6, "share", "cum_share")


@query(
    "fail_item_pareto",
    """WITH t AS (SELECT lot_id, CAST(first_fail AS VARCHAR) AS fail_test_no, count(*) AS n FROM cp_rows
 WHERE first_fail IS NOT NULL GROUP BY 1, 2)
SELECT lot_id, fail_test_no, n, round(n / sum(n) OVER (PARTITION BY lot_id), 6) AS share,
 round(sum(n) OVER (PARTITION BY lot_id ORDER BY n DESC, fail_test_no ROWS UNBOUNDED PRECEDING)
       / sum(n) OVER (PARTITION BY lot_id), 6) AS cum_share,
 row_number() OVER (PARTITION BY lot_id ORDER BY n DESC, fail_test_no) AS rank FROM t""",
)
def _(spark, sf):
    dice = fx.cp_rows(spark, sf).withColumn("fail_test_no", F.col("first_fail").cast("string"))
    return rounded(units.fail_item_pareto(dice, ["lot_id"]), 6, "share", "cum_share")


@query(
    "bin_cooccurrence",
    """WITH t AS (SELECT product_code, x_coord, y_coord, soft_bin, count(*) AS n FROM final_u GROUP BY ALL)
SELECT a.product_code, a.soft_bin AS bin_a, b.soft_bin AS bin_b, count(*) AS n_positions,
 CAST(sum(a.n * b.n) AS BIGINT) AS n_pairs
FROM t a JOIN t b ON a.product_code = b.product_code AND a.x_coord = b.x_coord AND a.y_coord = b.y_coord
 AND CAST(a.soft_bin AS INT) < CAST(b.soft_bin AS INT) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return units.bin_cooccurrence(units.final_units(fx.cp(spark, sf)), BINS)


@query(
    "compare_groups",
    f"""SELECT tester_id, site_no, count(*) AS total, count(*) FILTER (overall_result = 'PASS') AS n_pass,
 count(*) FILTER (overall_result = 'FAIL') AS n_fail, count(*) FILTER (overall_result NOT IN ('PASS', 'FAIL')) AS unresolved,
 {r4('avg(value_numeric)')} AS mean_value, {r4('stddev_samp(value_numeric)')} AS std_value,
 round(count(*) FILTER (overall_result = 'PASS') / count(*), 6) AS "yield" FROM ft GROUP BY tester_id, site_no""",
)
def _(spark, sf):
    compared = units.compare_groups(units.result_outcome(fx.ft(spark, sf)), ["tester_id", "site_no"])
    return rounded(steady(compared, "mean_value", "std_value"), 6, "yield")


_VALUE = "value_numeric) FILTER (measurement_status = 'MEASURED' AND parameter_code ="


_MEANS = ", ".join(
    f"round(avg({_VALUE} '{p}') + 1e-7, 4) AS mean_{p.lower()}, round(stddev_samp({_VALUE} '{p}') + 1e-7, 4) AS std_{p.lower()}"
    for p in ("VTH", "BVDSS", "IDSS", "RDSON")
)


@query(
    "wafer_summary",
    f"""WITH b AS (SELECT lot_id, wafer_id, count(*) AS total, count(*) FILTER (outcome = 'PASS') AS n_pass,
 count(*) FILTER (outcome = 'FAIL') AS n_fail, {_YIELD} FROM final_u GROUP BY 1, 2),
w AS (SELECT lot_id, wafer_id, soft_bin AS top_fail_bin FROM (SELECT lot_id, wafer_id, soft_bin, count(*) AS n FROM final_u
 WHERE outcome = 'FAIL' GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY lot_id, wafer_id ORDER BY n DESC, soft_bin) = 1),
v AS (SELECT u.lot_id, u.wafer_id, {_MEANS} FROM meas JOIN final_u u ON u.unit_id = meas.unit_id GROUP BY 1, 2)
SELECT b.*, w.top_fail_bin, v.* EXCLUDE (lot_id, wafer_id), 'final' AS basis FROM b
LEFT JOIN w ON w.lot_id = b.lot_id AND w.wafer_id = b.wafer_id LEFT JOIN v ON v.lot_id = b.lot_id AND v.wafer_id = b.wafer_id""",
)
def _(spark, sf):
    params = ["VTH", "BVDSS", "IDSS", "RDSON"]
    summary = units.wafer_summary(fx.outcomes(spark, sf), fx.meas(spark, sf), params)
    return rounded(steady(summary, *[f"{f}_{p.lower()}" for p in params for f in ("mean", "std")]), 6, "yield")


@query(
    "not_tested_matrix",
    "SELECT parameter_code, lot_id, count(*) AS n_total, "
    + ", ".join(
        f"round(count(*) FILTER (measurement_status = '{s}') / count(*), 6) AS {s.lower()}"
        for s in units._STATUSES
    )
    + " FROM meas GROUP BY parameter_code, lot_id",
)
def _(spark, sf):
    matrix = units.not_tested_matrix(fx.meas(spark, sf), ["parameter_code", "lot_id"])
    return rounded(matrix, 6, *[s.lower() for s in units._STATUSES])


@query(
    "out_of_spec_rate",
    """SELECT parameter_code, lot_id, count(*) FILTER (evaluation_result IN ('PASS', 'FAIL')) AS n_judged,
 count(*) FILTER (evaluation_result = 'FAIL') AS n_fail,
 count(*) FILTER (evaluation_result NOT IN ('PASS', 'FAIL')) AS n_not_judged,
 round(count(*) FILTER (evaluation_result = 'FAIL') / nullif(count(*) FILTER (evaluation_result IN ('PASS', 'FAIL')), 0), 6) AS fail_rate
FROM evals GROUP BY parameter_code, lot_id""",
)
def _(spark, sf):
    return rounded(units.out_of_spec_rate(fx.evals(spark, sf), ["parameter_code", "lot_id"]), 6, "fail_rate")
