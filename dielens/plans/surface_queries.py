"""The query surface, row access and traceability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dielens.functions.columns import rounded
from dielens.operators import access, query as surface, trace, units
from dielens.plans import dq_queries, fixtures as fx, stat_queries
from dielens.plans.inline import inline
from dielens.plans.registry import query

CP_FILTER = {
    "lot": ["L3", "L1", "L3"],
    "wafer": [],
    "bin": ["2", "10", "9"],
    "site": [0, 1, 3],
    "result": ["PASS"],
    "time": ["1994-01-01 00:00:00", "1997-01-01 00:00:00"],
}
_CP_WHERE = """lot_id IN ('L1', 'L3') AND soft_bin IN ('2', '9', '10') AND site_no IN (0, 1, 3) AND first_fail IS NULL
 AND tested_at_utc >= TIMESTAMP '1994-01-01' AND tested_at_utc < TIMESTAMP '1997-01-01'"""


@query("apply_global_filter", f"SELECT unit_id, lot_id, soft_bin, site_no, tested_at_utc FROM cp_rows WHERE {_CP_WHERE}")
def _(spark, sf):
    kept = surface.apply_global_filter(fx.cp_rows(spark, sf), CP_FILTER)
    return kept.select("unit_id", "lot_id", "soft_bin", "site_no", "tested_at_utc")


@query(
    "apply_global_filter_ft",
    """SELECT unit_id, lot_id, tester_id, overall_result FROM ft WHERE product_code IN ('P1', 'P2') AND tester_id IN ('T0', 'T3')
 AND overall_result IN ('FAIL', 'PASS') AND source_started_local < TIMESTAMP '2024-01-20'""",
)
def _(spark, sf):
    asked = {
        "product": ["P1", "P2"],
        "tester": ["T0", "T3"],
        "result": ["FAIL", "PASS"],
        "time": [None, "2024-01-20 00:00:00"],
    }
    kept = surface.apply_global_filter(fx.ft(spark, sf), asked, "source_started_local")
    return kept.select("unit_id", "lot_id", "tester_id", "overall_result")



@query(
    "filter_summary",
    f"""SELECT count(*) AS n_rows, count(DISTINCT unit_id) AS n_units, count(DISTINCT lot_id) AS n_lots, 'DV1' AS dataset_version_id,
 '{{"bin":["10","2","9"],"lot":["L1","L3"],"result":["PASS"],"site":["0","1","3"],"time":["1994-01-01 00:00:00","1997-01-01 00:00:00"]}}' AS filter_json,
 sha256('{{"bin":["10","2","9"],"lot":["L1","L3"],"result":["PASS"],"site":["0","1","3"],"time":["1994-01-01 00:00:00","1997-01-01 00:00:00"]}}') AS filter_hash
FROM cp_rows WHERE {_CP_WHERE}""",
)
def _(spark, sf):
    return surface.filter_summary(fx.cp_rows(spark, sf), CP_FILTER, "DV1")


@query(
    "facet_values",
    " UNION ALL ".join(
        f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM meas GROUP BY 2"
        for c in ("lot_id", "wafer_id", "parameter_code", "measurement_status")
    ),
)
def _(spark, sf):
    return surface.facet_values(fx.meas(spark, sf), ["lot_id", "wafer_id", "parameter_code", "measurement_status"])


@query(
    "page",
    """SELECT unit_id, lot_id, soft_bin, tested_at_utc, 3 AS page, 500 AS page_size, (SELECT count(*) FROM cp_rows) AS total
FROM cp_rows ORDER BY cp_rows.tested_at_utc DESC, soft_bin, unit_id OFFSET 1000 LIMIT 500""",
)
def _(spark, sf):
    rows = fx.cp_rows(spark, sf).select("unit_id", "lot_id", "soft_bin", "tested_at_utc")
    return surface.page(rows, ["-tested_at_utc", "soft_bin"], 3, 500)


@query(
    "page_from_index",
    """SELECT unit_id, lot_id, soft_bin, tested_at_utc, 100 AS page, 500 AS page_size, (SELECT count(*) FROM cp_rows) AS total
FROM cp_rows ORDER BY cp_rows.tested_at_utc DESC, soft_bin, unit_id OFFSET 49500 LIMIT 500""",
)
def _(spark, sf):
    rows = fx.cp_rows(spark, sf).select("unit_id", "lot_id", "soft_bin", "tested_at_utc")
    return surface.PageIndex(rows, ["-tested_at_utc", "soft_bin"], ranges=32).page(100, 500)


@query(
    "top_k",
    """SELECT lot_id, wafer_id, total, n_pass, round(y, 6) AS "yield" FROM (SELECT lot_id, wafer_id, count(*) AS total,
 count(*) FILTER (outcome = 'PASS') AS n_pass, count(*) FILTER (outcome = 'PASS') / count(*) AS y FROM final_u GROUP BY 1, 2)
ORDER BY y, lot_id, wafer_id LIMIT 10""",
)
def _(spark, sf):
    yields = units.yield_by(fx.outcomes(spark, sf), ["lot_id", "wafer_id"])
    worst = surface.top_k(yields, ["yield", "lot_id"], 10, "wafer_id")
    return rounded(worst.select("lot_id", "wafer_id", "total", "n_pass", "yield"), 6, "yield")


@query(
    "grid_schema",
    """SELECT lower(parameter_code) AS key, concat(parameter_code, ' [', unit_raw, ']') AS label, unit_raw AS unit,
 CASE WHEN bool_or(measurement_status = 'MEASURED') THEN 'number' ELSE 'text' END AS type, min(sequence_no) AS sequence_no
FROM meas GROUP BY parameter_code, unit_raw""",
)
def _(spark, sf):
    return surface.grid_schema(fx.meas(spark, sf))


@query(
    "measurement_long_view",
    """SELECT unit_id, sequence_no AS test_no, parameter_code, value_numeric, unit_raw AS unit, measurement_status, lsl_applied,
 usl_applied, evaluation_result FROM evals""",
)
def _(spark, sf):
    return surface.measurement_long_view(fx.evals(spark, sf))


@query(
    "unit_wide_view",
    """SELECT u.unit_id, u.x_coord, u.y_coord, u.soft_bin, CASE WHEN first_fail IS NULL THEN 'PASS' ELSE 'FAIL' END AS overall_result,
 l_quantity AS vth, CASE WHEN first_fail < 3 THEN NULL ELSE l_discount END AS idss FROM cp_rows u""",
)
def _(spark, sf):
    return surface.unit_wide_view(fx.cp_rows(spark, sf), fx.meas(spark, sf), ["VTH", "IDSS"])


@query(
    "unit_detail",
    """SELECT c.logical_unit_key, c.unit_id, c.run_id, c.attempt_no, c.unit_sequence, c.soft_bin, e.parameter_code, e.raw_value, e.value_numeric,
 e.measurement_status, e.evaluation_result, e.source_column_index FROM cp c LEFT JOIN evals e ON e.unit_id = c.unit_id""",
)
def _(spark, sf):
    return surface.unit_detail(fx.cp(spark, sf, as_blocks=True), fx.evals(spark, sf))


@query(
    "drill_to_source",
    """SELECT e.measurement_id, e.evaluation_result, e.spec_binding_id, e.spec_item_id, e.raw_value, e.source_column_index, e.run_id,
 c.processing_run_id, r.receipt_id, r.original_file_name, r.sha256
FROM evals e LEFT JOIN cp_runs c ON c.run_id = e.run_id LEFT JOIN receipts r ON r.receipt_id = c.receipt_id""",
)
def _(spark, sf):
    return surface.drill_to_source(fx.evals(spark, sf), fx.cp_runs(spark, sf), fx.receipts(spark, sf))


@query(
    "overview",
    f"""WITH {stat_queries._CAP},
s AS (SELECT severity FROM {dq_queries._STATED} WHERE resolution_status = 'OPEN')
SELECT 'DV1' AS dataset_version_id, count(*) AS total, count(*) FILTER (outcome = 'PASS') AS n_pass, count(*) FILTER (outcome = 'FAIL') AS n_fail,
 round(count(*) FILTER (outcome = 'PASS') / count(*), 6) AS "yield", (SELECT count(*) FROM s WHERE severity = 'BLOCKER') AS open_blocker,
 (SELECT count(*) FROM s WHERE severity = 'ERROR') AS open_error, (SELECT count(*) FROM s WHERE severity = 'WARNING') AS open_warning,
 (SELECT count(*) FROM cap WHERE cpk < 1.0) AS n_risks FROM final_u""",
)
def _(spark, sf):
    risks = stat_queries.capabilities(spark, sf).where("cpk < 1.0")
    seen = surface.overview(fx.final(spark, sf), dq_queries.all_issues(spark, sf), risks, "DV1")
    return rounded(seen, 6, "yield")


@query(
    "capacity_report",
    """WITH m AS (SELECT test_stage, CAST(date_trunc('month', tested_at_utc) AS TIMESTAMP) AS month, count(*) AS measurement_rows FROM meas GROUP BY 1, 2),
d AS (SELECT CAST(date_trunc('month', started_at_utc) AS TIMESTAMP) AS month, count(*) AS n_runs,
 round(quantile_cont(epoch(finished_at_utc - started_at_utc) / 60, 0.95) + 1e-7, 4) AS p95_minutes FROM cp_runs GROUP BY 1)
SELECT m.test_stage, m.month, measurement_rows, measurement_rows - lag(measurement_rows) OVER (ORDER BY m.month) AS growth,
 CAST(sum(measurement_rows) OVER (ORDER BY m.month) AS BIGINT) AS total_rows, n_runs, p95_minutes FROM m LEFT JOIN d ON d.month = m.month""",
)
def _(spark, sf):
    runs = fx.cp_runs(spark, sf).withColumn("test_stage", F.lit("CP"))
    report = surface.capacity_report(fx.meas(spark, sf), runs)
    return report.withColumn("p95_minutes", F.round(F.col("p95_minutes") + 1e-7, 4))


USERS = ["admin", "cp1", "q1", "mgr", "off"]
NOW = "2024-02-01 00:00:00"


def allowed(spark, sf, mode):
    iam = {
        "users": inline(spark, "app_users"),
        "user_roles": inline(spark, "user_roles"),
        "role_permissions": inline(spark, "role_permissions"),
        "grants": inline(spark, "grants"),
    }
    datasets = fx.archive_datasets(spark, sf)
    each = [
        access.authorized_datasets(u, mode, iam, datasets, NOW).withColumn("user_code", F.lit(u)) for u in USERS
    ]
    return reduce(DataFrame.unionByName, each)


def _allowed_sql(mode, permission):
    return f"""(SELECT DISTINCT u.user_code, d.dataset_id FROM app_users u JOIN user_roles r ON r.user_id = u.user_id AND r.active
 JOIN role_permissions p ON p.role_code = r.role_code AND p.permission_code = '{permission}'
 JOIN grants g ON (g.user_id = u.user_id OR g.role_code = r.role_code) AND g.permission_mode = '{mode}'
  AND (g.expires_at_utc IS NULL OR g.expires_at_utc > TIMESTAMP '{NOW}')
 JOIN archive_ds d ON CASE g.scope_type WHEN 'GLOBAL' THEN true WHEN 'PROJECT' THEN d.project_code = g.scope_key
  WHEN 'PRODUCT' THEN d.product_code = g.scope_key WHEN 'SUPPLIER' THEN CAST(d.supplier_id AS VARCHAR) = g.scope_key
  WHEN 'OWNER' THEN CAST(d.owner_user_id AS VARCHAR) = g.scope_key ELSE d.department = g.scope_key END
 WHERE u.status = 'ACTIVE')"""


@query("authorized_datasets", f"SELECT * FROM {_allowed_sql('READ', 'DATASET_READ')}")
def _(spark, sf):
    return allowed(spark, sf, "READ")


@query("authorized_datasets_export", f"SELECT * FROM {_allowed_sql('EXPORT', 'EXPORT_DATA')}")
def _(spark, sf):
    return allowed(spark, sf, "EXPORT")


@query(
    "denied_access_report",
    f"""WITH q AS (SELECT o_orderkey AS request_id, ['admin', 'cp1', 'q1', 'mgr', 'off'][1 + o_orderkey % 5] AS user_code, o_custkey AS dataset_id FROM orders)
SELECT q.* FROM q WHERE NOT EXISTS (SELECT 1 FROM {_allowed_sql('READ', 'DATASET_READ')} a WHERE a.user_code = q.user_code
 AND a.dataset_id = q.dataset_id)""",
)
def _(spark, sf):
    who = F.element_at(F.array(*[F.lit(u) for u in USERS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    requests = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), who.alias("user_code"), F.col("o_custkey").alias("dataset_id")
    )
    return access.denied_access_report(requests, allowed(spark, sf, "READ"))


_TRACED = """(SELECT a.source_unit_id AS cp_unit_id, a.target_unit_id AS assembly_id, b.target_unit_id AS ft_unit_id,
 CASE WHEN c.first_fail IS NULL THEN 'PASS' ELSE 'FAIL' END AS cp_result, f.overall_result AS ft_result, c.lot_id, c.wafer_id,
 least(a.confidence, b.confidence) AS confidence
FROM edges a JOIN edges b ON b.source_unit_id = a.target_unit_id AND b.trace_type = 'ASSEMBLY_FT'
JOIN cp_rows c ON c.unit_id = a.source_unit_id JOIN ft f ON f.unit_id = b.target_unit_id
WHERE a.trace_type = 'CP_ASSEMBLY' AND a.confidence >= 0.95)"""


def traced(spark, sf):
    return trace.trace_direct(fx.edges(spark, sf), fx.cp_rows(spark, sf), fx.ft(spark, sf), 0.95)


@query("trace_direct", f"SELECT * FROM {_TRACED}")
def _(spark, sf):
    return traced(spark, sf)


@query(
    "trace_lineage",
    """WITH RECURSIVE t AS (SELECT unit_id AS start_unit_id, unit_id AS node_id, 1.0::DOUBLE AS confidence, 0 AS depth FROM cp_rows
UNION ALL SELECT t.start_unit_id, e.target_unit_id, t.confidence * e.confidence, t.depth + 1 FROM t JOIN edges e ON e.source_unit_id = t.node_id
 WHERE t.depth < 10)
SELECT start_unit_id, node_id, round(max(confidence), 6) AS confidence, depth FROM t WHERE depth > 0 GROUP BY 1, 2, 4""",
)
def _(spark, sf):
    reached = trace.trace_lineage(fx.edges(spark, sf), fx.cp_rows(spark, sf).select("unit_id"))
    return rounded(reached, 6, "confidence")


@query(
    "trace_ancestors",
    """WITH RECURSIVE t AS (SELECT CAST(event_id AS VARCHAR) AS start_unit_id, CAST(event_id AS VARCHAR) AS node_id, 1.0::DOUBLE AS confidence, 0 AS depth FROM events
UNION ALL SELECT t.start_unit_id, e.source_unit_id, t.confidence * e.confidence, t.depth + 1 FROM t JOIN edges e ON e.target_unit_id = t.node_id
 WHERE t.depth < 10)
SELECT start_unit_id, node_id, round(max(confidence), 6) AS confidence, depth FROM t WHERE depth > 0 GROUP BY 1, 2, 4""",
)
def _(spark, sf):
    reached = trace.trace_lineage(fx.edges(spark, sf), fx.ft(spark, sf).select("unit_id"), "ancestors")
    return rounded(reached, 6, "confidence")


@query(
    "cp_ft_yield_correlation",
    f"""WITH g AS (SELECT lot_id, wafer_id, count(*) AS n_traced, count(*) FILTER (cp_result = 'PASS') / count(*) AS cp,
 count(*) FILTER (ft_result = 'PASS') / count(*) AS ft_y FROM {_TRACED} GROUP BY 1, 2)
SELECT lot_id, wafer_id, n_traced, round(cp, 6) AS cp_yield, round(ft_y, 6) AS ft_yield, (SELECT round(corr(cp, ft_y), 6) FROM g) AS correlation FROM g""",
)
def _(spark, sf):
    figures = trace.cp_ft_yield_correlation(traced(spark, sf), ["lot_id", "wafer_id"])
    return rounded(figures, 6, "cp_yield", "ft_yield", "correlation")
