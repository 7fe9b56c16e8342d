"""The derivations of the test inputs as SQL, shared by the oracle queries."""

from __future__ import annotations

import re

from dielens.plans.inline import TABLES

CP_ROWS = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS unit_id,
       'CP' AS test_stage,
       concat('L', l_suppkey % 10) AS lot_id, concat('W', l_linenumber) AS wafer_id,
       concat('P', (l_suppkey % 10) % 4) AS product_code, l_suppkey % 10 AS supplier_id,
       CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS run_attempt_no,
       concat('L', l_suppkey % 10, '/W', l_linenumber, '/', CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END) AS run_id,
       CAST(l_partkey % 40 AS INT) AS x_coord, CAST(floor(l_partkey / 40.0) AS BIGINT) % 50 AS y_coord,
       concat('CP|P', (l_suppkey % 10) % 4, '|L', l_suppkey % 10, '|W', l_linenumber, '|', l_partkey % 40, '|',
              CAST(floor(l_partkey / 40.0) AS BIGINT) % 50) AS logical_unit_key,
       CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) AS soft_bin, l_returnflag AS hard_bin,
       l_shipdate AS tested_at_utc, CAST(l_orderkey % 4 AS INT) AS site_no,
       CASE WHEN l_quantity <= 3 THEN 1 WHEN l_extendedprice > 100000 THEN 2 WHEN l_discount > 0.09 THEN 3
            WHEN l_tax > 0.07 THEN 4 END AS first_fail,
       l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem"""

CP = """
SELECT *, CASE WHEN first_fail IS NULL THEN 'PASS' ELSE 'FAIL' END AS overall_result,
       row_number() OVER (PARTITION BY lot_id, wafer_id, run_attempt_no, x_coord, y_coord
           ORDER BY tested_at_utc, l_orderkey, l_partkey, l_suppkey, l_extendedprice) - 1 AS attempt_no,
       row_number() OVER (PARTITION BY lot_id, wafer_id, run_attempt_no
           ORDER BY tested_at_utc, l_orderkey, l_partkey, l_suppkey, l_extendedprice) AS unit_sequence
FROM cp_rows"""

MEAS = """
SELECT concat(c.unit_id, '/', i.test_item_id) AS measurement_id, c.unit_id, c.run_id, c.lot_id, c.wafer_id, c.product_code,
       c.supplier_id, c.test_stage, c.tested_at_utc, c.x_coord, c.y_coord, c.site_no, c.run_attempt_no, c.logical_unit_key,
       i.test_item_id, i.sequence_no, i.parameter_code, i.unit_raw,
       CASE WHEN c.first_fail < i.sequence_no THEN '' WHEN i.test_item_id = 2 AND c.l_extendedprice > 100000 THEN 'OVER'
            ELSE CAST(CASE i.test_item_id WHEN 1 THEN l_quantity WHEN 2 THEN l_extendedprice WHEN 3 THEN l_discount
                      ELSE l_tax END AS VARCHAR) END AS raw_value,
       CASE WHEN c.first_fail < i.sequence_no THEN NULL WHEN i.test_item_id = 2 AND c.l_extendedprice > 100000 THEN NULL
            ELSE CASE i.test_item_id WHEN 1 THEN l_quantity WHEN 2 THEN l_extendedprice WHEN 3 THEN l_discount
                      ELSE l_tax END END AS value_numeric,
       CASE WHEN c.first_fail < i.sequence_no THEN 'NOT_TESTED'
            WHEN i.test_item_id = 2 AND c.l_extendedprice > 100000 THEN 'OVER_RANGE' ELSE 'MEASURED' END AS measurement_status,
       CASE WHEN c.first_fail < i.sequence_no THEN NULL WHEN c.first_fail = i.sequence_no THEN false ELSE true END AS tester_pass_flag,
       CAST(i.sequence_no + 7 AS INT) AS source_column_index
FROM cp_rows c CROSS JOIN items i"""

FT = """
SELECT CAST(event_id AS VARCHAR) AS unit_id, 'FT' AS test_stage, concat('FT', user_id % 20) AS lot_id,
       concat('P', user_id % 4) AS product_code, user_id % 10 AS supplier_id,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS serial_no,
       concat('T', event_id % 4) AS tester_id, concat('FT', user_id % 20, '/T', event_id % 4) AS run_id,
       CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'view' THEN 'ABORT' WHEN 'signup' THEN 'UNKNOWN' ELSE 'PASS' END AS overall_result,
       'IGSS' AS parameter_code, value AS value_numeric, 'MEASURED' AS measurement_status, props AS condition_json,
       ts AS source_started_local, event_id AS unit_sequence, event_id,
       CASE WHEN user_id % 4 = 0 THEN 'Asia/Shanghai' END AS explicit_zone,
       CASE WHEN user_id % 4 = 1 THEN 'Asia/Tokyo' END AS supplier_zone,
       CASE WHEN user_id % 4 = 2 THEN 'UTC' END AS file_zone,
       CAST(user_id % 7 AS INT) AS site_no
FROM events"""

RECEIPTS = """
SELECT doc_id AS receipt_id, source AS import_batch_id, CASE WHEN doc_id % 333 = 0 THEN 'PX' ELSE 'P1' END AS product_code,
       CASE WHEN doc_id % 250 = 7 THEN 'MILLI' ELSE 'SI' END AS unit_contract, concat(source, '/', doc_id, '.txt') AS original_file_name,
       text AS content, sha256(text) AS sha256, n_chars AS file_size,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS received_at_utc,
       CASE doc_id % 5 WHEN 0 THEN 'DETAIL' WHEN 1 THEN 'DETAIL' WHEN 2 THEN 'SPEC' WHEN 3 THEN 'YIELD' ELSE 'MANIFEST' END AS file_role,
       CAST(floor(doc_id / 20.0) AS INT) % 40 AS ordinal_no,
       doc_id % 50 = 0 AS forced, CASE WHEN doc_id % 50 <> 0 THEN NULL WHEN doc_id % 100 = 0 THEN '' ELSE 'recheck' END AS reason
FROM documents"""

BIN_CTX = "SELECT DISTINCT supplier_id, product_code, tested_at_utc FROM cp_rows"

BIN_CAND = """
SELECT c.supplier_id, c.product_code, c.tested_at_utc, s.bin_mapping_set_id,
       rank() OVER (PARTITION BY c.supplier_id, c.product_code, c.tested_at_utc ORDER BY p.priority DESC) AS rk
FROM bin_ctx c JOIN bin_sets s ON s.active
 AND (s.supplier_id IS NULL OR s.supplier_id = c.supplier_id) AND (s.product_code IS NULL OR s.product_code = c.product_code)
 AND (s.test_stage IS NULL OR s.test_stage = 'CP') AND s.program_version_id IS NULL
 AND (s.effective_from_utc IS NULL OR s.effective_from_utc <= c.tested_at_utc)
 AND (s.effective_to_utc IS NULL OR s.effective_to_utc > c.tested_at_utc)
JOIN scopes p ON p.scope_code = s.scope_code AND p.active"""

BIN_RES = """
SELECT c.supplier_id, c.product_code, c.tested_at_utc, count(d.bin_mapping_set_id) AS n_candidates,
       CASE count(d.bin_mapping_set_id) WHEN 0 THEN 'NO_MATCH' WHEN 1 THEN 'MATCHED' ELSE 'CONFIG_AMBIGUOUS' END AS set_status,
       CASE WHEN count(d.bin_mapping_set_id) = 1 THEN min(d.bin_mapping_set_id) END AS bin_mapping_set_id
FROM bin_ctx c LEFT JOIN bin_cand d ON d.supplier_id = c.supplier_id AND d.product_code = c.product_code
 AND d.tested_at_utc = c.tested_at_utc AND d.rk = 1
GROUP BY c.supplier_id, c.product_code, c.tested_at_utc"""

OUTCOMES = """
SELECT u.*, r.bin_mapping_set_id, d.bin_definition_id, d.failure_mode AS failure_mode_snapshot, d.is_pass AS is_pass_snapshot,
       CASE WHEN r.set_status <> 'MATCHED' THEN r.set_status WHEN d.bin_definition_id IS NULL THEN 'NO_MATCH'
            ELSE 'MATCHED' END AS mapping_status,
       CASE WHEN d.is_pass THEN 'PASS' WHEN d.is_pass = false THEN 'FAIL' ELSE 'UNRESOLVED' END AS outcome
FROM cp u JOIN bin_res r ON r.supplier_id = u.supplier_id AND r.product_code = u.product_code AND r.tested_at_utc = u.tested_at_utc
LEFT JOIN bin_defs d ON d.bin_mapping_set_id = r.bin_mapping_set_id AND d.bin_type = 'CP_BIN' AND d.bin_code = u.soft_bin"""

FINAL_U = """
SELECT * FROM outcomes QUALIFY row_number() OVER (PARTITION BY logical_unit_key
    ORDER BY run_attempt_no DESC, attempt_no DESC, unit_sequence DESC, unit_id DESC) = 1"""

FIRST_U = """
SELECT * FROM outcomes QUALIFY row_number() OVER (PARTITION BY logical_unit_key
    ORDER BY run_attempt_no, attempt_no, unit_sequence, unit_id) = 1"""

SPEC_CTX = "SELECT DISTINCT supplier_id, product_code, lot_id, tested_at_utc FROM cp_rows"

SPEC_CAND = """
SELECT c.supplier_id, c.product_code, c.lot_id, c.tested_at_utc, b.spec_binding_id, b.spec_set_id,
       rank() OVER (PARTITION BY c.supplier_id, c.product_code, c.lot_id, c.tested_at_utc ORDER BY p.priority DESC) AS rk
FROM spec_ctx c JOIN bindings b ON b.active
 AND (b.supplier_id IS NULL OR b.supplier_id = c.supplier_id) AND (b.product_code IS NULL OR b.product_code = c.product_code)
 AND (b.test_stage IS NULL OR b.test_stage = 'CP') AND b.program_version_id IS NULL AND b.customer_code IS NULL
 AND b.quality_grade IS NULL AND b.package_code IS NULL
 AND (b.effective_from_utc IS NULL OR b.effective_from_utc <= c.tested_at_utc)
 AND (b.effective_to_utc IS NULL OR b.effective_to_utc > c.tested_at_utc)
JOIN spec_sets s ON s.spec_set_id = b.spec_set_id AND s.status = 'RELEASED'
JOIN scopes p ON p.scope_code = b.scope_code AND p.active"""

SPEC_RES = """
SELECT c.supplier_id, c.product_code, c.lot_id, c.tested_at_utc, count(d.spec_binding_id) AS n_candidates,
       CASE count(d.spec_binding_id) WHEN 0 THEN 'NO_MATCH' WHEN 1 THEN 'MATCHED' ELSE 'CONFIG_AMBIGUOUS' END AS binding_status,
       CASE WHEN count(d.spec_binding_id) = 1 THEN min(d.spec_binding_id) END AS spec_binding_id,
       CASE WHEN count(d.spec_binding_id) = 1 THEN min(d.spec_set_id) END AS spec_set_id
FROM spec_ctx c LEFT JOIN spec_cand d ON d.supplier_id = c.supplier_id AND d.product_code = c.product_code
 AND d.lot_id = c.lot_id AND d.tested_at_utc = c.tested_at_utc AND d.rk = 1
GROUP BY c.supplier_id, c.product_code, c.lot_id, c.tested_at_utc"""

SPEC_LIM = """
SELECT r.supplier_id, r.product_code, r.lot_id, r.tested_at_utc, r.n_candidates, r.binding_status, r.spec_binding_id,
       i.test_item_id, i.unit_raw, i.program_lsl, i.program_usl, coalesce(a.spec_item_id, b.spec_item_id) AS spec_item_id,
       CASE WHEN a.spec_item_id IS NOT NULL THEN a.lsl ELSE b.lsl END AS lsl,
       CASE WHEN a.spec_item_id IS NOT NULL THEN a.usl ELSE b.usl END AS usl,
       CASE WHEN a.spec_item_id IS NOT NULL THEN a.lower_operator ELSE b.lower_operator END AS lower_operator,
       CASE WHEN a.spec_item_id IS NOT NULL THEN a.upper_operator ELSE b.upper_operator END AS upper_operator,
       CASE WHEN a.spec_item_id IS NOT NULL THEN a.unit_code ELSE b.unit_code END AS limit_unit
FROM spec_res r CROSS JOIN items i
LEFT JOIN spec_items a ON a.spec_set_id = r.spec_set_id AND a.test_item_id = i.test_item_id
LEFT JOIN spec_items b ON b.spec_set_id = r.spec_set_id AND b.test_item_id IS NULL AND b.parameter_code = i.parameter_code"""

def moved(value: str, places: str) -> str:
    """A decimal number with its point moved, as text and back."""
    text = f"CAST({value} AS VARCHAR)"
    own = f"CASE WHEN contains({text}, 'e') THEN CAST(split_part({text}, 'e', 2) AS INT) ELSE 0 END"
    return f"CAST(split_part({text}, 'e', 1) || 'e' || ({own} + {places}) AS DOUBLE)"


_PLACES = "CAST(round(log10(f.factor)) - round(log10(g.factor)) AS INT)"

SPEC_APPLIED = f"""
SELECT l.*, CASE WHEN spec_item_id IS NOT NULL THEN 'SPEC'
                 WHEN binding_status <> 'CONFIG_AMBIGUOUS' AND (program_lsl IS NOT NULL OR program_usl IS NOT NULL)
                 THEN 'PROGRAM' ELSE 'NONE' END AS limit_source,
       CASE WHEN spec_item_id IS NOT NULL THEN {moved('l.lsl', _PLACES)} WHEN binding_status <> 'CONFIG_AMBIGUOUS' THEN program_lsl END AS lsl_applied,
       CASE WHEN spec_item_id IS NOT NULL THEN {moved('l.usl', _PLACES)} WHEN binding_status <> 'CONFIG_AMBIGUOUS' THEN program_usl END AS usl_applied,
       spec_item_id IS NULL OR (f.factor IS NOT NULL AND f.unit_code = g.unit_code) AS unit_ok
FROM spec_lim l LEFT JOIN factors f ON f.unit_raw = l.limit_unit LEFT JOIN factors g ON g.unit_raw = l.unit_raw"""

SCOPE_APPLIED = f"""
SELECT s.evaluation_type, s.evaluation_scope_key, s.test_item_id, s.lower_operator_applied, s.upper_operator_applied,
       {moved('s.lsl_applied', _PLACES)} AS lsl_applied, {moved('s.usl_applied', _PLACES)} AS usl_applied,
       f.factor IS NOT NULL AND f.unit_code = g.unit_code AS unit_ok
FROM scope_limits s JOIN items i ON i.test_item_id = s.test_item_id LEFT JOIN factors f ON f.unit_raw = s.unit_code
LEFT JOIN factors g ON g.unit_raw = i.unit_raw"""

EVALS = """
SELECT m.*, a.spec_binding_id, a.spec_item_id, a.n_candidates, a.lower_operator AS lower_operator_applied,
       a.upper_operator AS upper_operator_applied, a.limit_source, a.lsl_applied, a.usl_applied,
       CASE WHEN a.binding_status = 'CONFIG_AMBIGUOUS' THEN 'CONFIG_AMBIGUOUS' WHEN a.limit_source = 'NONE' THEN 'NO_MATCH'
            WHEN m.measurement_status = 'INVALID' THEN 'INVALID_VALUE' WHEN m.measurement_status <> 'MEASURED' THEN 'NOT_EVALUATED'
            WHEN NOT a.unit_ok THEN 'NOT_EVALUATED'
            WHEN a.lsl_applied IS NULL AND a.usl_applied IS NULL THEN 'NOT_EVALUATED'
            WHEN (a.lsl_applied IS NULL OR CASE WHEN a.lower_operator = '>' THEN m.value_numeric > a.lsl_applied
                  ELSE m.value_numeric >= a.lsl_applied END)
             AND (a.usl_applied IS NULL OR CASE WHEN a.upper_operator = '<' THEN m.value_numeric < a.usl_applied
                  ELSE m.value_numeric <= a.usl_applied END) THEN 'PASS' ELSE 'FAIL' END AS evaluation_result,
       CASE WHEN a.binding_status = 'CONFIG_AMBIGUOUS' THEN CAST(a.n_candidates AS VARCHAR)
            WHEN a.limit_source = 'NONE' THEN CASE WHEN a.binding_status = 'NO_MATCH' THEN 'NO_BINDING' ELSE 'NO_ITEM' END
            WHEN m.measurement_status = 'INVALID' THEN m.raw_value WHEN m.measurement_status <> 'MEASURED' THEN m.measurement_status
            WHEN NOT a.unit_ok THEN 'UNIT' WHEN a.lsl_applied IS NULL AND a.usl_applied IS NULL THEN 'NO_LIMIT'
            WHEN NOT (a.lsl_applied IS NULL OR CASE WHEN a.lower_operator = '>' THEN m.value_numeric > a.lsl_applied
                  ELSE m.value_numeric >= a.lsl_applied END) THEN 'LOW'
            WHEN NOT (a.usl_applied IS NULL OR CASE WHEN a.upper_operator = '<' THEN m.value_numeric < a.usl_applied
                  ELSE m.value_numeric <= a.usl_applied END) THEN 'HIGH'
            WHEN a.limit_source = 'PROGRAM' THEN 'PROGRAM_LIMIT_FALLBACK' ELSE 'SPEC' END AS evaluation_reason
FROM meas m JOIN spec_applied a ON a.supplier_id = m.supplier_id AND a.product_code = m.product_code AND a.lot_id = m.lot_id
 AND a.tested_at_utc = m.tested_at_utc AND a.test_item_id = m.test_item_id"""

CP_RUNS = """
SELECT run_id AS processing_run_id, run_id, lot_id, wafer_id, product_code, supplier_id, run_attempt_no,
       supplier_id * 14 + (CAST(substr(wafer_id, 2) AS BIGINT) - 1) * 2 + run_attempt_no AS receipt_id,
       min(tested_at_utc) AS started_at_utc, max(tested_at_utc) AS finished_at_utc FROM cp_rows GROUP BY run_id, lot_id, wafer_id, product_code, supplier_id, run_attempt_no"""

DVR = """
SELECT v.dataset_version_id, r.processing_run_id FROM dv v JOIN ds d ON d.dataset_id = v.dataset_id
JOIN cp_runs r ON r.product_code = d.product_code AND (v.version_no > 1 OR r.run_attempt_no = 0)"""

ARCHIVE_DS = """
SELECT c_custkey AS dataset_id, concat('DS', c_custkey) AS dataset_code, c_name AS dataset_name,
       CASE c_custkey % 4 WHEN 0 THEN 'CP_DETAIL' WHEN 1 THEN 'FT_DETAIL' WHEN 2 THEN 'WAFER_SUMMARY' ELSE 'YIELD_REPORT' END AS dataset_type,
       CASE WHEN c_custkey % 2 = 0 THEN 'CP' ELSE 'FT' END AS test_stage, CAST(c_nationkey % 10 AS BIGINT) AS supplier_id,
       concat('P', c_custkey % 4) AS product_code, concat('PJ', c_nationkey % 5) AS project_code,
       c_custkey % 7 AS owner_user_id, c_mktsegment AS department FROM customer"""

ARCHIVE_DV = """
SELECT o_orderkey AS dataset_version_id, o_custkey AS dataset_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version_no,
       CASE WHEN o_orderstatus = 'P' THEN 'DRAFT' WHEN o_orderkey = last_key THEN 'PUBLISHED' ELSE 'SUPERSEDED' END AS status,
       coalesce(o_orderstatus <> 'P' AND o_orderkey = last_key, false) AS is_current,
       CAST(floor(o_totalprice) AS BIGINT) AS row_count, CAST(floor(o_totalprice / 4) AS BIGINT) AS unit_count,
       CAST(floor(o_totalprice / 4) AS BIGINT) * 4 AS measurement_count, o_custkey % 7 AS published_by,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS published_at_utc
FROM orders LEFT JOIN (SELECT o_custkey AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders
     WHERE o_orderstatus <> 'P' GROUP BY o_custkey) ON k = o_custkey"""

AUDIT = """
SELECT event_id AS audit_id, concat('u', user_id) AS actor,
       CASE event_type WHEN 'error' THEN 'DQ_WAIVE' WHEN 'view' THEN 'EXPORT_DOWNLOAD' WHEN 'signup' THEN 'SPEC_BINDING'
            WHEN 'click' THEN 'BIN_MAPPING' ELSE 'FORCE_REPROCESS' END AS operation,
       CASE event_type WHEN 'error' THEN 'dq_issue' WHEN 'view' THEN 'export_artifact' WHEN 'signup' THEN 'spec_binding'
            WHEN 'click' THEN 'bin_mapping_set' ELSE 'processing_job' END AS entity_type,
       CAST(user_id % 13 AS VARCHAR) AS entity_id,
       CASE WHEN event_type <> 'signup' THEN concat('{"limit":"', CAST(CAST(floor(value) AS INT) % 5 AS VARCHAR), '","state":"OPEN","k":"',
            CAST(json_extract_string(props, '$.k') AS VARCHAR), '"}') END AS before_json,
       concat('{"limit":"', CAST(CAST(floor(value) AS INT) % 3 AS VARCHAR), '","k":"', CAST(json_extract_string(props, '$.k') AS VARCHAR),
              '","owner":"', CAST(user_id % 3 AS VARCHAR), '"}') AS after_json,
       concat('c', event_id % 97) AS correlation_id, ts AS occurred_at_utc FROM events"""

ARTIFACTS = """
SELECT o_orderkey AS export_artifact_id, concat('export-', o_orderkey, '.csv') AS file_name, o_orderdate AS created_at_utc,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL
            ELSE o_orderdate + to_days(CAST(30 * CAST(left(o_orderpriority, 1) AS INT) AS INT)) END AS expires_at_utc FROM orders"""

EDGES = """
SELECT unit_id AS source_unit_id, concat('A-', l_orderkey) AS target_unit_id, 'CP_ASSEMBLY' AS trace_type,
       round(1 - l_discount, 5) AS confidence FROM cp_rows
UNION ALL
SELECT concat('A-', event_id) AS source_unit_id, CAST(event_id AS VARCHAR) AS target_unit_id, 'ASSEMBLY_FT' AS trace_type,
       0.99 AS confidence FROM events"""

VENDOR = """
SELECT unit_id, run_id, lot_id, CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE wafer_id END AS wafer_id, product_code, supplier_id,
       run_attempt_no, 0 AS attempt_no, CASE WHEN l_partkey % 211 = 0 THEN NULL ELSE x_coord END AS x_coord, y_coord,
       CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE soft_bin END AS soft_bin, l_orderkey * 8 + l_linenumber AS source_row_no,
       CASE WHEN supplier_id = 9 THEN 'kV' ELSE 'V' END AS bvdss_unit,
       CASE WHEN l_orderkey % 17 = 0 THEN 'ERR' ELSE CAST(l_quantity AS VARCHAR) END AS vth,
       CASE WHEN first_fail < 2 THEN '' WHEN l_extendedprice > 100000 THEN 'OVER' ELSE CAST(l_extendedprice AS VARCHAR) END AS bvdss,
       CASE WHEN first_fail < 3 THEN '' ELSE CAST(l_discount AS VARCHAR) END AS idss,
       CASE WHEN first_fail < 4 THEN '' ELSE CAST(l_tax AS VARCHAR) END AS rdson,
       first_fail, l_partkey
FROM cp_rows"""

DETECTED = """
SELECT receipt_id, import_batch_id, original_file_name, n_candidates, candidates,
       CASE n_candidates WHEN 1 THEN 'DETECTED' WHEN 0 THEN 'UNKNOWN' ELSE 'NEEDS_CONFIRMATION' END AS detection_status FROM (
SELECT r.receipt_id, r.import_batch_id, r.original_file_name, CAST(count(p.format_code) AS INT) AS n_candidates,
       coalesce(string_agg(p.format_code || ' ' || p.profile_version, ',' ORDER BY p.format_code || ' ' || p.profile_version), '') AS candidates
FROM receipts r LEFT JOIN profiles p ON p.status = 'RELEASED' AND contains(r.content, p.signature)
GROUP BY r.receipt_id, r.import_batch_id, r.original_file_name)"""

VIEWS = {
    "vendor": VENDOR,
    "detected": DETECTED,
    **TABLES,
    "cp_rows": CP_ROWS,
    "cp": CP,
    "meas": MEAS,
    "ft": FT,
    "receipts": RECEIPTS,
    "bin_ctx": BIN_CTX,
    "bin_cand": BIN_CAND,
    "bin_res": BIN_RES,
    "outcomes": OUTCOMES,
    "final_u": FINAL_U,
    "first_u": FIRST_U,
    "spec_ctx": SPEC_CTX,
    "spec_cand": SPEC_CAND,
    "spec_res": SPEC_RES,
    "spec_lim": SPEC_LIM,
    "spec_applied": SPEC_APPLIED,
    "scope_applied": SCOPE_APPLIED,
    "evals": EVALS,
    "cp_runs": CP_RUNS,
    "dvr": DVR,
    "archive_ds": ARCHIVE_DS,
    "archive_dv": ARCHIVE_DV,
    "audit": AUDIT,
    "artifacts": ARTIFACTS,
    "edges": EDGES,
}


def with_views(sql: str) -> str:
    """Prefix a query with the views it names, in dependency order."""
    used: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"(?:FROM|JOIN|,)\s+([a-z_]+)\b", text))
        for name, body in VIEWS.items():
            if name in words and name not in used:
                visit(body)
                used.append(name)

    visit(sql)
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
