"""Small master-data and governance tables, as SQL text both engines read.

These are configuration: they are only ever joined to data derived from the
driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Scope codes and their priorities.
SCOPES = """
SELECT CAST(scope_code AS VARCHAR(64)) AS scope_code, CAST(priority AS INT) AS priority, active FROM (VALUES
('EXPLICIT_OVERRIDE', 600, true),
('CUSTOMER_PRODUCT_PROGRAM', 500, true),
('CUSTOMER_PRODUCT', 450, true),
('PRODUCT_PROGRAM', 400, true),
('PRODUCT_SUPPLIER_STAGE', 350, true),
('PRODUCT_STAGE', 300, true),
('PRODUCT', 200, true),
('GLOBAL', 100, true)) AS t(scope_code, priority, active)"""

ITEMS = """
SELECT CAST(test_item_id AS BIGINT) AS test_item_id, CAST(sequence_no AS INT) AS sequence_no,
       parameter_code, unit_raw, CAST(program_lsl AS DOUBLE) AS program_lsl,
       CAST(program_usl AS DOUBLE) AS program_usl, CAST(NULL AS VARCHAR(8)) AS program_lower_operator,
       CAST(NULL AS VARCHAR(8)) AS program_upper_operator, test_stage FROM (VALUES
(1, 1, 'VTH', 'V', 2.0, 49.0, 'CP'),
(2, 2, 'BVDSS', 'V', NULL, 104000.0, 'CP'),
(3, 3, 'IDSS', 'uA', NULL, 0.10, 'CP'),
(4, 4, 'RDSON', 'mOhm', NULL, 0.08, 'CP'))
AS t(test_item_id, sequence_no, parameter_code, unit_raw, program_lsl, program_usl, test_stage)"""

SPEC_SETS = """
SELECT CAST(spec_set_id AS BIGINT) AS spec_set_id, spec_name, status FROM (VALUES
(1, 'S1', 'RELEASED'), (2, 'S2', 'RELEASED'), (3, 'S3', 'DRAFT')) AS t(spec_set_id, spec_name, status)"""

BINDINGS = """
SELECT CAST(spec_binding_id AS BIGINT) AS spec_binding_id, CAST(spec_set_id AS BIGINT) AS spec_set_id, scope_code,
       CAST(supplier_id AS BIGINT) AS supplier_id, CAST(product_code AS VARCHAR(64)) AS product_code,
       CAST(test_stage AS VARCHAR(16)) AS test_stage, CAST(NULL AS BIGINT) AS program_version_id,
       CAST(NULL AS VARCHAR(64)) AS customer_code, CAST(NULL AS VARCHAR(64)) AS quality_grade,
       CAST(NULL AS VARCHAR(64)) AS package_code, CAST(effective_from AS TIMESTAMP) AS effective_from_utc,
       CAST(effective_to AS TIMESTAMP) AS effective_to_utc, active FROM (VALUES
(1, 1, 'GLOBAL', NULL, NULL, NULL, '1996-01-01 00:00:00', NULL, true),
(2, 2, 'PRODUCT', NULL, 'P1', NULL, NULL, NULL, true),
(3, 3, 'PRODUCT_STAGE', NULL, 'P2', 'CP', NULL, NULL, true),
(4, 2, 'PRODUCT', NULL, 'P2', NULL, NULL, '1998-01-01 00:00:00', true),
(5, 1, 'PRODUCT', NULL, 'P3', NULL, '2000-01-01 00:00:00', NULL, true),
(6, 2, 'PRODUCT', NULL, 'P3', NULL, '2000-01-01 00:00:00', NULL, true),
(7, 1, 'PRODUCT_SUPPLIER_STAGE', 7, 'P3', 'CP', '2000-06-01 00:00:00', NULL, true),
(8, 1, 'EXPLICIT_OVERRIDE', NULL, 'P0', NULL, NULL, NULL, false))
AS t(spec_binding_id, spec_set_id, scope_code, supplier_id, product_code, test_stage, effective_from, effective_to, active)"""

SPEC_ITEMS = """
SELECT CAST(spec_item_id AS BIGINT) AS spec_item_id, CAST(spec_set_id AS BIGINT) AS spec_set_id,
       CAST(test_item_id AS BIGINT) AS test_item_id, parameter_code, CAST(lsl AS DOUBLE) AS lsl,
       CAST(usl AS DOUBLE) AS usl, CAST(lower_operator AS VARCHAR(8)) AS lower_operator,
       CAST(upper_operator AS VARCHAR(8)) AS upper_operator, unit_code FROM (VALUES
(11, 1, NULL, 'VTH', 1.0, 45.0, NULL, NULL, 'V'),
(12, 1, NULL, 'BVDSS', NULL, 100000.0, NULL, '<=', 'V'),
(13, 1, NULL, 'IDSS', NULL, 90.0, NULL, NULL, 'nA'),
(14, 1, NULL, 'RDSON', NULL, 0.07, NULL, '<', 'mOhm'),
(21, 2, NULL, 'VTH', 3.0, 48.0, '>=', '<=', 'V'),
(22, 2, 2, 'BVDSS', 5000.0, 95000.0, NULL, NULL, 'V'),
(23, 2, NULL, 'BVDSS', 0.0, 200000.0, NULL, NULL, 'kV'),
(24, 2, NULL, 'IDSS', NULL, 0.08, NULL, NULL, 'kA'),
(25, 2, NULL, 'RDSON', 0.00003, 0.00007, NULL, NULL, 'Ohm'))
AS t(spec_item_id, spec_set_id, test_item_id, parameter_code, lsl, usl, lower_operator, upper_operator, unit_code)"""

SCOPE_LIMITS = """
SELECT evaluation_type, evaluation_scope_key, CAST(test_item_id AS BIGINT) AS test_item_id, CAST(lsl AS DOUBLE) AS lsl_applied,
       CAST(usl AS DOUBLE) AS usl_applied, CAST(lower_operator AS VARCHAR(8)) AS lower_operator_applied,
       CAST(upper_operator AS VARCHAR(8)) AS upper_operator_applied, unit_code FROM (VALUES
('SPEC', 'DEFAULT', 1, 2000.0, 49000.0, NULL, NULL, 'mV'), ('SPEC', 'DEFAULT', 2, NULL, 104000.0, NULL, NULL, 'V'),
('SPEC', 'DEFAULT', 4, 0.00003, 0.00007, NULL, NULL, 'Ohm'),
('SPEC', 'CUSTOMER_A', 1, 5.0, 45.0, '>', '<', 'V'), ('SPEC', 'CUSTOMER_A', 3, NULL, 80.0, NULL, '==', 'nA'),
('SAFE_LAUNCH', 'SL1', 1, 6.0, 44.0, '>=', '<=', 'V'), ('SAFE_LAUNCH', 'SL1', 2, 1000.0, 90000.0, NULL, NULL, 'V'),
('SAFE_LAUNCH', 'SL1', 3, NULL, 0.09, NULL, NULL, 'V'), ('SAFE_LAUNCH', 'SL1', 4, NULL, NULL, NULL, NULL, 'mOhm'))
AS t(evaluation_type, evaluation_scope_key, test_item_id, lsl, usl, lower_operator, upper_operator, unit_code)"""

BIN_SETS = """
SELECT CAST(bin_mapping_set_id AS BIGINT) AS bin_mapping_set_id, mapping_name, scope_code,
       CAST(NULL AS BIGINT) AS supplier_id, CAST(product_code AS VARCHAR(64)) AS product_code,
       CAST(NULL AS VARCHAR(16)) AS test_stage, CAST(NULL AS BIGINT) AS program_version_id,
       CAST(effective_from AS TIMESTAMP) AS effective_from_utc, CAST(NULL AS TIMESTAMP) AS effective_to_utc, active
FROM (VALUES
(1, 'M1', 'GLOBAL', NULL, NULL, true),
(2, 'M2', 'PRODUCT', 'P1', '1998-01-01 00:00:00', true),
(3, 'M3', 'PRODUCT', 'P3', '2000-01-01 00:00:00', true),
(4, 'M4', 'PRODUCT', 'P3', '2000-01-01 00:00:00', true))
AS t(bin_mapping_set_id, mapping_name, scope_code, product_code, effective_from, active)"""

BIN_DEFS = """
SELECT CAST(bin_mapping_set_id * 100 + CAST(bin_code AS INT) AS BIGINT) AS bin_definition_id,
       CAST(bin_mapping_set_id AS BIGINT) AS bin_mapping_set_id, 'CP_BIN' AS bin_type, bin_code,
       CAST(failure_mode AS VARCHAR(64)) AS failure_mode, is_pass FROM (VALUES
(1, '0', 'OPEN', false), (1, '1', NULL, true), (1, '2', NULL, true), (1, '3', NULL, true), (1, '4', NULL, true),
(1, '5', NULL, true), (1, '6', NULL, true), (1, '7', NULL, true), (1, '8', 'SHORT', false), (1, '9', 'LEAK', false),
(2, '0', 'OPEN', false), (2, '1', 'PARAM', false), (2, '2', NULL, true), (2, '3', NULL, true), (2, '4', NULL, true),
(2, '5', NULL, true), (2, '6', NULL, true), (2, '7', 'PARAM', false), (2, '8', 'SHORT', false),
(2, '9', 'LEAK', false), (2, '10', 'LEAK', false),
(3, '1', NULL, true), (4, '1', NULL, true)) AS t(bin_mapping_set_id, bin_code, failure_mode, is_pass)"""

FACTORS = """
SELECT unit_raw, unit_code, CAST(factor AS DOUBLE) AS factor FROM (VALUES
('V', 'V', 1.0), ('mV', 'V', 0.001), ('uA', 'uA', 1.0), ('nA', 'uA', 0.001),
('mOhm', 'mOhm', 1.0), ('Ohm', 'mOhm', 1000.0)) AS t(unit_raw, unit_code, factor)"""

PROFILES = """
SELECT CAST(format_profile_id AS BIGINT) AS format_profile_id, format_code, profile_version, signature, status FROM (VALUES
(1, 'EN', '1.0', 'the ', 'RELEASED'), (2, 'DE', '1.0', 'und ', 'RELEASED'), (3, 'ES', '1.1', 'que ', 'RELEASED'),
(4, 'FR', '2.0', 'les ', 'RELEASED'), (5, 'ANY', '0.1', '.', 'DRAFT'))
AS t(format_profile_id, format_code, profile_version, signature, status)"""

CONTRACTS = """
SELECT file_role, required, CAST(max_files AS INT) AS max_files FROM (VALUES
('DETAIL', true, NULL), ('SPEC', true, 10), ('PAT', true, 1), ('MANIFEST', false, 1))
AS t(file_role, required, max_files)"""

PRODUCT_ALIASES = """
SELECT alias_type, CAST(supplier_id AS BIGINT) AS supplier_id, alias_value, product_code, active FROM (VALUES
('VENDOR_NAME', 0, 'small ring', 'P0', true), ('VENDOR_NAME', 0, 'red widget', 'P1', true),
('VENDOR_NAME', 1, 'small ring', 'P2', true), ('VENDOR_NAME', 2, 'hot gear', 'P3', true),
('VENDOR_NAME', 2, 'blue bolt', 'P3', false), ('DIE_NAME', 0, 'blue bolt', 'P1', true))
AS t(alias_type, supplier_id, alias_value, product_code, active)"""

PROGRAM_VERSIONS = """
SELECT CAST(program_version_id AS BIGINT) AS program_version_id, program_code, version_code,
       CAST(valid_from AS TIMESTAMP) AS valid_from_utc, CAST(valid_to AS TIMESTAMP) AS valid_to_utc FROM (VALUES
(1, 'PRG0', 'A', NULL, '1997-01-01 00:00:00'), (2, 'PRG0', 'B', '1997-01-01 00:00:00', NULL),
(3, 'PRG1', 'A', '1996-06-01 00:00:00', '2000-01-01 00:00:00'), (4, 'PRG1', 'B', '2000-01-01 00:00:00', NULL),
(5, 'PRG2', 'A', NULL, NULL)) AS t(program_version_id, program_code, version_code, valid_from, valid_to)"""

DQ_RULES = """
SELECT rule_code, severity, is_blocking, waivable FROM (VALUES
('DQ_UNKNOWN_FORMAT', 'BLOCKER', true, false), ('DQ_MIXED_FORMAT_VERSION', 'BLOCKER', true, false),
('DQ_UNKNOWN_IDENTITY', 'BLOCKER', true, false), ('DQ_UNKNOWN_UNIT', 'BLOCKER', true, false),
('DQ_SPEC_AMBIGUOUS', 'BLOCKER', true, false), ('DQ_BIN_RULE_UNKNOWN', 'BLOCKER', true, false),
('DQ_ROW_RECONCILIATION', 'ERROR', true, false), ('DQ_UNKNOWN_TIMEZONE', 'WARNING', false, true),
('DQ_DUPLICATE_CP_COORDINATE', 'BLOCKER', true, false), ('DQ_MISSING_BIN', 'ERROR', false, true),
('DQ_INVALID_NUMERIC_VALUE', 'ERROR', false, true), ('DQ_FT_MISSING_STABLE_UNIT_ID', 'WARNING', false, true),
('DQ_UNPARSEABLE_TIME', 'ERROR', false, true), ('DQ_TEST_ITEM_CONFLICT', 'BLOCKER', true, false),
('DQ_NOT_TESTED_RATIO', 'WARNING', false, true), ('DQ_CORRUPT_FILE', 'BLOCKER', true, false))
AS t(rule_code, severity, is_blocking, waivable)"""

DATASETS = """
SELECT CAST(dataset_id AS BIGINT) AS dataset_id, dataset_code, product_code FROM (VALUES
(1, 'D0', 'P0'), (2, 'D1', 'P1'), (3, 'D2', 'P2'), (4, 'D3', 'P3')) AS t(dataset_id, dataset_code, product_code)"""

VERSIONS = """
SELECT CAST(dataset_version_id AS BIGINT) AS dataset_version_id, CAST(dataset_id AS BIGINT) AS dataset_id,
       CAST(version_no AS INT) AS version_no, status, is_current FROM (VALUES
(101, 1, 1, 'SUPERSEDED', false), (102, 1, 2, 'PUBLISHED', true),
(201, 2, 1, 'SUPERSEDED', false), (202, 2, 2, 'SUPERSEDED', false), (203, 2, 3, 'PUBLISHED', true),
(301, 3, 1, 'PUBLISHED', true), (302, 3, 2, 'VALIDATING', false), (401, 4, 1, 'DRAFT', false))
AS t(dataset_version_id, dataset_id, version_no, status, is_current)"""

USERS = """
SELECT CAST(user_id AS BIGINT) AS user_id, user_code, department, status FROM (VALUES
(1, 'admin', 'IT', 'ACTIVE'), (2, 'cp1', 'MACHINERY', 'ACTIVE'), (3, 'q1', 'QA', 'ACTIVE'),
(4, 'mgr', 'BUILDING', 'ACTIVE'), (5, 'off', 'MACHINERY', 'DISABLED')) AS t(user_id, user_code, department, status)"""

USER_ROLES = """
SELECT CAST(user_id AS BIGINT) AS user_id, role_code, active FROM (VALUES
(1, 'SYSTEM_ADMIN', true), (2, 'CP_ENGINEER', true), (3, 'QUALITY_ENGINEER', true),
(4, 'MANAGER_VIEWER', true), (5, 'CP_ENGINEER', true)) AS t(user_id, role_code, active)"""

# Which seeded role carries which data permission.
ROLE_PERMISSIONS = """
SELECT role_code, permission_code FROM (VALUES
('SYSTEM_ADMIN', 'USER_ADMIN'), ('SYSTEM_ADMIN', 'AUDIT_READ'),
('DATA_ADMIN', 'DATASET_READ'), ('CP_ENGINEER', 'DATASET_READ'), ('CP_ENGINEER', 'EXPORT_DATA'),
('FT_ENGINEER', 'DATASET_READ'), ('FT_ENGINEER', 'EXPORT_DATA'),
('QUALITY_ENGINEER', 'DATASET_READ'), ('QUALITY_ENGINEER', 'EXPORT_DATA'),
('MANAGER_VIEWER', 'DATASET_READ'), ('AUDITOR', 'AUDIT_READ')) AS t(role_code, permission_code)"""

GRANTS = """
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(role_code AS VARCHAR(64)) AS role_code, scope_type, scope_key,
       permission_mode, CAST(expires_at AS TIMESTAMP) AS expires_at_utc FROM (VALUES
(2, NULL, 'PRODUCT', 'P0', 'READ', NULL), (NULL, 'CP_ENGINEER', 'SUPPLIER', '1', 'READ', '2030-01-01 00:00:00'),
(3, NULL, 'GLOBAL', '*', 'READ', NULL), (4, NULL, 'PROJECT', 'PJ1', 'READ', '2023-01-01 00:00:00'),
(4, NULL, 'DEPARTMENT', 'BUILDING', 'READ', NULL), (2, NULL, 'PRODUCT', 'P0', 'EXPORT', NULL),
(3, NULL, 'OWNER', '3', 'EXPORT', NULL))
AS t(user_id, role_code, scope_type, scope_key, permission_mode, expires_at)"""

TABLES = {
    "scopes": SCOPES,
    "items": ITEMS,
    "spec_sets": SPEC_SETS,
    "bindings": BINDINGS,
    "spec_items": SPEC_ITEMS,
    "scope_limits": SCOPE_LIMITS,
    "bin_sets": BIN_SETS,
    "bin_defs": BIN_DEFS,
    "factors": FACTORS,
    "profiles": PROFILES,
    "contracts": CONTRACTS,
    "product_aliases": PRODUCT_ALIASES,
    "program_versions": PROGRAM_VERSIONS,
    "dq_rules": DQ_RULES,
    "ds": DATASETS,
    "dv": VERSIONS,
    "app_users": USERS,
    "user_roles": USER_ROLES,
    "role_permissions": ROLE_PERMISSIONS,
    "grants": GRANTS,
}


def inline(spark: SparkSession, name: str) -> DataFrame:
    """A configuration table; the planner knows its size, so it decides on broadcasting itself."""
    text = TABLES[name].replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")
    for width in ("(8)", "(16)", "(64)"):
        text = text.replace(f"AS VARCHAR{width})", "AS STRING)")
    return spark.sql(text)
