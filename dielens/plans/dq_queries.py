"""Data-quality rules, gate and constraint checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from dielens.operators import clean, dq, ingest, rules
from dielens.plans import fixtures as fx
from dielens.plans import ingest_queries
from dielens.plans.inline import inline
from dielens.plans.registry import query


#: The SQL of every rule, for the queries over all issues.
RULES: list[str] = []


def _issue(code, entity, key, message, source, column="NULL", raw="NULL", scope=("RUN", "run_id"), row="NULL"):
    """The issue shape as SQL."""
    kind, scope_key = scope
    run = scope_key if kind == "RUN" else "NULL"
    sql = f"""SELECT '{code}' AS rule_code, '{kind}' AS scope_type, CAST({scope_key} AS VARCHAR) AS scope_key,
 CAST({run} AS VARCHAR) AS run_id, '{entity}' AS entity_type,
 CAST({key} AS VARCHAR) AS entity_key, CAST({column} AS VARCHAR) AS source_column, CAST({row} AS BIGINT) AS source_row_no,
 CAST({raw} AS VARCHAR) AS raw_value, CAST({message} AS VARCHAR) AS message FROM {source}"""
    RULES.append(sql)
    return sql


@query(
    "dq_unknown_format",
    _issue(
        "DQ_UNKNOWN_FORMAT",
        "receipt",
        "receipt_id",
        "detection_status",
        "detected WHERE detection_status <> 'DETECTED'",
        raw="candidates",
        scope=("FILE", "receipt_id"),
    ),
)
def _(spark, sf):
    return dq.dq_unknown_format(ingest.detect_format(fx.receipts(spark, sf), inline(spark, "profiles")))


@query(
    "dq_mixed_format_version",
    _issue(
        "DQ_MIXED_FORMAT_VERSION",
        "import_batch",
        "import_batch_id",
        "kind",
        f"({ingest_queries._CONFLICTS})",
        raw="n_values",
        scope=("BATCH", "import_batch_id"),
    ),
)
def _(spark, sf):
    return dq.dq_mixed_format_version(ingest_queries.conflicts(spark, sf))


@query(
    "dq_unknown_identity",
    _issue(
        "DQ_UNKNOWN_IDENTITY",
        "unit",
        "unit_id",
        "'identity is incomplete'",
        "vendor WHERE wafer_id IS NULL OR x_coord IS NULL",
        column="concat_ws(',', CASE WHEN wafer_id IS NULL THEN 'wafer_id' END, CASE WHEN x_coord IS NULL THEN 'x_coord' END)",
        row="source_row_no",
    ),
)
def _(spark, sf):
    return dq.dq_unknown_identity(fx.vendor(spark, sf), ["product_code", "lot_id", "wafer_id", "x_coord"])


@query(
    "dq_unknown_unit",
    _issue(
        "DQ_UNKNOWN_UNIT",
        "test_item",
        "run_id || '/' || col",
        "'no conversion rule'",
        """(SELECT DISTINCT run_id, unnest(['VTH', 'BVDSS', 'IDSS', 'RDSON']) AS col, unnest(['V', bvdss_unit, 'uA', 'mOhm']) AS u
 FROM vendor) z WHERE u NOT IN (SELECT unit_raw FROM factors)""",
        column="col",
        raw="u",
    ),
)
def _(spark, sf):
    return unknown_units(spark, sf)


def unknown_units(spark, sf):
    units = {"VTH": F.lit("V"), "BVDSS": F.col("bvdss_unit"), "IDSS": F.lit("uA"), "RDSON": F.lit("mOhm")}
    named = F.array(*[F.struct(F.lit(c).alias("source_column"), u.alias("unit_raw")) for c, u in units.items()])
    return dq.dq_unknown_unit(fx.vendor(spark, sf).select("run_id", F.inline(named)), inline(spark, "factors"))


@query(
    "dq_spec_ambiguous",
    _issue(
        "DQ_SPEC_AMBIGUOUS",
        "context",
        "lot_id || '/' || product_code",
        "'several bindings at top priority'",
        """(SELECT DISTINCT r.lot_id, r.product_code, c.run_id, r.n_candidates FROM spec_res r JOIN cp_rows c
 ON c.supplier_id = r.supplier_id AND c.product_code = r.product_code AND c.lot_id = r.lot_id AND c.tested_at_utc = r.tested_at_utc
 WHERE r.binding_status = 'CONFIG_AMBIGUOUS')""",
        raw="n_candidates",
    ),
)
def _(spark, sf):
    return ambiguous_specs(spark, sf)


def ambiguous_specs(spark, sf):
    resolved = rules.resolve_spec_binding(
        fx.cp_rows(spark, sf),
        inline(spark, "bindings"),
        inline(spark, "spec_sets"),
        inline(spark, "scopes"),
        "tested_at_utc",
    )
    return dq.dq_spec_ambiguous(resolved, ["lot_id", "product_code"])


@query(
    "dq_bin_rule_unknown",
    _issue(
        "DQ_BIN_RULE_UNKNOWN",
        "bin",
        "run_id || '/' || soft_bin",
        "mapping_status",
        "(SELECT DISTINCT run_id, soft_bin, mapping_status FROM outcomes WHERE mapping_status <> 'MATCHED')",
        column="'soft_bin'",
        raw="soft_bin",
    ),
)
def _(spark, sf):
    return dq.dq_bin_rule_unknown(fx.with_outcome(spark, fx.cp_rows(spark, sf)))


@query(
    "dq_row_reconciliation",
    _issue(
        "DQ_ROW_RECONCILIATION",
        "run",
        "run_id",
        "'row counts break the contract'",
        """(SELECT run_id, count(*) AS a, count(*) FILTER (wafer_id IS NOT NULL) AS b, count(*) * 4 AS c FROM vendor GROUP BY run_id) z
 WHERE a <> b OR c <> b * 4""",
        raw="concat_ws('/', a, b, c)",
    ),
)
def _(spark, sf):
    return unreconciled(spark, sf)


def unreconciled(spark, sf):
    raw = fx.vendor(spark, sf)
    n_items = inline(spark, "items").agg(F.count("*")).scalar()
    items = raw.select("run_id").distinct().withColumn("n_items", n_items)
    counts = clean.run_output_counts(raw, raw.where("wafer_id IS NOT NULL"), fx.meas(spark, sf))
    return dq.dq_row_reconciliation(counts, items)


@query(
    "dq_unknown_timezone",
    _issue(
        "DQ_UNKNOWN_TIMEZONE",
        "run",
        "unit_id",
        "CASE WHEN supplier_zone IS NULL THEN 'UNKNOWN' ELSE 'SUPPLIER_DEFAULT' END",
        "ft WHERE explicit_zone IS NULL AND (supplier_zone IS NOT NULL OR file_zone IS NULL)",
        raw="supplier_zone",
    ),
)
def _(spark, sf):
    return dq.dq_unknown_timezone(clean.resolve_timezone(fx.ft(spark, sf)))


@query(
    "dq_duplicate_cp_coordinate",
    _issue(
        "DQ_DUPLICATE_CP_COORDINATE",
        "die",
        "concat_ws('/', run_id, x_coord, y_coord, attempt_no)",
        "'position repeated in one attempt'",
        """(SELECT run_id, x_coord, y_coord, attempt_no, count(*) AS n FROM vendor WHERE x_coord IS NOT NULL
 GROUP BY ALL HAVING count(*) > 1)""",
        raw="n",
    ),
)
def _(spark, sf):
    return dq.dq_duplicate_cp_coordinate(fx.vendor(spark, sf))


@query(
    "dq_missing_bin",
    _issue(
        "DQ_MISSING_BIN", "unit", "unit_id", "'bin is blank'", "vendor WHERE soft_bin IS NULL", "'soft_bin'", "soft_bin", row="source_row_no"
    ),
)
def _(spark, sf):
    return dq.dq_missing_bin(fx.vendor(spark, sf))


INVALID_SHARE = 0.015


def parsed(spark, sf):
    long = clean.unpivot_measurements(
        fx.vendor(spark, sf), ["unit_id", "run_id"], {"vth": 1, "bvdss": 2, "idss": 3, "rdson": 4}
    )
    return clean.parse_measurement_value(long)


@query(
    "dq_invalid_numeric_value",
    _issue(
        "DQ_INVALID_NUMERIC_VALUE",
        "run",
        "run_id",
        "'too many unreadable numbers'",
        "(SELECT run_id, sum((vth = 'ERR')::INT) / (4 * count(*)) AS s FROM vendor GROUP BY run_id) z WHERE s > 0.015",
        raw="round(s, 6)",
    ),
)
def _(spark, sf):
    return dq.dq_invalid_numeric_value(parsed(spark, sf), INVALID_SHARE)


@query(
    "dq_ft_missing_stable_unit_id",
    _issue(
        "DQ_FT_MISSING_STABLE_UNIT_ID",
        "unit",
        "unit_id",
        "'no serial number'",
        "ft WHERE serial_no IS NULL",
        "'serial_no'",
    ),
)
def _(spark, sf):
    return dq.dq_ft_missing_stable_unit_id(fx.ft(spark, sf))


@query(
    "dq_unparseable_time",
    _issue(
        "DQ_UNPARSEABLE_TIME",
        "row",
        "event_id",
        "'time cannot be read'",
        """(SELECT event_id, run_id, CASE WHEN site_no = 3 THEN strftime(source_started_local, '%d.%m.%Y')
 ELSE strftime(source_started_local, '%Y-%m-%d %H:%M:%S') END AS t FROM ft) z WHERE try_strptime(t, '%Y-%m-%d %H:%M:%S') IS NULL""",
        "'started_text'",
        "t",
    ),
)
def _(spark, sf):
    return unparseable(spark, sf)


def unparseable(spark, sf):
    started = F.col("source_started_local")
    text = F.when(F.col("site_no") == 3, F.date_format(started, "dd.MM.yyyy")).otherwise(
        F.date_format(started, "yyyy-MM-dd HH:mm:ss")
    )
    rows = fx.ft(spark, sf).withColumn("started_text", text)
    return dq.dq_unparseable_time(rows, "started_text", "yyyy-MM-dd HH:mm:ss", "event_id", "run_id")


@query(
    "dq_test_item_conflict",
    _issue(
        "DQ_TEST_ITEM_CONFLICT",
        "test_item",
        "concat_ws('/', p_brand, p_type)",
        "'definitions differ'",
        "(SELECT p_brand, p_type, count(DISTINCT p_size) AS n FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) > 1)",
        raw="n",
        scope=("ALL", "NULL"),
    ),
)
def _(spark, sf):
    return dq.dq_test_item_conflict(fx.table(spark, sf, "part"), ["p_brand", "p_type"], ["p_size"])


@query(
    "dq_not_tested_ratio",
    _issue(
        "DQ_NOT_TESTED_RATIO",
        "parameter",
        "concat_ws('/', run_id, parameter_code)",
        "'unusual share not tested'",
        """(SELECT run_id, parameter_code, avg((measurement_status = 'NOT_TESTED')::INT) AS s FROM meas GROUP BY 1, 2) z
 WHERE s > 0.14""",
        "parameter_code",
        "round(s, 6)",
    ),
)
def _(spark, sf):
    return dq.dq_not_tested_ratio(fx.meas(spark, sf), 0.14)


@query(
    "dq_corrupt_file",
    _issue(
        "DQ_CORRUPT_FILE",
        "receipt",
        "receipt_id",
        "CASE WHEN coalesce(length(c), 0) = 0 THEN 'empty' ELSE 'hash mismatch' END",
        """(SELECT receipt_id, import_batch_id, sha256, CASE WHEN receipt_id % 97 = 0 THEN '' WHEN receipt_id % 89 = 0 THEN content || '!'
 ELSE content END AS c FROM receipts) z WHERE coalesce(length(c), 0) = 0 OR sha256(c) <> sha256""",
        scope=("FILE", "receipt_id"),
    ),
)
def _(spark, sf):
    return corrupt_files(spark, sf)


def corrupt_files(spark, sf):
    id_ = F.col("receipt_id")
    damaged = (
        F.when(id_ % 97 == 0, "").when(id_ % 89 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    )
    manifest = fx.receipts(spark, sf).withColumns({"announced_sha256": F.col("sha256"), "content": damaged})
    return dq.dq_corrupt_file(manifest)


def all_issues(spark, sf):
    """The findings of all sixteen rules with their state; who counts them reads no more of them than that takes."""
    rows, tested = fx.vendor(spark, sf), fx.ft(spark, sf)
    found = [
        dq.dq_unknown_format(ingest.detect_format(fx.receipts(spark, sf), inline(spark, "profiles"))),
        dq.dq_mixed_format_version(ingest_queries.conflicts(spark, sf)),
        dq.dq_unknown_identity(rows, ["product_code", "lot_id", "wafer_id", "x_coord"]),
        unknown_units(spark, sf),
        ambiguous_specs(spark, sf),
        dq.dq_bin_rule_unknown(fx.with_outcome(spark, fx.cp_rows(spark, sf))),
        unreconciled(spark, sf),
        dq.dq_unknown_timezone(clean.resolve_timezone(tested)),
        dq.dq_duplicate_cp_coordinate(rows),
        dq.dq_missing_bin(rows),
        dq.dq_invalid_numeric_value(parsed(spark, sf), INVALID_SHARE),
        dq.dq_ft_missing_stable_unit_id(tested),
        unparseable(spark, sf),
        dq.dq_test_item_conflict(fx.table(spark, sf, "part"), ["p_brand", "p_type"], ["p_size"]),
        dq.dq_not_tested_ratio(fx.meas(spark, sf), 0.14),
        corrupt_files(spark, sf),
    ]
    issues = dq.dq_issues(found, inline(spark, "dq_rules"), "DQ 1.0")
    kind, key = F.col("scope_type"), F.col("scope_key")
    lot = F.substring("scope_key", 2, 1)
    state = (
        F.when((kind == "ALL") | lot.isin("1", "2"), "RESOLVED")
        .when(kind == "BATCH", F.when(F.length(key) % 2 == 0, "RESOLVED").otherwise("OPEN"))
        .when(kind == "FILE", F.when(key.cast("long") % 3 == 0, "OPEN").otherwise("RESOLVED"))
        .when((lot == "3") & (F.col("severity") == "ERROR"), "WAIVED")
        .when(lot == "3", "RESOLVED")
        .when(lot == "4", "IGNORED")
        .when(lot == "5", "WAIVED")
        .otherwise("OPEN")
    )
    return issues.withColumn("resolution_status", state)


def closure(spark, sf):
    probed = fx.cp_runs(spark, sf).select("run_id", "lot_id", "receipt_id")
    tested = fx.ft(spark, sf).select("run_id", "lot_id", F.lit(None).cast("long").alias("receipt_id")).distinct()
    return dq.scope_closure(probed.unionByName(tested), fx.receipts(spark, sf).select("receipt_id", "import_batch_id"))


_STATED = f"""(SELECT i.*, r.severity, r.is_blocking, r.waivable, 'DQ 1.0' AS rule_set_version,
 CASE WHEN scope_type = 'ALL' OR substr(scope_key, 2, 1) IN ('1', '2') THEN 'RESOLVED'
 WHEN scope_type = 'BATCH' THEN CASE WHEN length(scope_key) % 2 = 0 THEN 'RESOLVED' ELSE 'OPEN' END
 WHEN scope_type = 'FILE' THEN CASE WHEN CAST(scope_key AS BIGINT) % 3 = 0 THEN 'OPEN' ELSE 'RESOLVED' END
 WHEN substr(scope_key, 2, 1) = '3' THEN CASE WHEN r.severity = 'ERROR' THEN 'WAIVED' ELSE 'RESOLVED' END
 WHEN substr(scope_key, 2, 1) = '4' THEN 'IGNORED' WHEN substr(scope_key, 2, 1) = '5' THEN 'WAIVED' ELSE 'OPEN' END AS resolution_status
 FROM ({" UNION ALL ".join(RULES)}) i JOIN dq_rules r ON r.rule_code = i.rule_code)"""

_CLOSURE = """runs AS (SELECT DISTINCT run_id, lot_id, receipt_id FROM cp_runs UNION SELECT DISTINCT run_id, lot_id, NULL FROM ft),
files AS (SELECT CAST(f.receipt_id AS VARCHAR) AS receipt_id, f.import_batch_id, r.run_id FROM receipts f
 LEFT JOIN runs r ON r.receipt_id = f.receipt_id),
closure AS (SELECT 'RUN' AS scope_type, run_id AS scope_key, run_id FROM runs UNION SELECT 'LOT', lot_id, run_id FROM runs
 UNION SELECT 'FILE', receipt_id, run_id FROM files UNION SELECT 'BATCH', import_batch_id, run_id FROM files)"""


@query(
    "dq_issues",
    f"""SELECT rule_code, scope_type, scope_key, run_id, entity_type, entity_key, source_row_no, severity, is_blocking, waivable,
 rule_set_version FROM {_STATED}""",
)
def _(spark, sf):
    return all_issues(spark, sf).select(
        "rule_code", "scope_type", "scope_key", "run_id", "entity_type", "entity_key", "source_row_no", "severity",
        "is_blocking", "waivable", "rule_set_version",
    )


@query(
    "dq_summary",
    f"""WITH {_CLOSURE}, stated AS {_STATED}
SELECT k.run_id, resolution_status, count(*) FILTER (severity = 'BLOCKER') AS blocker, count(*) FILTER (severity = 'ERROR') AS error,
 count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info
FROM stated s LEFT JOIN closure k ON k.scope_type = s.scope_type AND k.scope_key = s.scope_key GROUP BY 1, 2""",
)
def _(spark, sf):
    return dq.dq_summary(all_issues(spark, sf), closure(spark, sf))


@query(
    "publish_gate",
    f"""WITH {_CLOSURE}, stated AS {_STATED},
c AS (SELECT scope_type, scope_key, count(*) FILTER (severity = 'BLOCKER' AND resolution_status <> 'RESOLVED') AS n_blockers,
 count(*) FILTER (severity = 'ERROR' AND (resolution_status = 'OPEN' OR (resolution_status <> 'RESOLVED' AND NOT waivable))) AS n_errors,
 count(*) FILTER (is_blocking AND ((severity NOT IN ('BLOCKER', 'ERROR') AND resolution_status = 'OPEN')
   OR (severity = 'ERROR' AND resolution_status = 'IGNORED'))) AS n_blocking_rules FROM stated GROUP BY 1, 2),
lost AS (SELECT coalesce(sum(n_blockers + n_errors + n_blocking_rules), 0) AS n FROM c WHERE NOT EXISTS
 (SELECT 1 FROM closure k WHERE k.scope_type = c.scope_type AND k.scope_key = c.scope_key)),
s AS (SELECT k.run_id, CAST(sum(n_blockers) AS BIGINT) AS n_blockers, CAST(sum(n_errors) AS BIGINT) AS n_errors,
 CAST(sum(n_blocking_rules) AS BIGINT) AS n_blocking_rules
 FROM c JOIN closure k ON k.scope_type = c.scope_type AND k.scope_key = c.scope_key GROUP BY 1),
r AS (SELECT run_id, count(*) > 40 AS reconciled FROM cp_rows GROUP BY run_id UNION ALL SELECT DISTINCT run_id, true FROM ft)
SELECT r.run_id, r.reconciled, coalesce(n_blockers, 0) AS n_blockers, coalesce(n_errors, 0) AS n_errors,
 coalesce(n_blocking_rules, 0) AS n_blocking_rules,
 coalesce(n_blockers, 0) + coalesce(n_errors, 0) + coalesce(n_blocking_rules, 0) = 0 AND reconciled AND (SELECT n FROM lost) = 0 AS can_publish
FROM r LEFT JOIN s ON s.run_id = r.run_id""",
)
def _(spark, sf):
    probed = fx.cp_rows(spark, sf).groupBy("run_id").agg((F.count(F.lit(1)) > 40).alias("reconciled"))
    tested = fx.ft(spark, sf).select("run_id").distinct().withColumn("reconciled", F.lit(True))
    return dq.publish_gate(all_issues(spark, sf), probed.unionByName(tested), closure(spark, sf))


@query(
    "dq_waiver_violations",
    f"""SELECT rule_code, scope_key, entity_key, resolution_status,
 CASE WHEN severity = 'BLOCKER' AND resolution_status IN ('WAIVED', 'IGNORED') THEN 'BLOCKER_' || resolution_status ELSE 'NOT_WAIVABLE' END AS violation
FROM {_STATED} WHERE (severity = 'BLOCKER' AND resolution_status IN ('WAIVED', 'IGNORED')) OR (resolution_status = 'WAIVED' AND NOT waivable)""",
)
def _(spark, sf):
    bad = dq.dq_waiver_violations(all_issues(spark, sf))
    return bad.select("rule_code", "scope_key", "entity_key", "resolution_status", "violation")


@query(
    "unique_violations",
    """SELECT lot_id, wafer_id, x_coord, y_coord, count(*) AS n FROM vendor WHERE x_coord IS NOT NULL AND wafer_id IS NOT NULL
GROUP BY ALL HAVING count(*) > 1""",
)
def _(spark, sf):
    filtered = F.col("x_coord").isNotNull() & F.col("wafer_id").isNotNull()
    return dq.unique_violations(fx.vendor(spark, sf), ["lot_id", "wafer_id", "x_coord", "y_coord"], filtered)


@query(
    "fk_orphans",
    """SELECT receipt_id, import_batch_id FROM receipts WHERE receipt_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(spark, sf):
    child = fx.receipts(spark, sf).select("receipt_id", "import_batch_id")
    return dq.fk_orphans(child, "receipt_id", fx.table(spark, sf, "labels"), "doc_id")


@query(
    "check_violations",
    """SELECT CAST(audit_id AS VARCHAR) AS row_key, 'operation' AS check_name FROM audit
 WHERE operation NOT IN ('DQ_WAIVE', 'EXPORT_DOWNLOAD', 'SPEC_BINDING', 'BIN_MAPPING')
UNION ALL SELECT CAST(audit_id AS VARCHAR), 'confidence' FROM audit WHERE json_extract_string(after_json, '$.limit')::DOUBLE > 1
UNION ALL SELECT CAST(audit_id AS VARCHAR), 'json' FROM audit WHERE entity_id = '5'""",
)
def _(spark, sf):
    rows = fx.audit(spark, sf).withColumn(
        "text", F.when(F.col("entity_id") == "5", F.concat(F.lit("{"), "after_json")).otherwise(F.col("after_json"))
    )
    checks = {
        "operation": F.col("operation").isin("DQ_WAIVE", "EXPORT_DOWNLOAD", "SPEC_BINDING", "BIN_MAPPING"),
        "confidence": F.get_json_object("after_json", "$.limit").cast("double").between(0, 1),
        "json": dq.valid_json("text"),
    }
    return dq.check_violations(rows, "audit_id", checks)


#: The figures of each level: its key and what is counted, over (unit_id, lot_id, wafer_id, x_coord, soft_bin, passed, value columns).
_LEVELS = {
    "UNIT": (["unit_id"], "concat_ws('|', lot_id, coalesce(wafer_id, '-'), coalesce(CAST(x_coord AS VARCHAR), '-'))"),
    "WAFER": (["lot_id", "wafer_id"], "count(*)"),
    "BIN": (["lot_id", "soft_bin"], "count(*)"),
    "YIELD": (["lot_id"], "concat_ws('|', count(*), sum(passed))"),
    "PARAMETER": (["lot_id", "parameter"], "concat_ws('|', count(*), sum(measured))"),
}


def _sql_level(name: str, side: str) -> str:
    keys, value = _LEVELS[name]
    rows = f"{side}_long" if name == "PARAMETER" else side
    key = ", ".join(f"coalesce({k}, '-')" for k in keys)
    grouped = "" if name == "UNIT" else f" GROUP BY {', '.join(keys)}"
    return f"SELECT '{name}' AS level, concat_ws('|', {key}) AS k, CAST({value} AS VARCHAR) AS v FROM {rows}{grouped}"


def _sql_long(side: str) -> str:
    return f"""{side}_long AS (SELECT lot_id, unnest(['VTH', 'BVDSS', 'IDSS', 'RDSON']) AS parameter,
 unnest([TRY_CAST(vth AS DOUBLE) IS NOT NULL, TRY_CAST(bvdss AS DOUBLE) IS NOT NULL, TRY_CAST(idss AS DOUBLE) IS NOT NULL,
 TRY_CAST(rdson AS DOUBLE) IS NOT NULL])::INT AS measured FROM {side})"""


_COLUMNS = "unit_id, lot_id, wafer_id, x_coord, soft_bin, CASE WHEN first_fail IS NULL THEN 1 ELSE 0 END AS passed, vth, bvdss, idss, rdson"


@query(
    "golden_reconcile",
    f"""WITH observed AS (SELECT {_COLUMNS} FROM vendor),
expected AS (SELECT CASE WHEN l_orderkey % 499 = 0 THEN concat(unit_id, '-gone') ELSE unit_id END AS unit_id, lot_id, wafer_id,
 x_coord, soft_bin, CASE WHEN first_fail IS NULL THEN 1 ELSE 0 END AS passed, CAST(l_quantity AS VARCHAR) AS vth,
 CASE WHEN first_fail < 2 THEN '' WHEN l_extendedprice > 100000 THEN 'OVER' ELSE CAST(l_extendedprice AS VARCHAR) END AS bvdss,
 CASE WHEN first_fail < 3 THEN '' ELSE CAST(l_discount AS VARCHAR) END AS idss,
 CASE WHEN first_fail < 4 THEN '' ELSE CAST(l_tax AS VARCHAR) END AS rdson FROM cp_rows WHERE l_orderkey % 503 <> 0),
{_sql_long("observed")}, {_sql_long("expected")},
o AS ({" UNION ALL ".join(_sql_level(n, "observed") for n in _LEVELS)}),
e AS ({" UNION ALL ".join(_sql_level(n, "expected") for n in _LEVELS)})
SELECT coalesce(o.level, e.level) AS level, coalesce(o.k, e.k) AS entity_key,
 CASE WHEN o.k IS NULL THEN 'MISSING' WHEN e.k IS NULL THEN 'EXTRA' ELSE 'CHANGED' END AS problem, o.v AS observed, e.v AS expected
FROM o FULL JOIN e ON o.level = e.level AND o.k = e.k WHERE o.v IS DISTINCT FROM e.v""",
)
def _(spark, sf):
    """The cleaned vendor rows against an approved list in which some units have another id and some are absent."""
    golden = fx.cp_rows(spark, sf).where("l_orderkey % 503 <> 0")
    other = F.when(F.col("l_orderkey") % 499 == 0, F.concat("unit_id", F.lit("-gone"))).otherwise(F.col("unit_id"))
    skipped = {i: F.coalesce(F.col("first_fail") < i, F.lit(False)) for i in (2, 3, 4)}
    golden = golden.withColumns(
        {
            "unit_id": other,
            "vth": F.col("l_quantity").cast("string"),
            "bvdss": F.when(skipped[2], "").when(F.col("l_extendedprice") > 100000, "OVER").otherwise(F.col("l_extendedprice").cast("string")),
            "idss": F.when(skipped[3], "").otherwise(F.col("l_discount").cast("string")),
            "rdson": F.when(skipped[4], "").otherwise(F.col("l_tax").cast("string")),
        }
    )
    return dq.golden_reconcile(
        [dq.Level(n, *[figures(df, n) for df in (fx.vendor(spark, sf), golden)], _LEVELS[n][0]) for n in _LEVELS]
    )


def figures(df, level):
    """The figures of one level."""
    keys = _LEVELS[level][0]
    if level == "UNIT":
        return df.select("unit_id", "lot_id", "wafer_id", "x_coord")
    if level == "PARAMETER":
        read = {"VTH": "vth", "BVDSS": "bvdss", "IDSS": "idss", "RDSON": "rdson"}
        each = [
            F.struct(F.lit(p).alias("parameter"), F.expr(f"try_cast({c} AS double) IS NOT NULL").cast("int").alias("measured"))
            for p, c in read.items()
        ]
        return df.select("lot_id", F.inline(F.array(*each))).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("measured").alias("measured"))
    counts = [F.count("*").alias("n")]
    if level == "YIELD":
        counts.append(F.count_if(F.col("first_fail").isNull()).alias("passed"))
    return df.groupBy(*keys).agg(*counts)
