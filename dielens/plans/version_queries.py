"""Dataset versions, publishing and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from dielens.operators import versions
from dielens.plans import fixtures as fx
from dielens.plans.inline import inline
from dielens.plans.registry import query

_CURRENT = "status = 'PUBLISHED' AND is_current"


@query(
    "v_current_dataset_version",
    f"""SELECT d.dataset_id, d.dataset_code, d.dataset_type, v.dataset_version_id, v.version_no, v.row_count, v.unit_count,
 v.measurement_count, v.published_by, v.published_at_utc FROM archive_dv v JOIN archive_ds d ON d.dataset_id = v.dataset_id WHERE {_CURRENT}""",
)
def _(spark, sf):
    current = versions.v_current_dataset_version(fx.archive_datasets(spark, sf), fx.archive_versions(spark, sf))
    return current.select(
        "dataset_id",
        "dataset_code",
        "dataset_type",
        "dataset_version_id",
        "version_no",
        "row_count",
        "unit_count",
        "measurement_count",
        "published_by",
        "published_at_utc",
    )


def current_runs(spark, sf):
    return versions.v_current_test_run(inline(spark, "dv"), fx.version_runs(spark, sf), fx.cp_runs(spark, sf))


_RUNS = f"""(SELECT DISTINCT r.run_id, r.lot_id, r.wafer_id, m.dataset_version_id FROM dvr m JOIN cp_runs r
 ON r.processing_run_id = m.processing_run_id JOIN dv v ON v.dataset_version_id = m.dataset_version_id WHERE {_CURRENT})"""


@query("v_current_test_run", f"SELECT * FROM {_RUNS}")
def _(spark, sf):
    return current_runs(spark, sf).select("run_id", "lot_id", "wafer_id", "dataset_version_id")


@query(
    "v_current_unit_result",
    f"SELECT u.unit_id, u.soft_bin, r.dataset_version_id FROM cp_rows u JOIN {_RUNS} r ON r.run_id = u.run_id",
)
def _(spark, sf):
    current = versions.v_current_unit_result(current_runs(spark, sf), fx.cp_rows(spark, sf))
    return current.select("unit_id", "soft_bin", "dataset_version_id")


@query(
    "v_current_measurement",
    f"SELECT m.measurement_id, m.value_numeric, r.dataset_version_id FROM meas m JOIN {_RUNS} r ON r.run_id = m.run_id",
)
def _(spark, sf):
    current = versions.v_current_measurement(current_runs(spark, sf), fx.meas(spark, sf))
    return current.select("measurement_id", "value_numeric", "dataset_version_id")


@query(
    "read_pinned_version",
    """SELECT u.unit_id, m.dataset_version_id FROM cp_rows u JOIN cp_runs r ON r.run_id = u.run_id
JOIN dvr m ON m.processing_run_id = r.processing_run_id WHERE m.dataset_version_id IN (101, 202)""",
)
def _(spark, sf):
    pinned = versions.read_pinned_version(
        fx.cp_rows(spark, sf), fx.version_runs(spark, sf), fx.cp_runs(spark, sf), [101, 202]
    )
    return pinned.select("unit_id", "dataset_version_id")


_ACCEPTED = """WITH one AS (SELECT dataset_id, min(dataset_version_id) AS new_id FROM archive_dv WHERE status = 'DRAFT'
 AND unit_count > 20000 GROUP BY dataset_id HAVING count(*) = 1)"""


@query(
    "publish_version",
    f"""{_ACCEPTED}
SELECT v.dataset_version_id, v.dataset_id, CASE WHEN o.new_id = v.dataset_version_id THEN 'PUBLISHED'
 WHEN o.new_id IS NOT NULL AND v.is_current THEN 'SUPERSEDED' ELSE v.status END AS status,
 CASE WHEN o.new_id = v.dataset_version_id THEN true WHEN o.new_id IS NOT NULL THEN false ELSE v.is_current END AS is_current,
 CASE WHEN o.new_id = v.dataset_version_id THEN 99 ELSE v.published_by END AS published_by,
 CASE WHEN o.new_id = v.dataset_version_id THEN TIMESTAMP '2024-03-01 00:00:00' ELSE v.published_at_utc END AS published_at_utc
FROM archive_dv v LEFT JOIN one o ON o.dataset_id = v.dataset_id""",
)
def _(spark, sf):
    table = fx.archive_versions(spark, sf)
    candidates = table.where("status = 'DRAFT'").select(
        "dataset_version_id", (F.col("unit_count") > 20000).alias("can_publish")
    )
    state = versions.publish_version(table, candidates, 99, "2024-03-01 00:00:00")
    return state.select("dataset_version_id", "dataset_id", "status", "is_current", "published_by", "published_at_utc")


@query(
    "publish_processing_run",
    f"""{_ACCEPTED}
SELECT v.dataset_version_id AS processing_run_id, CASE WHEN o.new_id = v.dataset_version_id THEN 'PUBLISHED'
 WHEN o.new_id IS NOT NULL AND v.is_current THEN 'SUPERSEDED' WHEN v.status = 'DRAFT' THEN 'VALIDATING' ELSE v.status END AS status,
 CASE WHEN o.new_id = v.dataset_version_id THEN true WHEN o.new_id IS NOT NULL THEN false ELSE v.is_current END AS is_current
FROM archive_dv v LEFT JOIN one o ON o.dataset_id = v.dataset_id""",
)
def _(spark, sf):
    status = F.when(F.col("status") == "DRAFT", "VALIDATING").otherwise(F.col("status"))
    runs = fx.archive_versions(spark, sf).select(
        F.col("dataset_version_id").alias("processing_run_id"),
        F.col("dataset_id").alias("source_file_id"),
        status.alias("status"),
        "is_current",
        "unit_count",
    )
    candidates = runs.where("status = 'VALIDATING'").select(
        "processing_run_id", (F.col("unit_count") > 20000).alias("can_publish")
    )
    return versions.publish_processing_run(runs, candidates).select("processing_run_id", "status", "is_current")


@query(
    "version_history",
    """SELECT dataset_version_id, dataset_id, version_no, status, row_count,
 lag(row_count) OVER w AS previous_row_count, row_count - lag(row_count) OVER w AS row_count_delta,
 lag(unit_count) OVER w AS previous_unit_count, unit_count - lag(unit_count) OVER w AS unit_count_delta
FROM archive_dv WINDOW w AS (PARTITION BY dataset_id ORDER BY version_no)""",
)
def _(spark, sf):
    return versions.version_history(fx.archive_versions(spark, sf)).select(
        "dataset_version_id",
        "dataset_id",
        "version_no",
        "status",
        "row_count",
        "previous_row_count",
        "row_count_delta",
        "previous_unit_count",
        "unit_count_delta",
    )


def members(spark, sf):
    rows = fx.meas(spark, sf).select("measurement_id", "logical_unit_key", "test_item_id", "run_id", "run_attempt_no")
    return [rows.where(F.col("run_attempt_no") == n).drop("run_attempt_no") for n in (0, 1)]


@query("merge_member_measurements", "SELECT measurement_id, logical_unit_key, test_item_id, run_id FROM meas")
def _(spark, sf):
    return versions.merge_member_measurements(members(spark, sf))[0]


@query(
    "merge_member_conflicts",
    """SELECT logical_unit_key, test_item_id, count(DISTINCT run_id) AS n_runs, count(*) AS n_measurements FROM meas
GROUP BY 1, 2 HAVING count(DISTINCT run_id) > 1""",
)
def _(spark, sf):
    return versions.merge_member_measurements(members(spark, sf))[1]


@query(
    "seed_upsert",
    """SELECT concat('U', s_suppkey) AS user_code, s_name AS display_name FROM supplier
UNION ALL SELECT concat('U', c_custkey), c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def _(spark, sf):
    known = fx.table(spark, sf, "supplier").select(
        F.concat(F.lit("U"), "s_suppkey").alias("user_code"), F.col("s_name").alias("display_name")
    )
    seeds = fx.table(spark, sf, "customer").select(
        F.concat(F.lit("U"), "c_custkey").alias("user_code"), F.col("c_name").alias("display_name")
    )
    return versions.seed_upsert(known, seeds, ["user_code"])


#: Users and the code of their nation; every 50th code is unknown, and some users come twice with different ones.
_MEMBERS = """(SELECT 'U' || c_custkey AS user_code, CASE WHEN c_custkey % 50 = 0 THEN 'NOWHERE' ELSE n_name END AS nation_code
 FROM customer JOIN nation ON n_nationkey = c_nationkey
 UNION ALL SELECT 'U' || s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 = 0)"""
_MAPPED = f"""m AS (SELECT user_code, nation_code, n_nationkey AS nation_id FROM {_MEMBERS} LEFT JOIN nation ON n_name = nation_code),
k AS (SELECT user_code, min(nation_id) AS nation_id, min(nation_code) AS nation_code, count(DISTINCT nation_id) AS n FROM m
 WHERE nation_id IS NOT NULL GROUP BY 1),
known AS (SELECT 'U' || s_suppkey AS user_code, s_nationkey AS nation_id FROM supplier WHERE s_suppkey % 3 = 0)"""


def mapped(spark, sf):
    nations = fx.table(spark, sf, "nation")
    users = fx.table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("U"), "c_custkey").alias("user_code"),
        F.when(F.col("c_custkey") % 50 == 0, "NOWHERE").otherwise(F.col("n_name")).alias("nation_code"),
    )
    suppliers = fx.table(spark, sf, "supplier")
    more = suppliers.where("s_suppkey % 5 = 0").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("U"), "s_suppkey").alias("user_code"), F.col("n_name").alias("nation_code")
    )
    known = suppliers.where("s_suppkey % 3 = 0").select(
        F.concat(F.lit("U"), "s_suppkey").alias("user_code"), F.col("s_nationkey").alias("nation_id")
    )
    lookup = {"nation_id": versions.Lookup(nations, "nation_code", "n_name", "n_nationkey")}
    return versions.seed_mapped(known, users.unionByName(more), lookup, ["user_code"])


@query(
    "seed_mapped",
    f"""WITH {_MAPPED} SELECT user_code, nation_id FROM known
UNION ALL SELECT user_code, nation_id FROM k WHERE n = 1 AND user_code NOT IN (SELECT user_code FROM known)""",
)
def _(spark, sf):
    return mapped(spark, sf)[0]


@query(
    "seed_mapped_problems",
    f"""WITH {_MAPPED} SELECT DISTINCT nation_code, 'UNRESOLVED' AS problem FROM m WHERE nation_id IS NULL
UNION ALL SELECT nation_code, 'CONFLICT' FROM k WHERE n > 1""",
)
def _(spark, sf):
    return mapped(spark, sf)[1]


@query(
    "backfill_evaluation_run",
    """WITH runs AS (SELECT o_custkey % 500 AS dataset_version_id, CASE WHEN o_orderkey % 2 = 0 THEN 'SPEC' ELSE 'BIN' END AS evaluation_type,
 count(*) AS n, min(o_orderkey) AS run FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2),
e AS (SELECT event_id, user_id AS dataset_version_id, CASE WHEN event_id % 2 = 0 THEN 'SPEC' ELSE 'BIN' END AS evaluation_type,
 CASE WHEN event_type = 'click' THEN event_id END AS given FROM events)
SELECT e.event_id AS evaluation_id, coalesce(e.given, CASE WHEN r.n = 1 THEN r.run END) AS evaluation_run_id,
 CASE WHEN e.given IS NOT NULL THEN 'GIVEN' WHEN r.n = 1 THEN 'BACKFILLED' WHEN r.n > 1 THEN 'SEVERAL_RUNS' ELSE 'NO_RUN' END AS backfill_status
FROM e LEFT JOIN runs r ON r.dataset_version_id = e.dataset_version_id AND r.evaluation_type = e.evaluation_type""",
)
def _(spark, sf):
    def kind(column):
        return F.when(F.col(column) % 2 == 0, "SPEC").otherwise("BIN").alias("evaluation_type")

    runs = fx.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        (F.col("o_custkey") % 500).alias("dataset_version_id"), kind("o_orderkey"), F.col("o_orderkey").alias("evaluation_run_id")
    )
    history = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("evaluation_id"),
        F.col("user_id").alias("dataset_version_id"),
        kind("event_id"),
        F.when(F.col("event_type") == "click", F.col("event_id")).alias("evaluation_run_id"),
    )
    filled = versions.backfill_evaluation_run(history, runs, ["dataset_version_id", "evaluation_type"])
    return filled.select("evaluation_id", "evaluation_run_id", "backfill_status")


@query(
    "audit_diff",
    """SELECT * FROM (SELECT audit_id, operation, f.field, json_extract_string(before_json, concat('$.', f.field)) AS old_value,
 json_extract_string(after_json, concat('$.', f.field)) AS new_value
 FROM audit CROSS JOIN (VALUES ('limit'), ('state'), ('k'), ('owner')) f(field)) WHERE old_value IS DISTINCT FROM new_value""",
)
def _(spark, sf):
    return versions.audit_diff(fx.audit(spark, sf))


@query(
    "audit_search",
    """SELECT audit_id, actor, entity_id, correlation_id, occurred_at_utc FROM audit WHERE operation = 'EXPORT_DOWNLOAD'
 AND occurred_at_utc >= TIMESTAMP '2024-01-05 00:00:00' ORDER BY occurred_at_utc DESC, audit_id DESC""",
)
def _(spark, sf):
    found = versions.audit_search(fx.audit(spark, sf), since="2024-01-05 00:00:00", operation="EXPORT_DOWNLOAD")
    return found.select("audit_id", "actor", "entity_id", "correlation_id", "occurred_at_utc")


@query(
    "retention_due",
    "SELECT export_artifact_id, file_name, expires_at_utc FROM artifacts WHERE expires_at_utc <= TIMESTAMP '1998-06-01 00:00:00'",
)
def _(spark, sf):
    due = versions.retention_due(fx.artifacts(spark, sf), "1998-06-01 00:00:00")
    return due.select("export_artifact_id", "file_name", "expires_at_utc")
