"""File identity, detection and input-set checks over the receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dielens.operators import ingest
from dielens.plans import fixtures as fx
from dielens.plans.inline import inline
from dielens.plans.registry import query


@query(
    "content_identity",
    "SELECT sha256, min(received_at_utc) AS first_seen_utc, count(*) AS n_receipts FROM receipts GROUP BY sha256",
)
def _(spark, sf):
    return ingest.content_identity(fx.receipts(spark, sf))


@query(
    "receipt_dedup",
    """SELECT receipt_id, import_batch_id, sha256, received_at_utc,
 row_number() OVER (PARTITION BY sha256 ORDER BY received_at_utc, receipt_id) > 1 AS is_duplicate_receipt FROM receipts""",
)
def _(spark, sf):
    marked = ingest.receipt_dedup(fx.receipts(spark, sf))
    return marked.select("receipt_id", "import_batch_id", "sha256", "received_at_utc", "is_duplicate_receipt")


@query(
    "pending_files",
    """WITH done AS (SELECT DISTINCT sha256 FROM receipts WHERE received_at_utc < TIMESTAMP '2024-01-01 04:00:00')
SELECT DISTINCT sha256, 'NEW' AS trigger FROM receipts WHERE sha256 NOT IN (SELECT sha256 FROM done)
UNION ALL SELECT DISTINCT sha256, 'FORCED' AS trigger FROM receipts WHERE forced AND length(trim(reason)) > 0
 AND sha256 IN (SELECT sha256 FROM done)""",
)
def _(spark, sf):
    receipts = fx.receipts(spark, sf).drop("content")
    early = F.col("received_at_utc") < F.lit("2024-01-01 04:00:00").cast("timestamp_ntz")
    done = receipts.where(early).select("sha256").distinct()
    contents = receipts.select("sha256").distinct()
    return ingest.pending_files(contents, done, receipts.where("forced"))


@query("detect_format", "SELECT receipt_id, detection_status, n_candidates, candidates FROM detected")
def _(spark, sf):
    found = ingest.detect_format(fx.receipts(spark, sf), inline(spark, "profiles"))
    return found.select("receipt_id", "detection_status", "n_candidates", "candidates")


@query(
    "check_file_roles",
    """WITH counts AS (SELECT import_batch_id, file_role, count(*) AS n FROM receipts GROUP BY 1, 2),
roles AS (SELECT file_role, required, max_files FROM contracts)
SELECT b.import_batch_id, r.file_role, 'MISSING_ROLE' AS problem FROM (SELECT DISTINCT import_batch_id FROM receipts) b
 CROSS JOIN roles r WHERE r.required AND NOT EXISTS (SELECT 1 FROM counts c WHERE c.import_batch_id = b.import_batch_id
 AND c.file_role = r.file_role)
UNION ALL SELECT c.import_batch_id, c.file_role, 'TOO_MANY_FILES' FROM counts c JOIN roles r ON r.file_role = c.file_role
 AND c.n > r.max_files
UNION ALL SELECT import_batch_id, min(file_role), 'REPEATED_ORDINAL' FROM receipts GROUP BY import_batch_id, ordinal_no HAVING count(*) > 1
UNION ALL SELECT import_batch_id, file_role, 'REPEATED_MEMBER' FROM receipts GROUP BY import_batch_id, receipt_id, file_role HAVING count(*) > 1""",
)
def _(spark, sf):
    members = fx.receipts(spark, sf).drop("content", "sha256")
    return ingest.check_file_roles(members, inline(spark, "contracts"))


_CONFLICTS = """WITH m AS (SELECT r.import_batch_id, CASE WHEN d.detection_status = 'DETECTED' THEN d.candidates END AS profile,
  r.product_code, r.unit_contract FROM receipts r JOIN detected d ON d.receipt_id = r.receipt_id),
v AS (SELECT import_batch_id, 'PROFILE' AS kind, profile AS value FROM m UNION ALL SELECT import_batch_id, 'PRODUCT', product_code FROM m
 UNION ALL SELECT import_batch_id, 'UNIT_CONTRACT', unit_contract FROM m)
SELECT import_batch_id, kind, count(DISTINCT value) AS n_values, min(value) AS least, max(value) AS greatest FROM v
GROUP BY 1, 2 HAVING count(DISTINCT value) > 1"""


@query("check_input_set_conflicts", _CONFLICTS)
def _(spark, sf):
    return conflicts(spark, sf)


def conflicts(spark, sf):
    found = ingest.detect_format(fx.receipts(spark, sf), inline(spark, "profiles"))
    members = found.withColumn("profile", F.when(F.col("detection_status") == "DETECTED", F.col("candidates")))
    kinds = {"PROFILE": "profile", "PRODUCT": "product_code", "UNIT_CONTRACT": "unit_contract"}
    return ingest.check_input_set_conflicts(members, kinds)
