"""File identity, duplicate arrivals, format detection and input-set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_identity(receipts: DataFrame) -> DataFrame:
    """One row per content hash, however often it arrived."""
    return receipts.groupBy("sha256").agg(
        F.min("received_at_utc").alias("first_seen_utc"), F.count(F.lit(1)).alias("n_receipts")
    )


def receipt_dedup(receipts: DataFrame) -> DataFrame:
    """Marks all but the first arrival of a content.

    The first arrival per hash is a mergeable minimum; it is joined back on the
    receipt id, so a content sent very often does not become a hot join key.
    """
    first = (
        receipts.groupBy("sha256")
        .agg(F.min(F.struct("received_at_utc", "receipt_id"))["receipt_id"].alias("receipt_id"))
        .select("receipt_id", F.lit(False).alias("is_duplicate_receipt"))
    )
    return receipts.join(first, "receipt_id", "left").fillna(True, ["is_duplicate_receipt"])


def pending_files(contents: DataFrame, runs: DataFrame, forced: DataFrame) -> DataFrame:
    """Contents to process: never processed ones, and forced ones that give a reason."""
    new = contents.join(runs.select("sha256"), "sha256", "left_anti").select(
        "sha256", F.lit("NEW").alias("trigger")
    )
    again = (
        forced.where(F.length(F.trim("reason")) > 0)
        .select("sha256", F.lit("FORCED").alias("trigger"))
        .join(runs.select("sha256"), "sha256", "left_semi")
        .distinct()
    )
    return new.unionByName(again)


def detect_format(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """Candidates among the released profiles; only a single match is a detection.

    The profiles are one array beside every file text, however many there are, so
    the texts are read once and never joined; two profiles of one name are two.
    """
    released = profiles.where("status = 'RELEASED'").select(
        F.struct(F.concat_ws(" ", "format_code", "profile_version").alias("candidate"), "signature").alias("p")
    )
    known = released.agg(F.array_sort(F.collect_list("p"))).scalar()
    hits = F.filter("__known", lambda p: F.coalesce(F.rlike(F.col("content"), p["signature"]), F.lit(False)))
    listed = files.withColumn("__known", known).withColumn("__found", F.transform(hits, lambda p: p["candidate"]))
    listed = listed.drop("__known")
    n = F.size("__found")
    return (
        listed.withColumns(
            {
                "n_candidates": n,
                "candidates": F.array_join("__found", ","),
                "detection_status": F.when(n == 1, "DETECTED").when(n == 0, "UNKNOWN").otherwise("NEEDS_CONFIRMATION"),
            }
        )
        .drop("__found")
    )


def check_file_roles(members: DataFrame, contracts: DataFrame) -> DataFrame:
    """Missing required roles, too many files in a role, and repeated ordinals or members.

    Counts per (batch, role) are taken first, so a large input set stays small
    in everything that follows.
    """
    counts = members.groupBy("import_batch_id", "file_role").agg(F.count(F.lit(1)).alias("n"))
    batches = counts.select("import_batch_id").distinct()
    required = contracts.where("required").agg(F.collect_set("file_role")).scalar()
    expected = batches.select("import_batch_id", F.explode(required).alias("file_role"))
    missing = expected.join(counts, ["import_batch_id", "file_role"], "left_anti").select(
        "import_batch_id", "file_role", F.lit("MISSING_ROLE").alias("problem")
    )
    limited = counts.join(contracts.select("file_role", "max_files"), "file_role")
    many = limited.where("n > max_files").select(
        "import_batch_id", "file_role", F.lit("TOO_MANY_FILES").alias("problem")
    )
    ordinals = (
        members.groupBy("import_batch_id", "ordinal_no")
        .agg(F.count(F.lit(1)).alias("n"), F.min("file_role").alias("file_role"))
        .where("n > 1")
        .select("import_batch_id", "file_role", F.lit("REPEATED_ORDINAL").alias("problem"))
    )
    repeated = (
        members.groupBy("import_batch_id", "receipt_id", "file_role")
        .count()
        .where("count > 1")
        .select("import_batch_id", "file_role", F.lit("REPEATED_MEMBER").alias("problem"))
    )
    return missing.unionByName(many).unionByName(ordinals).unionByName(repeated)


def check_input_set_conflicts(members: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Input sets with more than one profile, product or unit contract; the whole set is refused.

    ``kinds`` maps the kind of conflict to the column.  Distinct values are
    found per (batch, kind, value) before they are counted.
    """
    pairs = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in kinds.items()]
    )
    values = (
        members.select("import_batch_id", F.inline(pairs)).where("value IS NOT NULL").distinct()
    )
    return (
        values.groupBy("import_batch_id", "kind")
        .agg(F.count(F.lit(1)).alias("n_values"), F.min("value").alias("least"), F.max("value").alias("greatest"))
        .where("n_values > 1")
    )
