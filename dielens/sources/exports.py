"""Delivery sets and exports, each pinned to a dataset version and a filter.

Every ``*_rows`` function gives the content as a DataFrame; the writers put it
into files in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dielens.functions.columns import measured, ntz, share


def compat_cleaned_rows(units: DataFrame, meas: DataFrame, params: Sequence[str], template: str) -> DataFrame:
    """Lot, wafer, position, sequence, bin and the listed parameters, one row per unit."""
    listed = meas.where(measured() & F.col("parameter_code").isin(list(params)))
    wide = listed.groupBy("unit_id").agg(
        *[F.max(F.when(F.col("parameter_code") == p, F.col("value_numeric"))).alias(p) for p in params]
    )
    identity = units.select("unit_id", "lot_id", "wafer_id", "x_coord", "y_coord", "unit_sequence", "soft_bin")
    return identity.join(wide, "unit_id", "left").withColumn("template_version", F.lit(template))


def compat_yield_rows(units: DataFrame, template: str) -> DataFrame:
    """One row per wafer with totals and yield."""
    n, passed = F.count(F.lit(1)), F.count_if(F.col("outcome") == "PASS")
    return units.groupBy("lot_id", "wafer_id").agg(
        n.alias("total"), passed.alias("n_pass"), share(passed, n).alias("yield")
    ).withColumn("template_version", F.lit(template))


def compat_spec_rows(limited: DataFrame, template: str) -> DataFrame:
    """The limits that really applied, with unit and lot scope."""
    return limited.select(
        "lot_id", "parameter_code", F.col("unit_raw").alias("unit"), "limit_source", "lsl_applied", "usl_applied"
    ).distinct().withColumn("template_version", F.lit(template))


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)


def write_compat_cleaned(units: DataFrame, meas: DataFrame, params: Sequence[str], path: str, template: str) -> None:
    _csv(compat_cleaned_rows(units, meas, params, template), path)


def write_compat_yield(units: DataFrame, path: str, template: str) -> None:
    _csv(compat_yield_rows(units, template), path)


def write_compat_spec(limited: DataFrame, path: str, template: str) -> None:
    _csv(compat_spec_rows(limited, template), path)


def write_sheet(limits: DataFrame, path: str) -> None:
    """PAT or SYL/SBL sheet of an already computed limit table."""
    _csv(limits, path)


def export_csv(df: DataFrame, job: dict, path: str) -> None:
    """A filtered export; the job pins version, filter hash and template, which stay on every row."""
    needed = ("dataset_version_id", "filter_hash", "template_version")
    missing = [k for k in needed if not job.get(k)]
    if missing:
        raise ValueError(f"export job without {missing}")
    _csv(df.withColumns({k: F.lit(job[k]) for k in needed}), path)


def bin_txt_lines(die_map: DataFrame, width: int = 3, blank: str = ".") -> DataFrame:
    """One text line per die row of a wafer map, bins padded to columns.

    A line holds one die per column of the wafer, which the wafer's size bounds.
    Columns of the wafer without a die in the row show the blank sign, and a
    position with contradicting bins shows a question mark.
    """
    keys = ["lot_id", "wafer_id"]
    positions = die_map.groupBy(*keys, "y_coord", "x_coord").agg(
        F.when(F.min("soft_bin") == F.max("soft_bin"), F.min("soft_bin")).otherwise("?").alias("__bin")
    )
    edges = positions.groupBy(*keys).agg(F.min("x_coord").alias("__x0"), F.max("x_coord").alias("__x1"))
    cells = positions.groupBy(*keys, "y_coord").agg(
        F.map_from_entries(F.collect_list(F.struct("x_coord", "__bin"))).alias("__row")
    )
    placed = cells.join(edges, keys)
    signs = F.transform(
        F.sequence("__x0", "__x1"),
        lambda x: F.lpad(F.coalesce(F.element_at(F.col("__row"), x), F.lit(blank)), width, " "),
    )
    return placed.select(*keys, "y_coord", F.array_join(signs, "").alias("line"))


def export_bin_txt(die_map: DataFrame, path: str) -> None:
    """Text files by wafer; the lines of a wafer are together and in die-row order."""
    lines = bin_txt_lines(die_map)
    ordered = lines.repartition("lot_id", "wafer_id").sortWithinPartitions("lot_id", "wafer_id", "y_coord")
    ordered.select("lot_id", "wafer_id", "line").write.mode("errorifexists").partitionBy("lot_id", "wafer_id").text(path)


def export_artifact_manifest(spark: SparkSession, path: str, job: dict) -> DataFrame:
    """Name, size, SHA-256 and expiry of every file an export wrote."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    )
    return found.select(
        F.regexp_extract("path", "[^/]+$", 0).alias("file_name"),
        F.col("length").alias("file_size"),
        F.sha2("content", 256).alias("sha256"),
        F.lit(job["export_job_id"]).alias("export_job_id"),
        ntz(job["expires_at_utc"]).alias("expires_at_utc"),
    )
