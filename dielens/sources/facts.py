"""Canonical tables as Parquet, partitioned by stage and month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dielens.functions.packed import packable, packed, unpacked

PARTITIONS = ("stage", "tested_month")


def append_facts(
    df: DataFrame,
    root: str,
    table: str,
    stage: str = "test_stage",
    instant: str = "tested_at_utc",
    cluster: Sequence[str] = ("lot_id",),
    rows_per_file: int = 20_000_000,
) -> None:
    """Append rows to a canonical table; nothing already there is touched.

    Rows are dealt by partition and lot, so a file holds few lots and the scan
    can skip its row groups.  The rows are computed once: sizes are not sampled
    before but known when the rows have been dealt, and AQE then joins small
    lots in one task and splits a month or lot of any size among many.  They
    are dealt as packed columns and written with zstandard, since both the
    exchange and the table hold every column of every fact.
    """
    placed = df.withColumns(
        {"stage": F.col(stage), "tested_month": F.date_format(instant, "yyyy-MM")}
    )
    spread = [c for c in (*PARTITIONS, *cluster) if c in placed.columns]
    order = [c for c in (*PARTITIONS, *cluster, "test_item_id") if c in placed.columns]
    if packable(placed, spread):
        dealt = unpacked(packed(placed, spread, placed.columns).hint("rebalance", *spread), placed.schema)
    else:
        dealt = placed.hint("rebalance", *spread)
    (
        dealt.sortWithinPartitions(*order)
        .write.mode("append")
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "zstd")
        .partitionBy(*PARTITIONS)
        .parquet(f"{root.rstrip('/')}/{table}")
    )


def scan_canonical(
    spark: SparkSession,
    root: str,
    table: str,
    stage: str | None = None,
    months: Sequence[str] | None = None,
    lots: Sequence[str] | None = None,
) -> DataFrame:
    """A canonical table; stage and months prune folders, lots are pushed to the files."""
    rows = spark.read.parquet(f"{root.rstrip('/')}/{table}")
    rows = rows.withColumn("tested_month", F.col("tested_month").cast("string"))
    if stage is not None:
        rows = rows.where(F.col("stage") == stage)
    if months is not None:
        rows = rows.where(F.col("tested_month").isin(list(months)))
    if lots is not None:
        rows = rows.where(F.col("lot_id").isin(list(lots)))
    return rows.drop(*PARTITIONS)
