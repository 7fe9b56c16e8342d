"""The query surface: one normalised filter, pages, facets, views and drill-down."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from dielens.functions.columns import measured, ntz, share
from dielens.functions.packed import packed_join
from dielens.functions.shuffles import exact_quantiles, join_sized
from dielens.session import scratch_folder

# What each filter name selects on, and the page sizes on offer.
FILTER_COLUMNS = {
    "lot": "lot_id",
    "wafer": "wafer_id",
    "parameter": "parameter_code",
    "bin": "soft_bin",
    "hard_bin": "hard_bin",
    "result": "overall_result",
    "outcome": "outcome",
    "site": "site_no",
    "program": "program_version_id",
    "product": "product_code",
    "supplier": "supplier_id",
    "tester": "tester_id",
    "condition": "condition_json",
}
PAGE_SIZES = (100, 200, 500, 1000)


def normalized_filter(flt: dict[str, Sequence]) -> str:
    """Sorted keys, sorted distinct values, no empty lists; equal selections give equal text."""
    kept = {}
    for name, values in flt.items():
        if name == "time":
            kept[name] = [None if v is None else str(v) for v in values]
        elif values:
            kept[name] = sorted({str(v) for v in values})
    return json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def apply_global_filter(df: DataFrame, flt: dict[str, Sequence], time_column: str = "tested_at_utc") -> DataFrame:
    """The rows a user selected.  An empty list means all; an unknown filter name is refused.

    A list is pushed to the scan; Spark turns a long one into a set.
    ``time`` is a pair of bounds, the second exclusive.
    """
    out = df
    for name, values in flt.items():
        if name == "time":
            since, until = values
            if since is not None:
                out = out.where(F.col(time_column) >= ntz(since))
            if until is not None:
                out = out.where(F.col(time_column) < ntz(until))
            continue
        column = FILTER_COLUMNS.get(name)
        if column is None or column not in df.columns:
            raise ValueError(f"no filter {name!r} on this data")
        if not values:
            continue
        out = out.where(F.col(column).isin(list(values)))
    return out


def filter_summary(df: DataFrame, flt: dict[str, Sequence], dataset_version: str) -> DataFrame:
    """The normalised filter, its hash and what it leaves of the data."""
    text = normalized_filter(flt)
    left = apply_global_filter(df, flt)
    return left.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("unit_id").alias("n_units"),
        F.countDistinct("lot_id").alias("n_lots"),
    ).withColumns(
        {
            "dataset_version_id": F.lit(dataset_version),
            "filter_json": F.lit(text),
            "filter_hash": F.lit(hashlib.sha256(text.encode()).hexdigest()),
        }
    )


def facet_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Available values of several columns with their counts, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def _ordered(sort: Sequence[str], tie: str) -> list[Column]:
    names = [*sort, *([] if tie in [s.lstrip("-") for s in sort] else [tie])]
    return [F.desc_nulls_last(n[1:]) if n.startswith("-") else F.asc_nulls_first(n) for n in names]


def page(
    df: DataFrame, sort: Sequence[str], page: int, size: int = 200, tie: str = "unit_id", after: Column | None = None
) -> DataFrame:
    """One page (from 1) in a total order, with the filtered total on every row.

    ``-name`` sorts descending.  Only offset + size rows leave each task; for
    pages far down give ``after``, a condition on the sort columns that starts
    the page there, so that nothing before it is ordered again.
    """
    if size not in PAGE_SIZES:
        raise ValueError(f"page size must be one of {PAGE_SIZES}")
    if page < 1:
        raise ValueError("pages count from 1")
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df if after is None else df.where(after)
    kept = rows.orderBy(*_ordered(sort, tie)).offset((page - 1) * size).limit(size)
    return kept.withColumns({"page": F.lit(page), "page_size": F.lit(size), "total": total})


class PageIndex:
    """Rows of one pinned version in page order, cut into ranges with their counts.

    Built once for a (version, filter, order); a page reads only the one or two ranges its rows lie in, however far down
    it is, and orders only those.  The total belongs to the same rows.
    """

    def __init__(self, df: DataFrame, sort: Sequence[str], tie: str = "unit_id", ranges: int | None = None):
        self.order, self.columns = _ordered(sort, tie), df.columns
        ranged = df.repartitionByRange(ranges, *self.order) if ranges else df.repartitionByRange(*self.order)
        path = scratch_folder(df.sparkSession, "pages")
        ranged.withColumn("__range", F.spark_partition_id()).write.partitionBy("__range").parquet(path)
        schema = StructType([*df.schema.fields, StructField("__range", IntegerType())])
        self.rows = df.sparkSession.read.schema(schema).parquet(path)
        # one count for each range; file footers answer it
        counts = sorted(map(tuple, self.rows.groupBy("__range").count().collect()))
        self.total, self.starts = 0, []
        for number, n in counts:
            self.starts.append((number, self.total, n))
            self.total += n

    def page(self, page: int, size: int = 200) -> DataFrame:
        """One page (from 1) with the total on every row; past the end it is empty."""
        if size not in PAGE_SIZES:
            raise ValueError(f"page size must be one of {PAGE_SIZES}")
        if page < 1:
            raise ValueError("pages count from 1")
        begin = (page - 1) * size
        touched = [(r, start) for r, start, n in self.starts if start < begin + size and begin < start + n]
        skip = begin - touched[0][1] if touched else 0
        rows = self.rows.where(F.col("__range").isin([r for r, _ in touched])).select(*self.columns)
        kept = rows.orderBy(*self.order).offset(skip).limit(size)
        return kept.withColumns(
            {"page": F.lit(page), "page_size": F.lit(size), "total": F.lit(self.total).cast("long")}
        )


def top_k(df: DataFrame, by: Sequence[str], k: int, tie: str) -> DataFrame:
    return df.orderBy(*_ordered(by, tie)).limit(k)


def grid_schema(meas: DataFrame) -> DataFrame:
    """Column metadata of a version's wide grid: what a client may ask for."""
    found = meas.groupBy("parameter_code", "unit_raw").agg(
        F.min("sequence_no").alias("sequence_no"), F.max(measured()).alias("has_values")
    )
    label = F.concat(F.col("parameter_code"), F.lit(" ["), F.coalesce("unit_raw", F.lit("-")), F.lit("]"))
    return found.select(
        F.lower("parameter_code").alias("key"),
        label.alias("label"),
        F.col("unit_raw").alias("unit"),
        F.when(F.col("has_values"), "number").otherwise("text").alias("type"),
        "sequence_no",
    )


def measurement_long_view(evals: DataFrame) -> DataFrame:
    """Unit, test number, parameter, value, unit, status, applied spec and evaluation."""
    return evals.select(
        "unit_id",
        F.col("sequence_no").alias("test_no"),
        "parameter_code",
        "value_numeric",
        F.col("unit_raw").alias("unit"),
        "measurement_status",
        "lsl_applied",
        "usl_applied",
        "evaluation_result",
    )


def unit_wide_view(units: DataFrame, meas: DataFrame, params: Sequence[str]) -> DataFrame:
    """Unit identity and only the selected parameters as columns; the list comes from the grid schema."""
    listed = meas.where(F.col("parameter_code").isin(list(params)) & measured())
    wide = listed.groupBy("unit_id").agg(
        *[F.max(F.when(F.col("parameter_code") == p, F.col("value_numeric"))).alias(p.lower()) for p in params]
    )
    identity = units.select("unit_id", "x_coord", "y_coord", "soft_bin", "overall_result")
    return identity.join(wide, "unit_id", "left")


def unit_detail(units: DataFrame, evals: DataFrame, logical_unit: str | None = None) -> DataFrame:
    """All attempts of one die (or of every die) with values, evaluations and source position."""
    if logical_unit is not None:
        units = units.where(F.col("logical_unit_key") == logical_unit)
        evals = evals.where(F.col("logical_unit_key") == logical_unit)
    values = evals.select(
        "unit_id",
        "parameter_code",
        "raw_value",
        "value_numeric",
        "measurement_status",
        "evaluation_result",
        "source_column_index",
    )
    attempts = units.select("logical_unit_key", "unit_id", "run_id", "attempt_no", "unit_sequence", "soft_bin")
    return packed_join(attempts, values, "unit_id")


def drill_to_source(evals: DataFrame, runs: DataFrame, receipts: DataFrame) -> DataFrame:
    """From a conclusion back to the measurement, rule, run, receipt and file hash."""
    chain = runs.join(receipts, "receipt_id", "left").select(
        "run_id", "processing_run_id", "receipt_id", "original_file_name", "sha256"
    )
    conclusions = evals.select(
        "measurement_id", "evaluation_result", "spec_binding_id", "spec_item_id", "raw_value", "source_column_index", "run_id"
    )
    return join_sized(conclusions, chain, ["run_id"], "left", null_safe=False)


def overview(units: DataFrame, issues: DataFrame, risks: DataFrame, dataset_version: str) -> DataFrame:
    """One row: totals, yield, open data-quality findings by severity and parameters at risk."""
    n = F.count(F.lit(1))
    passed = F.count_if(F.col("outcome") == "PASS")
    open_ = F.col("resolution_status") == "OPEN"
    counts = issues.agg(
        F.struct(
            *[F.count_if(open_ & (F.col("severity") == s)).alias(s.lower()) for s in ("BLOCKER", "ERROR", "WARNING")]
        )
    ).scalar()
    return units.agg(
        F.lit(dataset_version).alias("dataset_version_id"),
        n.alias("total"),
        passed.alias("n_pass"),
        F.count_if(F.col("outcome") == "FAIL").alias("n_fail"),
        share(passed, n).alias("yield"),
    ).withColumns(
        {
            **{f"open_{s}": counts[s] for s in ("blocker", "error", "warning")},
            "n_risks": risks.agg(F.count(F.lit(1))).scalar(),
        }
    )


def capacity_report(meas: DataFrame, runs: DataFrame) -> DataFrame:
    """Measurement rows per stage and month, growth, running total, and the p95 duration of the month's batches."""
    month = F.date_trunc("month", "tested_at_utc").cast("timestamp_ntz")
    rows = meas.groupBy("test_stage", month.alias("month")).agg(F.count(F.lit(1)).alias("measurement_rows"))
    along = Window.partitionBy("test_stage").orderBy("month")
    grown = rows.withColumns(
        {
            "growth": F.col("measurement_rows") - F.lag("measurement_rows").over(along),
            "total_rows": F.sum("measurement_rows").over(along.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    minutes = (F.unix_seconds(F.col("finished_at_utc").cast("timestamp")) - F.unix_seconds(F.col("started_at_utc").cast("timestamp"))) / 60
    timed = runs.select(
        "test_stage", F.date_trunc("month", "started_at_utc").cast("timestamp_ntz").alias("month"), minutes.alias("minutes")
    )
    p95 = exact_quantiles(timed, ["test_stage", "month"], "minutes", {"p95_minutes": 0.95}).withColumnRenamed("n", "n_runs")
    return grown.join(p95, ["test_stage", "month"], "left")
