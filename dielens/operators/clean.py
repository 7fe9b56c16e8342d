"""Cleaning and normalisation: from vendor rows to canonical facts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dielens.functions.columns import in_window
from dielens.functions.packed import by_part, codes, packable, part_of, row_numbers, whole
from dielens.functions.shuffles import join_sized, ordering
from dielens.operators.rules import slotted

CLEANERS: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {}


def register_cleaner(profile: str, version: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Attach the cleaning function of a format profile version.

    ``fn`` takes and returns a DataFrame.  A released version never changes.
    """
    if (profile, version) in CLEANERS:
        raise ValueError(f"{profile} {version} is already registered")
    CLEANERS[profile, version] = fn


def clean(raw: DataFrame, profile: str, version: str) -> DataFrame:
    try:
        fn = CLEANERS[profile, version]
    except KeyError:
        raise ValueError(f"no cleaner for {profile} {version}") from None
    return fn(raw)


def extract_test_items(raw: DataFrame, profile: dict) -> DataFrame:
    """Header rows of a file to one row per test item.

    ``raw`` has source_file, source_row_no and cells (array of text).  The
    profile names the row numbers of name, unit, lower and upper limit and the
    first item column (0-based).  The header rows of a file are brought
    together as they are, before their cells are taken apart, so what a task
    sorts is bounded by the size of a shuffle partition and not by that of an
    input split; the aggregation by (file, column) needs no other exchange.
    """
    rows = {
        "raw_item_name": profile["name_row"],
        "unit_raw": profile["unit_row"],
        "lower_limit_raw": profile["lower_row"],
        "upper_limit_raw": profile["upper_row"],
    }
    header = raw.where(F.col("source_row_no").isin(*rows.values()))
    cells = header.repartition("source_file").select(
        "source_file", "source_row_no", F.posexplode("cells").alias("source_column_index", "cell")
    ).where(F.col("source_column_index") >= profile["first_item_column"])
    items = cells.groupBy("source_file", "source_column_index").agg(
        *[
            F.max(F.when(F.col("source_row_no") == no, F.trim("cell"))).alias(name)
            for name, no in rows.items()
        ]
    )
    sequence = F.col("source_column_index") - profile["first_item_column"] + 1
    return items.where("raw_item_name <> ''").withColumn("sequence_no", sequence)


# A decimal number, and a limit: an optional comparison sign, then a number and nothing else.
_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_LIMIT = rf"^\s*(>=|<=|>|<)?\s*({_NUMBER})\s*$"


def parse_limits(items: DataFrame) -> DataFrame:
    """Raw limit texts to value and operator per side; the raw texts stay."""
    columns = {}
    for side, value in (("lower", "program_lsl"), ("upper", "program_usl")):
        raw = F.col(f"{side}_limit_raw")
        sign = F.regexp_extract(raw, _LIMIT, 1)
        columns[value] = F.regexp_extract(raw, _LIMIT, 2).try_cast("double")
        columns[f"{side}_operator"] = F.when(sign != "", sign)
    return items.withColumns(columns)


def unpivot_measurements(wide: DataFrame, id_cols: Sequence[str], item_cols: dict[str, int]) -> DataFrame:
    """Wide unit rows to one row per unit and item; no shuffle."""
    as_text = wide.select(*id_cols, *[F.col(c).cast("string").alias(c) for c in item_cols])
    ids = F.create_map(*[F.lit(x) for pair in item_cols.items() for x in pair])
    long = as_text.unpivot(list(id_cols), list(item_cols), "source_column", "raw_value")
    return long.withColumn("test_item_id", ids[F.col("source_column")].cast("long"))


def parse_measurement_value(long: DataFrame) -> DataFrame:
    """Raw text to number, text and status; blank is MISSING, unreadable is INVALID."""
    # text, number and status are columns of their own first, so that a value is matched and cast once
    number = F.when(F.col("__text").rlike(f"^{_NUMBER}$"), F.col("__text").try_cast("double"))
    read = long.withColumn("__text", F.trim("raw_value")).withColumn("__number", number)
    text, number = F.col("__text"), F.col("__number")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    word = F.upper(text)
    status = (
        F.when(text.isNull() | (text == ""), "MISSING")
        .when(word == "OVER", "OVER_RANGE")
        .when(word == "UNDER", "UNDER_RANGE")
        .when(word.isin("N/A", "NA"), "NOT_APPLICABLE")
        .when(finite, "MEASURED")
        .otherwise("INVALID")
    )
    judged = read.withColumn("__status", status)
    status = F.col("__status")
    return judged.withColumns(
        {
            "value_numeric": F.when(status == "MEASURED", number),
            "value_text": F.when(~status.isin("MEASURED", "MISSING"), text),
            "measurement_status": status,
        }
    ).drop("__text", "__number", "__status")


def mark_not_tested(long: DataFrame) -> DataFrame:
    """A blank after the unit's first failing step was not tested; a blank before it is missing.

    The window covers the items of one unit, which the program bounds.
    """
    earlier = (
        Window.partitionBy("unit_id")
        .orderBy("sequence_no")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    failed_before = F.coalesce(F.max((~F.col("tester_pass_flag")).cast("int")).over(earlier), F.lit(0))
    status = F.when(
        (F.col("measurement_status") == "MISSING") & (failed_before == 1), "NOT_TESTED"
    ).otherwise(F.col("measurement_status"))
    return long.withColumn("measurement_status", status)


def normalize_units(long: DataFrame, factors: DataFrame) -> DataFrame:
    """Value in the canonical unit; an unknown unit gives no value and ``unit_ok`` false."""
    joined = long.join(factors, "unit_raw", "left")
    return joined.withColumns(
        {
            "value_si": F.col("value_numeric") * F.col("factor"),
            "unit_ok": F.col("factor").isNotNull(),
        }
    ).drop("factor")


def map_product_alias(df: DataFrame, aliases: DataFrame, alias_type: str) -> DataFrame:
    """Vendor product name to product, by supplier, active aliases only."""
    known = aliases.where("active").where(F.col("alias_type") == alias_type)
    return df.join(known.drop("active", "alias_type"), ["supplier_id", "alias_value"], "left")


def map_program_version(df: DataFrame, versions: DataFrame, event_time: str) -> DataFrame:
    """The program version valid at the event time (half-open windows), and whether it is the only one.

    Programs and time slots are few and are resolved once; versions whose windows
    overlap are CONFIG_AMBIGUOUS and never multiply a row.
    """
    windows = versions.withColumnsRenamed(
        {"program_code": "__code", "valid_from_utc": "effective_from_utc", "valid_to_utc": "effective_to_utc"}
    )
    timed = slotted(df, event_time, windows)
    contexts = timed.groupBy("program_code", "__slot").agg(F.min(event_time).alias("__at"))
    on = (F.col("program_code") == F.col("__code")) & in_window(
        F.col("__at"), F.col("effective_from_utc"), F.col("effective_to_utc")
    )
    found = contexts.join(windows, on).groupBy("program_code", "__slot").agg(
        F.count(F.lit(1)).alias("__n"), F.max(F.struct("program_version_id", "version_code")).alias("__v")
    )
    n = F.coalesce("__n", F.lit(0))
    return join_sized(timed, found, ["program_code", "__slot"], "left").withColumns(
        {
            "program_version_id": F.when(n == 1, F.col("__v.program_version_id")),
            "version_code": F.when(n == 1, F.col("__v.version_code")),
            "version_status": F.when(n == 0, "NO_MATCH").when(n == 1, "MATCHED").otherwise("CONFIG_AMBIGUOUS"),
        }
    ).drop("__slot", "__n", "__v")


def parameter_identity(items: DataFrame, program: Sequence[str]) -> DataFrame:
    """A composite parameter key, so that equal display names do not collide.

    ``occurrence`` counts repeats of a code within one program, whose item list
    is short.
    """
    repeat = Window.partitionBy(*program, "parameter_code").orderBy("sequence_no")
    numbered_items = items.withColumn("occurrence", F.row_number().over(repeat))
    parts = (
        "parameter_code",
        "occurrence",
        "bias_polarity",
        "bias_value",
        "bias_unit",
        "unit_raw",
        "test_condition",
        "source_item",
    )
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return numbered_items.withColumn("parameter_key", F.sha2(text, 256))


def logical_unit_key(units: DataFrame, stage: str) -> DataFrame:
    """The key that repeats when a die or unit is tested again, and how far it can be trusted.

    Without a complete position or serial number the key is the first id of the
    row that is there: vendor id, sequence, source row, unit id.  Each kind has
    its own prefix, so units never share a key by accident; a row without any
    id is a unit of its own (NONE).
    """
    if stage == "CP":
        parts = ["product_code", "lot_id", "wafer_id", "x_coord", "y_coord"]
    else:
        parts = ["product_code", "lot_id", "serial_no"]
    complete = F.lit(True)
    for p in parts:
        complete = complete & F.col(p).isNotNull()
    stable = F.concat_ws("|", F.lit(stage), *parts)
    kinds = {"vendor_unit_id": "VENDOR", "unit_sequence": "SEQ", "source_row_no": "ROW", "unit_id": "UNIT"}
    known = [
        F.when(F.col(c).isNotNull(), F.concat_ws("|", F.lit(stage), F.lit(kind), "run_id", F.col(c).cast("string")))
        for c, kind in kinds.items()
        if c in units.columns
    ]
    if not known:
        raise ValueError(f"units need one of {', '.join(kinds)} where position or serial number may be missing")
    row = F.concat_ws("|", F.lit(stage), F.lit("NONE"), F.monotonically_increasing_id().cast("string"))
    fallback = F.coalesce(*known)
    return units.withColumns(
        {
            "logical_unit_key": F.when(complete, stable).otherwise(F.coalesce(fallback, row)),
            "key_quality": F.when(complete, "STABLE").when(fallback.isNotNull(), "FALLBACK").otherwise("NONE"),
        }
    )


def assign_attempt_no(units: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Attempt index (from 0) per logical unit inside a run, in source order.

    ``keys`` name one unit of one session, which is tested a few times at most.  With an order given by names
    (``-name`` descends) the units travel as packed columns.
    """
    by, named = ordering(order)
    window = Window.partitionBy(*keys).orderBy(*by)
    plain = units.withColumn("attempt_no", (F.row_number().over(window) - 1).cast("long"))
    if not (named and packable(units, keys) and all(o.lstrip("-") in units.columns for o in order)):
        return plain

    def number(tables):
        table = pa.concat_tables(list(tables))
        key, _ = codes([whole(table, c) for c in keys])
        yield table.append_column("attempt_no", pa.array(row_numbers(table, key, order) - 1))

    return by_part([(units, part_of(units, *[F.col(c) for c in keys]))], number, plain.schema)


def resolve_timezone(runs: DataFrame, local: str = "source_started_local") -> DataFrame:
    """Source-local time to UTC: explicit zone, supplier default, file rule, else unknown and no UTC time."""
    zone = F.coalesce("explicit_zone", "supplier_zone", "file_zone")
    how = (
        F.when(F.col("explicit_zone").isNotNull(), "SOURCE_EXPLICIT")
        .when(F.col("supplier_zone").isNotNull(), "SUPPLIER_DEFAULT")
        .when(F.col("file_zone").isNotNull(), "FILE_RULE")
        .otherwise("UNKNOWN")
    )
    utc = F.convert_timezone(zone, F.lit("UTC"), F.col(local))
    offset = (F.unix_seconds(F.col(local).cast("timestamp")) - F.unix_seconds(utc.cast("timestamp"))) / 60
    return runs.withColumns(
        {
            "source_timezone_iana": zone,
            "timezone_resolution": how,
            "started_at_utc": utc,
            "source_utc_offset_minutes": offset.cast("int"),
        }
    )


def surrogate_key(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """A deterministic id of a natural key, equal on every rerun: SHA-256 of its parts, each with its length, so that
    neither long tables nor parts that run into each other make two keys one.
    """
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in cols]
    return df.withColumn(name, F.sha2(F.concat_ws("|", *parts), 256))


def extract_conditions(df: DataFrame, schema: StructType | str, json: str = "condition_json") -> DataFrame:
    """Typed columns from the condition JSON, which itself stays."""
    parsed = F.from_json(json, schema)
    return df.withColumn("__c", parsed).select(*df.columns, "__c.*")


def attach_lineage(facts: DataFrame, runs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Batch, receipt, file hash and processing run next to every fact."""
    chain = runs.join(receipts, "receipt_id", "left").select(
        "run_id", "processing_run_id", "receipt_id", "import_batch_id", "sha256", "original_file_name"
    )
    return join_sized(facts, chain, ["run_id"], "left", null_safe=False)


def run_output_counts(raw: DataFrame, units: DataFrame, meas: DataFrame) -> DataFrame:
    """Source rows, units and measurements per processing run; each side is counted before they meet."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))

    joined = (
        count(raw, "row_count_input")
        .join(count(units, "unit_count_output"), "run_id", "full")
        .join(count(meas, "measurement_count_output"), "run_id", "full")
    )
    return joined.fillna(0)
