"""Cleaning and normalisation of vendor rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from dielens.operators import clean
from dielens.plans import fixtures as fx
from dielens.plans.inline import inline
from dielens.plans.registry import query

# The header rows of one vendor file per part: name, unit, lower and upper limit.
PROFILE = {"name_row": 1, "unit_row": 2, "lower_row": 3, "upper_row": 4, "first_item_column": 2}


def header_files(spark, sf):
    size, price = F.col("p_size"), F.floor("p_retailprice").cast("long")
    rows = [
        F.array(F.lit("X"), F.lit("Y"), F.concat(F.lit(" "), "p_type"), F.col("p_brand"), F.lit("")),
        F.array(F.lit(""), F.lit(""), F.lit("V"), F.lit("mV "), F.lit("uA")),
        F.array(F.lit(""), F.lit(""), F.concat(F.lit(">"), size), F.lit("-"), F.lit("1")),
        F.array(F.lit(""), F.lit(""), F.concat(F.lit("<= "), price), size.cast("string"), F.lit("2")),
        F.array(F.lit("1"), F.lit("2"), F.lit("0.5"), F.lit("0.6"), F.lit("0.7")),
    ]
    cells = F.array(*[F.struct(F.lit(i + 1).alias("source_row_no"), r.alias("cells")) for i, r in enumerate(rows)])
    name = F.concat(F.lit("part-"), "p_partkey", F.lit(".csv")).alias("source_file")
    return fx.table(spark, sf, "part").select(name, F.inline(cells))


_HEADER = """(SELECT concat('part-', p_partkey, '.csv') AS source_file, 2 AS source_column_index, p_type AS raw_item_name, 'V' AS unit_raw,
 concat('>', p_size) AS lower_limit_raw, concat('<= ', CAST(floor(p_retailprice) AS BIGINT)) AS upper_limit_raw, 1 AS sequence_no FROM part
UNION ALL SELECT concat('part-', p_partkey, '.csv'), 3, p_brand, 'mV', '-', CAST(p_size AS VARCHAR), 2 FROM part)"""


@query("extract_test_items", f"SELECT * FROM {_HEADER}")
def _(spark, sf):
    return clean.extract_test_items(header_files(spark, sf), PROFILE)


@query(
    "parse_limits",
    f"""SELECT source_file, source_column_index, lower_limit_raw, upper_limit_raw,
 TRY_CAST(nullif(regexp_extract(lower_limit_raw, '([0-9]+)', 1), '') AS DOUBLE) AS program_lsl,
 TRY_CAST(nullif(regexp_extract(upper_limit_raw, '([0-9]+)', 1), '') AS DOUBLE) AS program_usl,
 CASE WHEN lower_limit_raw LIKE '>%' THEN '>' END AS lower_operator, CASE WHEN upper_limit_raw LIKE '<=%' THEN '<=' END AS upper_operator
FROM {_HEADER}""",
)
def _(spark, sf):
    items = clean.extract_test_items(header_files(spark, sf), PROFILE)
    return clean.parse_limits(items).drop("raw_item_name", "unit_raw", "sequence_no")


ITEM_COLUMNS = {"vth": 1, "bvdss": 2, "idss": 3, "rdson": 4}
_LONG = """(SELECT v.unit_id, i.test_item_id, lower(i.parameter_code) AS source_column, v.first_fail,
 CASE i.test_item_id WHEN 1 THEN vth WHEN 2 THEN bvdss WHEN 3 THEN idss ELSE rdson END AS raw_value FROM vendor v CROSS JOIN items i)"""
_PARSED = f"""(SELECT *, CASE WHEN raw_value = '' THEN 'MISSING' WHEN raw_value = 'OVER' THEN 'OVER_RANGE' WHEN raw_value = 'ERR' THEN 'INVALID'
 ELSE 'MEASURED' END AS measurement_status, TRY_CAST(raw_value AS DOUBLE) AS value_numeric,
 CASE WHEN raw_value IN ('OVER', 'ERR') THEN raw_value END AS value_text FROM {_LONG})"""


def unpivoted(spark, sf, *extra):
    return clean.unpivot_measurements(fx.vendor(spark, sf), ["unit_id", *extra], ITEM_COLUMNS)


@query("unpivot_measurements", f"SELECT unit_id, test_item_id, source_column, raw_value FROM {_LONG}")
def _(spark, sf):
    return unpivoted(spark, sf)


@query(
    "parse_measurement_value",
    f"SELECT unit_id, test_item_id, raw_value, value_numeric, value_text, measurement_status FROM {_PARSED}",
)
def _(spark, sf):
    return clean.parse_measurement_value(unpivoted(spark, sf)).drop("source_column")


@query(
    "mark_not_tested",
    f"""SELECT unit_id, test_item_id, CASE WHEN measurement_status = 'MISSING' AND first_fail < test_item_id THEN 'NOT_TESTED'
 ELSE measurement_status END AS measurement_status FROM {_PARSED}""",
)
def _(spark, sf):
    parsed = clean.parse_measurement_value(unpivoted(spark, sf, "first_fail"))
    failed_here = F.coalesce(F.col("first_fail") == F.col("test_item_id"), F.lit(False))
    stepped = parsed.withColumns({"sequence_no": F.col("test_item_id"), "tester_pass_flag": ~failed_here})
    return clean.mark_not_tested(stepped).select("unit_id", "test_item_id", "measurement_status")


@query(
    "normalize_units",
    """SELECT unit_id, TRY_CAST(bvdss AS DOUBLE) * f.factor AS value_si, f.unit_code, f.factor IS NOT NULL AS unit_ok
FROM vendor v LEFT JOIN factors f ON f.unit_raw = v.bvdss_unit""",
)
def _(spark, sf):
    long = fx.vendor(spark, sf).select(
        "unit_id", F.col("bvdss_unit").alias("unit_raw"), F.col("bvdss").try_cast("double").alias("value_numeric")
    )
    return clean.normalize_units(long, inline(spark, "factors")).drop("unit_raw", "value_numeric")


@query(
    "map_product_alias",
    """SELECT p.p_partkey, a.product_code FROM part p LEFT JOIN product_aliases a ON a.active AND a.alias_type = 'VENDOR_NAME'
 AND a.supplier_id = p.p_partkey % 4 AND a.alias_value = p.p_name""",
)
def _(spark, sf):
    named = fx.table(spark, sf, "part").select(
        "p_partkey", (F.col("p_partkey") % 4).alias("supplier_id"), F.col("p_name").alias("alias_value")
    )
    mapped = clean.map_product_alias(named, inline(spark, "product_aliases"), "VENDOR_NAME")
    return mapped.select("p_partkey", "product_code")


@query(
    "map_program_version",
    """SELECT m.unit_id, v.program_version_id, v.version_code FROM cp_rows m LEFT JOIN program_versions v
 ON v.program_code = concat('PRG', m.supplier_id % 4) AND (v.valid_from_utc IS NULL OR v.valid_from_utc <= m.tested_at_utc)
 AND (v.valid_to_utc IS NULL OR v.valid_to_utc > m.tested_at_utc)""",
)
def _(spark, sf):
    coded = fx.cp_rows(spark, sf).select(
        "unit_id", "tested_at_utc", F.concat(F.lit("PRG"), F.col("supplier_id") % 4).alias("program_code")
    )
    mapped = clean.map_program_version(coded, inline(spark, "program_versions"), "tested_at_utc")
    return mapped.select("unit_id", "program_version_id", "version_code")


@query(
    "parameter_identity",
    """WITH t AS (SELECT p_partkey AS test_item_id, row_number() OVER (PARTITION BY p_brand, p_size, p_type ORDER BY p_partkey) AS occurrence,
 p_type, p_size % 2 AS odd, p_name FROM part)
SELECT test_item_id, CAST(occurrence AS INT) AS occurrence, sha256(concat(p_type, '|', occurrence, '|',
 CASE WHEN odd = 1 THEN 'NEG' ELSE '' END, '|5|V|uA||', p_name)) AS parameter_key FROM t""",
)
def _(spark, sf):
    items = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("test_item_id"),
        F.col("p_partkey").alias("sequence_no"),
        "p_brand",
        "p_size",
        F.col("p_type").alias("parameter_code"),
        F.when(F.col("p_size") % 2 == 1, "NEG").alias("bias_polarity"),
        F.lit(5).alias("bias_value"),
        F.lit("V").alias("bias_unit"),
        F.lit("uA").alias("unit_raw"),
        F.lit(None).cast("string").alias("test_condition"),
        F.col("p_name").alias("source_item"),
    )
    return clean.parameter_identity(items, ["p_brand", "p_size"]).select("test_item_id", "occurrence", "parameter_key")


@query(
    "logical_unit_key",
    """SELECT unit_id, CASE WHEN wafer_id IS NULL OR x_coord IS NULL THEN concat('CP|', CASE WHEN l_partkey % 2 = 0 THEN 'VENDOR|' ELSE 'SEQ|' END, run_id, '|', source_row_no)
 ELSE concat_ws('|', 'CP', product_code, lot_id, wafer_id, x_coord, y_coord) END AS logical_unit_key,
 CASE WHEN wafer_id IS NULL OR x_coord IS NULL THEN 'FALLBACK' ELSE 'STABLE' END AS key_quality FROM vendor""",
)
def _(spark, sf):
    rows = fx.vendor(spark, sf).withColumns(
        {
            "vendor_unit_id": F.when(F.col("l_partkey") % 2 == 0, F.col("source_row_no").cast("string")),
            "unit_sequence": F.col("source_row_no"),
        }
    )
    return clean.logical_unit_key(rows, "CP").select("unit_id", "logical_unit_key", "key_quality")


@query(
    "logical_unit_key_ft",
    """SELECT unit_id, CASE WHEN serial_no IS NULL THEN concat('FT|SEQ|', lot_id, '|', unit_sequence)
 ELSE concat_ws('|', 'FT', product_code, lot_id, serial_no) END AS logical_unit_key,
 CASE WHEN serial_no IS NULL THEN 'FALLBACK' ELSE 'STABLE' END AS key_quality FROM ft""",
)
def _(spark, sf):
    rows = fx.ft(spark, sf).withColumns({"vendor_unit_id": F.lit(None).cast("string"), "run_id": F.col("lot_id")})
    return clean.logical_unit_key(rows, "FT").select("unit_id", "logical_unit_key", "key_quality")


@query("assign_attempt_no", "SELECT unit_id, attempt_no, unit_sequence FROM cp")
def _(spark, sf):
    return fx.cp(spark, sf).select("unit_id", "attempt_no", "unit_sequence")


@query(
    "resolve_timezone",
    """WITH t AS (SELECT *, coalesce(explicit_zone, supplier_zone, file_zone) AS zone FROM ft)
SELECT unit_id, zone AS source_timezone_iana, CASE WHEN explicit_zone IS NOT NULL THEN 'SOURCE_EXPLICIT'
 WHEN supplier_zone IS NOT NULL THEN 'SUPPLIER_DEFAULT' WHEN file_zone IS NOT NULL THEN 'FILE_RULE' ELSE 'UNKNOWN' END AS timezone_resolution,
 (source_started_local AT TIME ZONE zone) AT TIME ZONE 'UTC' AS started_at_utc,
 CASE zone WHEN 'Asia/Shanghai' THEN 480 WHEN 'Asia/Tokyo' THEN 540 WHEN 'UTC' THEN 0 END AS source_utc_offset_minutes FROM t""",
)
def _(spark, sf):
    return clean.resolve_timezone(fx.ft(spark, sf)).select(
        "unit_id", "source_timezone_iana", "timezone_resolution", "started_at_utc", "source_utc_offset_minutes"
    )


@query(
    "surrogate_key",
    """SELECT unit_id, sha256(concat(length(run_id), ':', run_id, '|', length(unit_id), ':', unit_id)) AS unit_sk FROM cp_rows""",
)
def _(spark, sf):
    return clean.surrogate_key(fx.cp_rows(spark, sf), ["run_id", "unit_id"], "unit_sk").select("unit_id", "unit_sk")


@query(
    "extract_conditions",
    "SELECT unit_id, condition_json, CAST(json_extract_string(condition_json, '$.k') AS INT) AS k FROM ft",
)
def _(spark, sf):
    rows = fx.ft(spark, sf).select("unit_id", "condition_json")
    return clean.extract_conditions(rows, "k int")


@query(
    "attach_lineage",
    """SELECT m.measurement_id, m.source_column_index, c.run_id AS processing_run_id, r.receipt_id, r.import_batch_id, r.sha256
FROM meas m JOIN cp_runs c ON c.run_id = m.run_id LEFT JOIN receipts r ON r.receipt_id = c.receipt_id""",
)
def _(spark, sf):
    facts = fx.meas(spark, sf).select("measurement_id", "run_id", "source_column_index")
    traced = clean.attach_lineage(facts, fx.cp_runs(spark, sf), fx.receipts(spark, sf))
    return traced.drop("run_id", "original_file_name")


@query(
    "run_output_counts",
    """SELECT run_id, count(*) AS row_count_input, count(wafer_id) AS unit_count_output, count(*) * 4 AS measurement_count_output
FROM vendor GROUP BY run_id""",
)
def _(spark, sf):
    raw = fx.vendor(spark, sf)
    return clean.run_output_counts(raw, raw.where("wafer_id IS NOT NULL"), fx.meas(spark, sf))
