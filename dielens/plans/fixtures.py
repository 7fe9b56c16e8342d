"""The driver tables seen as wafer-probe, final-test, file and governance data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dielens.functions.shuffles import numbered
from dielens.operators import clean, rules, units
from dielens.plans.inline import inline

ATTEMPT_KEYS = ["lot_id", "wafer_id", "run_attempt_no", "x_coord", "y_coord"]
SESSION_KEYS = ["lot_id", "wafer_id", "run_attempt_no"]
SOURCE_COLUMNS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cp_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per probed die attempt, before attempts are numbered."""
    return _dice(table(spark, sf, "lineitem"))


def _dice(lines: DataFrame, *more: str) -> DataFrame:
    c = F.col
    slot = c("l_suppkey") % 10
    y = F.floor(c("l_partkey") / 40.0).cast("long") % 50
    lot, wafer = F.concat(F.lit("L"), slot), F.concat(F.lit("W"), c("l_linenumber"))
    product = F.concat(F.lit("P"), slot % 4)
    attempt = F.when(c("l_linestatus") == "F", 0).otherwise(1)
    first_fail = (
        F.when(c("l_quantity") <= 3, 1)
        .when(c("l_extendedprice") > 100000, 2)
        .when(c("l_discount") > 0.09, 3)
        .when(c("l_tax") > 0.07, 4)
    )
    cents = F.floor(c("l_extendedprice") * 100 + 0.5).cast("long")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("unit_id"),
        F.lit("CP").alias("test_stage"),
        lot.alias("lot_id"),
        wafer.alias("wafer_id"),
        product.alias("product_code"),
        slot.alias("supplier_id"),
        attempt.alias("run_attempt_no"),
        F.concat_ws("/", lot, wafer, attempt).alias("run_id"),
        (c("l_partkey") % 40).cast("int").alias("x_coord"),
        y.alias("y_coord"),
        F.concat_ws("|", F.lit("CP"), product, lot, wafer, c("l_partkey") % 40, y).alias("logical_unit_key"),
        F.floor(c("l_discount") * 100 + 0.5).cast("int").cast("string").alias("soft_bin"),
        c("l_returnflag").alias("hard_bin"),
        c("l_shipdate").alias("tested_at_utc"),
        (c("l_orderkey") % 4).cast("int").alias("site_no"),
        first_fail.alias("first_fail"),
        F.when(first_fail.isNull(), "PASS").otherwise("FAIL").alias("overall_result"),
        *SOURCE_COLUMNS,
        *more,
    )


_ORDER = ["tested_at_utc", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]


def _order():
    return [F.col(x) for x in _ORDER]


def _with_attempts(dice: DataFrame) -> DataFrame:
    """Attempt number per die and session."""
    return clean.assign_attempt_no(dice, ATTEMPT_KEYS, _order())


def cp(spark: SparkSession, sf: str, as_blocks: bool = False) -> DataFrame:
    """Probed dice with attempt number and sequence within the wafer session.

    The lines are numbered and shuffled as they are read, under numbers that stand for lot and wafer one to one; the
    texts of a die are made afterwards.  ``as_blocks`` shuffles them as packed columns, which takes less disk and pays
    where both numbers are wanted.
    """
    c = F.col
    lines = table(spark, sf, "lineitem").select(
        *SOURCE_COLUMNS,
        "l_linestatus",
        "l_returnflag",
        "l_shipdate",
        c("l_shipdate").alias("tested_at_utc"),
        (c("l_suppkey") % 10).alias("__lot"),
        F.when(c("l_linestatus") == "F", 0).otherwise(1).alias("__attempt"),
    )
    session = ["__lot", "l_linenumber", "__attempt"]
    order, last = (_ORDER, "-unit_sequence") if as_blocks else (_order(), F.desc("unit_sequence"))
    sequenced = numbered(lines, session, order, c("tested_at_utc"), "unit_sequence", lines, null_safe=False)
    placed = sequenced.withColumns({"__x": c("l_partkey") % 40, "__y": F.floor(c("l_partkey") / 40.0).cast("long") % 50})
    # of equal rows the one numbered last in its session is the first attempt
    attempts = clean.assign_attempt_no(placed, [*session, "__x", "__y"], [*order, last])
    return _dice(attempts, "unit_sequence", "attempt_no")


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Dice with the meaning of their raw bin, resolved before the rows are shuffled for attempts.

    The source row number is their sequence, as for files that carry none.
    """
    rows = cp_rows(spark, sf)
    source_row = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return _with_attempts(with_outcome(spark, rows).withColumn("source_row_no", source_row))


def with_outcome(spark: SparkSession, dice: DataFrame) -> DataFrame:
    resolved = rules.resolve_bin(dice, inline(spark, "bin_sets"), inline(spark, "scopes"))
    return rules.evaluate_bin(resolved, inline(spark, "bin_defs"))


def final(spark: SparkSession, sf: str) -> DataFrame:
    return units.final_units(outcomes(spark, sf))


def meas(spark: SparkSession, sf: str) -> DataFrame:
    """Four measurements per die, in long form; unit context columns are carried on the facts.

    Carrying lot, wafer and coordinates costs little in a columnar file and
    saves the fact-to-fact join in every report.
    """
    c = F.col
    step = c("sequence_no")
    values = {1: "l_quantity", 2: "l_extendedprice", 3: "l_discount", 4: "l_tax"}
    names = {1: ("VTH", "V"), 2: ("BVDSS", "V"), 3: ("IDSS", "uA"), 4: ("RDSON", "mOhm")}
    unit = [
        "unit_id",
        "run_id",
        "lot_id",
        "wafer_id",
        "product_code",
        "supplier_id",
        "test_stage",
        "tested_at_utc",
        "x_coord",
        "y_coord",
        "site_no",
        "run_attempt_no",
        "logical_unit_key",
    ]

    def by_step(of) -> Column:
        chosen = F.when(step == 1, of(1))
        for i in (2, 3, 4):
            chosen = chosen.when(step == i, of(i))
        return chosen

    steps = F.explode(F.array(*[F.lit(i) for i in values])).alias("sequence_no")
    stepped = cp_rows(spark, sf).select(*unit, "first_fail", *values.values(), steps).select(
        *unit, "first_fail", "sequence_no", by_step(lambda i: c(values[i])).alias("__value")
    )
    skipped = F.coalesce(c("first_fail") < step, F.lit(False))
    over = (step == 2) & (c("__value") > 100000)
    status = F.when(skipped, "NOT_TESTED").when(over, "OVER_RANGE").otherwise("MEASURED")
    return stepped.select(
        *unit,
        step.cast("long").alias("test_item_id"),
        "sequence_no",
        by_step(lambda i: F.lit(names[i][0])).alias("parameter_code"),
        by_step(lambda i: F.lit(names[i][1])).alias("unit_raw"),
        F.when(skipped, "").when(over, "OVER").otherwise(c("__value").cast("string")).alias("raw_value"),
        F.when(~skipped & ~over, c("__value")).alias("value_numeric"),
        status.alias("measurement_status"),
        F.when(~skipped, ~F.coalesce(c("first_fail") == step, F.lit(False))).alias("tester_pass_flag"),
        (step + 7).alias("source_column_index"),
        F.concat_ws("/", "unit_id", step).alias("measurement_id"),
    )


def applied_limits(spark: SparkSession, rows: DataFrame, allow: bool = True) -> DataFrame:
    """Measurements with the limits that apply to them."""
    rule_tables = {name: inline(spark, name) for name in ("bindings", "spec_sets", "scopes", "spec_items", "items", "factors")}
    return rules.apply_spec_limits(rows, rule_tables, allow, "tested_at_utc")


def evals(spark: SparkSession, sf: str, allow: bool = True) -> DataFrame:
    return rules.evaluate_spec(applied_limits(spark, meas(spark, sf), allow))


def ft(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    user, event = c("user_id"), c("event_id")
    result = (
        F.when(c("event_type") == "error", "FAIL")
        .when(c("event_type") == "view", "ABORT")
        .when(c("event_type") == "signup", "UNKNOWN")
        .otherwise("PASS")
    )
    return table(spark, sf, "events").select(
        event.cast("string").alias("unit_id"),
        F.lit("FT").alias("test_stage"),
        F.concat(F.lit("FT"), user % 20).alias("lot_id"),
        F.concat(F.lit("P"), user % 4).alias("product_code"),
        (user % 10).alias("supplier_id"),
        F.when(event % 10 != 0, event.cast("string")).alias("serial_no"),
        F.concat(F.lit("T"), event % 4).alias("tester_id"),
        F.concat(F.lit("FT"), user % 20, F.lit("/T"), event % 4).alias("run_id"),
        result.alias("overall_result"),
        F.lit("IGSS").alias("parameter_code"),
        c("value").alias("value_numeric"),
        F.lit("MEASURED").alias("measurement_status"),
        c("props").alias("condition_json"),
        c("ts").alias("source_started_local"),
        event.alias("unit_sequence"),
        event.alias("event_id"),
        F.when(user % 4 == 0, "Asia/Shanghai").alias("explicit_zone"),
        F.when(user % 4 == 1, "Asia/Tokyo").alias("supplier_zone"),
        F.when(user % 4 == 2, "UTC").alias("file_zone"),
        (user % 7).cast("int").alias("site_no"),
    )


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    role = F.element_at(
        F.array(*[F.lit(r) for r in ("DETAIL", "DETAIL", "SPEC", "YIELD", "MANIFEST")]), (d % 5 + 1).cast("int")
    )
    arrived = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=d.cast("int"))
    return table(spark, sf, "documents").select(
        d.alias("receipt_id"),
        F.col("source").alias("import_batch_id"),
        F.when(d % 333 == 0, "PX").otherwise("P1").alias("product_code"),
        F.when(d % 250 == 7, "MILLI").otherwise("SI").alias("unit_contract"),
        F.concat("source", F.lit("/"), d, F.lit(".txt")).alias("original_file_name"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("sha256"),
        F.col("n_chars").alias("file_size"),
        arrived.alias("received_at_utc"),
        role.alias("file_role"),
        (F.floor(d / 20.0).cast("int") % 40).alias("ordinal_no"),
        (d % 50 == 0).alias("forced"),
        F.when(d % 50 == 0, F.when(d % 100 == 0, "").otherwise("recheck")).alias("reason"),
    )


def cp_runs(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["run_id", "lot_id", "wafer_id", "product_code", "supplier_id", "run_attempt_no"]
    runs = cp_rows(spark, sf).groupBy(*keys).agg(
        F.min("tested_at_utc").alias("started_at_utc"), F.max("tested_at_utc").alias("finished_at_utc")
    )
    wafer = F.substring("wafer_id", 2, 2).cast("long")
    receipt = F.col("supplier_id") * 14 + (wafer - 1) * 2 + F.col("run_attempt_no")
    return runs.withColumns({"processing_run_id": F.col("run_id"), "receipt_id": receipt})


def version_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Members of the four product datasets: the first version has only the first wafer sessions."""
    versions = inline(spark, "dv").join(inline(spark, "ds"), "dataset_id")
    member = (F.col("version_no") > 1) | (F.col("run_attempt_no") == 0)
    return (
        cp_runs(spark, sf)
        .join(versions, "product_code")
        .where(member)
        .select("dataset_version_id", "processing_run_id")
    )


def archive_datasets(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    kind = F.element_at(
        F.array(*[F.lit(x) for x in ("CP_DETAIL", "FT_DETAIL", "WAFER_SUMMARY", "YIELD_REPORT")]),
        (k % 4 + 1).cast("int"),
    )
    return table(spark, sf, "customer").select(
        k.alias("dataset_id"),
        F.concat(F.lit("DS"), k).alias("dataset_code"),
        F.col("c_name").alias("dataset_name"),
        kind.alias("dataset_type"),
        F.when(k % 2 == 0, "CP").otherwise("FT").alias("test_stage"),
        (n % 10).cast("long").alias("supplier_id"),
        F.concat(F.lit("P"), k % 4).alias("product_code"),
        F.concat(F.lit("PJ"), n % 5).alias("project_code"),
        (k % 7).alias("owner_user_id"),
        F.col("c_mktsegment").alias("department"),
    )


def archive_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A version history per dataset: drafts, superseded versions and at most one current one."""
    orders = table(spark, sf, "orders")
    draft = F.col("o_orderstatus") == "P"
    last = (
        orders.where(~draft)
        .groupBy("o_custkey")
        .agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))
        .select("o_orderkey", F.lit(True).alias("is_last"))
    )
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    month = F.date_trunc("month", "o_orderdate")
    counted = numbered(orders, ["o_custkey"], order, month, "version_no")
    current = F.coalesce(F.col("is_last"), F.lit(False))
    units_ = F.floor(F.col("o_totalprice") / 4).cast("long")
    return counted.join(last, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("dataset_version_id"),
        F.col("o_custkey").alias("dataset_id"),
        F.col("version_no").cast("int").alias("version_no"),
        F.when(draft, "DRAFT").when(current, "PUBLISHED").otherwise("SUPERSEDED").alias("status"),
        current.alias("is_current"),
        F.floor("o_totalprice").cast("long").alias("row_count"),
        units_.alias("unit_count"),
        (units_ * 4).alias("measurement_count"),
        (F.col("o_custkey") % 7).alias("published_by"),
        F.when(~draft, F.col("o_orderdate")).alias("published_at_utc"),
    )


def audit(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {
        "error": ("DQ_WAIVE", "dq_issue"),
        "view": ("EXPORT_DOWNLOAD", "export_artifact"),
        "signup": ("SPEC_BINDING", "spec_binding"),
        "click": ("BIN_MAPPING", "bin_mapping_set"),
        "purchase": ("FORCE_REPROCESS", "processing_job"),
    }
    operation, entity = (
        F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[i])])[F.col("event_type")] for i in (0, 1)
    )
    whole = F.floor("value").cast("int")
    k = F.get_json_object("props", "$.k")
    before = F.concat(
        F.lit('{"limit":"'), whole % 5, F.lit('","state":"OPEN","k":"'), k, F.lit('"}')
    )
    after = F.concat(
        F.lit('{"limit":"'), whole % 3, F.lit('","k":"'), k, F.lit('","owner":"'), F.col("user_id") % 3, F.lit('"}')
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("audit_id"),
        F.concat(F.lit("u"), "user_id").alias("actor"),
        operation.alias("operation"),
        entity.alias("entity_type"),
        (F.col("user_id") % 13).cast("string").alias("entity_id"),
        F.when(F.col("event_type") != "signup", before).alias("before_json"),
        after.alias("after_json"),
        F.concat(F.lit("c"), F.col("event_id") % 97).alias("correlation_id"),
        F.col("ts").alias("occurred_at_utc"),
    )


def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    days = F.substring("o_orderpriority", 1, 1).cast("int") * 30
    expires = F.col("o_orderdate") + F.make_dt_interval(days=days)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("export_artifact_id"),
        F.concat(F.lit("export-"), "o_orderkey", F.lit(".csv")).alias("file_name"),
        F.col("o_orderdate").alias("created_at_utc"),
        F.when(F.col("o_orderpriority") != "1-URGENT", expires).alias("expires_at_utc"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    probed = cp_rows(spark, sf).select(
        F.col("unit_id").alias("source_unit_id"),
        F.concat(F.lit("A-"), "l_orderkey").alias("target_unit_id"),
        F.lit("CP_ASSEMBLY").alias("trace_type"),
        F.round(1 - F.col("l_discount"), 5).alias("confidence"),
    )
    tested = table(spark, sf, "events").select(
        F.concat(F.lit("A-"), "event_id").alias("source_unit_id"),
        F.col("event_id").cast("string").alias("target_unit_id"),
        F.lit("ASSEMBLY_FT").alias("trace_type"),
        F.lit(0.99).alias("confidence"),
    )
    return probed.unionByName(tested)


def vendor(spark: SparkSession, sf: str) -> DataFrame:
    """Wide vendor rows before cleaning, with blanks, bad numbers and an unknown unit in them."""
    c = F.col
    skipped = {i: F.coalesce(c("first_fail") < i, F.lit(False)) for i in (2, 3, 4)}
    return cp_rows(spark, sf).select(
        "unit_id",
        "run_id",
        "lot_id",
        F.when(c("l_orderkey") % 101 != 0, c("wafer_id")).alias("wafer_id"),
        "product_code",
        "supplier_id",
        "run_attempt_no",
        F.lit(0).alias("attempt_no"),
        F.when(c("l_partkey") % 211 != 0, c("x_coord")).alias("x_coord"),
        "y_coord",
        F.when(c("l_partkey") % 53 != 0, c("soft_bin")).alias("soft_bin"),
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("source_row_no"),
        F.when(c("supplier_id") == 9, "kV").otherwise("V").alias("bvdss_unit"),
        F.when(c("l_orderkey") % 17 == 0, "ERR").otherwise(c("l_quantity").cast("string")).alias("vth"),
        F.when(skipped[2], "")
        .when(c("l_extendedprice") > 100000, "OVER")
        .otherwise(c("l_extendedprice").cast("string"))
        .alias("bvdss"),
        F.when(skipped[3], "").otherwise(c("l_discount").cast("string")).alias("idss"),
        F.when(skipped[4], "").otherwise(c("l_tax").cast("string")).alias("rdson"),
        "first_fail",
        "l_partkey",
    )
