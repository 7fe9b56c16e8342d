"""Versioned rule resolution and evaluation.

A rule row applies to a context when every field the rule fills equals the
context, and the validity window covers the event time.  The highest scope
priority must be unique; more than one candidate is reported, never broken by
id or time.

Measurements are never compared with rules directly.  Event times become the
slot between two rule boundaries by an as-of join of the distinct instants; the
distinct contexts with their slot are few, are resolved by an equi-join per
filled-field pattern, and are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dielens.functions.columns import (
    in_window,
    known_operators,
    meets_lower,
    meets_upper,
    power_of_ten,
    shifted,
)
from dielens.functions.packed import by_part, latest, packable, part_of, stem
from dielens.functions.shuffles import as_of, join_sized, settled

SPEC_FIELDS = (
    "supplier_id",
    "product_code",
    "test_stage",
    "program_version_id",
    "customer_code",
    "quality_grade",
    "package_code",
)
BIN_FIELDS = ("supplier_id", "product_code", "test_stage", "program_version_id")


def slotted(rows: DataFrame, event_time: str, rules: DataFrame) -> DataFrame:
    """Adds ``__slot``: how many rule boundaries are at or before the event; windows are half-open, so this decides them all.

    Events are first cut to the coarsest step (day, minute or none) on which every boundary lies, which moves no event
    across one.  The distinct instants are few then; they meet the boundaries in one order (:func:`as_of`) and the rows
    take their slot by an equi-join.
    """
    bounds = (
        rules.select(F.explode(F.array("effective_from_utc", "effective_to_utc")).alias("at"))
        .select(F.col("at").cast("timestamp_ntz").alias("at"))
        .where("at IS NOT NULL")
        .distinct()
    )
    n, days, minutes = bounds.agg(
        F.count("*"), F.bool_and(F.col("at") == _cut("at", "day")), F.bool_and(F.col("at") == _cut("at", "minute"))
    ).first()
    if not n:
        return rows.withColumn("__slot", F.when(F.col(event_time).isNull(), -1).otherwise(0).cast("long"))
    step = "day" if days else "minute" if minutes else "none"
    timed = rows.withColumn("__instant", _cut(event_time, step))
    instants = timed.select(F.col("__instant").alias("at")).where("at IS NOT NULL").distinct()
    slots = as_of(instants, bounds, "at").select(F.col("at").alias("__instant"), F.col("n_before").alias("__slot"))
    joined = join_sized(timed, slots, ["__instant"], "left", null_safe=False)
    return joined.select(*rows.columns, F.coalesce("__slot", F.lit(-1).cast("long")).alias("__slot"))


def _cut(name: str, step: str) -> Column:
    at = F.col(name).cast("timestamp_ntz")
    if step == "none":
        return at
    day = at.cast("date").cast("timestamp_ntz")
    if step == "day":
        return day
    return day + F.make_dt_interval(F.lit(0), F.hour(at), F.minute(at), F.lit(0))


def _resolve(
    rows: DataFrame,
    rules: DataFrame,
    scopes: DataFrame,
    fields: Sequence[str],
    carried: Sequence[str],
    status: str,
    event_time: str,
    slot: str | None = None,
) -> DataFrame:
    used = [f for f in fields if f in rows.columns]
    for missing in (f for f in fields if f not in rows.columns):
        rules = rules.where(F.col(missing).isNull())
    live = rules.where("active").join(
        scopes.where("active").select("scope_code", "priority"), "scope_code"
    )
    pattern = F.concat_ws("", *[F.when(F.col(f).isNull(), "0").otherwise("1") for f in used])
    live = live.select(
        pattern.alias("__p"),
        "priority",
        F.struct(*carried).alias("__rule"),
        F.col("effective_from_utc").alias("__from"),
        F.col("effective_to_utc").alias("__to"),
        *[F.col(f).alias(f"__b_{f}") for f in used],
    )
    timed = rows if slot else slotted(rows, event_time, rules)
    contexts = timed.groupBy(*used, "__slot").agg(F.min(event_time).alias("__at"))
    patterns = live.agg(F.collect_set("__p")).scalar()
    asked = contexts.withColumn("__asked", F.explode_outer(patterns))
    on = [F.col("__asked") == F.col("__p")]
    for i, f in enumerate(used):
        filled = F.substring("__asked", i + 1, 1) == "1"
        on.append(F.when(filled, F.col(f)).eqNullSafe(F.col(f"__b_{f}")))
    on.append(in_window(F.col("__at"), F.col("__from"), F.col("__to")))
    by_priority = (
        asked.join(live, on, "left")
        .groupBy(*used, "__slot", "priority")
        .agg(F.count("__rule").alias("n"), F.max("__rule").alias("rule"))
    )
    best = by_priority.groupBy(*used, "__slot").agg(
        F.max_by(F.struct("n", "rule"), "priority").alias("__best")
    )
    n = F.coalesce(F.col("__best.n"), F.lit(0))
    resolved = best.select(
        *used,
        "__slot",
        n.alias("n_candidates"),
        F.when(n == 0, "NO_MATCH").when(n == 1, "MATCHED").otherwise("CONFIG_AMBIGUOUS").alias(status),
        *[F.when(n == 1, F.col(f"__best.rule.{c}")).alias(c) for c in carried],
    )
    joined = join_sized(timed, resolved, [*used, "__slot"], "left")
    return joined if slot else joined.drop("__slot")


def resolve_spec_binding(
    contexts: DataFrame,
    bindings: DataFrame,
    sets: DataFrame,
    scopes: DataFrame,
    event_time: str = "event_time_utc",
    slot: str | None = None,
) -> DataFrame:
    """Context rows + ``spec_binding_id, spec_set_id, binding_status, n_candidates``.

    ``slot`` tells that the rows already carry their time slot.
    """
    released = sets.where("status = 'RELEASED'").select("spec_set_id")
    rules = bindings.join(released, "spec_set_id", "left_semi")
    return _resolve(
        contexts,
        rules,
        scopes,
        SPEC_FIELDS,
        ("spec_binding_id", "spec_set_id"),
        "binding_status",
        event_time,
        slot,
    )


def spec_per_lot(
    meas: DataFrame,
    bindings: DataFrame,
    sets: DataFrame,
    scopes: DataFrame,
    event_time: str = "tested_at_utc",
) -> DataFrame:
    """Every row takes the spec of its own lot's context, whatever else is in the set.

    The lot is kept next to the resolved binding so that a mixed selection can
    be checked: one row per lot, set and status.
    """
    resolved = resolve_spec_binding(meas, bindings, sets, scopes, event_time)
    return resolved.groupBy("lot_id", "spec_set_id", "binding_status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("wafer_id").alias("n_wafers")
    )


_LIMIT_FIELDS = ("spec_item_id", "lsl", "usl", "lower_operator", "upper_operator", "unit_code")


def match_spec_item(resolved: DataFrame, items: DataFrame) -> DataFrame:
    """The item bound to the test item id wins as a whole over the one bound to the parameter code.

    Two items under one key are ambiguous configuration, not a tie to break.
    """
    def unique_item(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.struct(
                F.count(F.lit(1)).alias("n"), F.max(F.struct(*_LIMIT_FIELDS)).alias("item")
            ).alias(name)
        )

    by_id = unique_item(
        items.where("test_item_id IS NOT NULL"), ["spec_set_id", "test_item_id"], "__by_id"
    )
    by_code = unique_item(
        items.where("test_item_id IS NULL"), ["spec_set_id", "parameter_code"], "__by_code"
    )
    found = F.coalesce("__by_id", "__by_code")
    unique = found["n"] == 1
    matched = resolved.join(by_id, ["spec_set_id", "test_item_id"], "left").join(
        by_code, ["spec_set_id", "parameter_code"], "left"
    )
    return matched.withColumns(
        {
            "binding_status": F.when(found["n"] > 1, "CONFIG_AMBIGUOUS").otherwise(F.col("binding_status")),
            "n_candidates": F.when(found["n"] > 1, found["n"]).otherwise(F.col("n_candidates")),
            **{f: F.when(unique, found["item"][f]) for f in _LIMIT_FIELDS},
        }
    ).drop("__by_id", "__by_code")


def program_limit_fallback(resolved: DataFrame, test_items: DataFrame, allow: bool) -> DataFrame:
    """Program limits, only where no controlled spec matched and the context allows it."""
    limits = test_items.select(
        "test_item_id",
        "program_lsl",
        "program_usl",
        "program_lower_operator",
        "program_upper_operator",
    )
    with_program = resolved.join(limits, "test_item_id", "left")
    has_spec = F.col("spec_item_id").isNotNull()
    may_fall_back = (
        F.lit(allow)
        & (F.col("binding_status") != "CONFIG_AMBIGUOUS")
        & (F.col("program_lsl").isNotNull() | F.col("program_usl").isNotNull())
    )
    source = F.when(has_spec, "SPEC").when(may_fall_back, "PROGRAM").otherwise("NONE")

    def pick(spec: str, program: str) -> Column:
        return F.when(has_spec, F.col(spec)).when(may_fall_back, F.col(program))

    return with_program.select(
        *resolved.columns,
        source.alias("limit_source"),
        pick("lsl", "program_lsl").alias("lsl_applied"),
        pick("usl", "program_usl").alias("usl_applied"),
        pick("lower_operator", "program_lower_operator").alias("lower_operator_applied"),
        pick("upper_operator", "program_upper_operator").alias("upper_operator_applied"),
    )


def convert_limits(limits: DataFrame, factors: DataFrame) -> DataFrame:
    """Spec limits in the raw unit of the value, so the two compare as they stand on the row.

    ``unit_ok`` is false where a unit is unknown or the two measure different things.  Between units that differ by a
    power of ten the decimal point of the limit is moved, so a value written exactly on the limit meets it.
    """
    by_limit = factors.select(
        F.col("unit_raw").alias("unit_code"),
        F.col("unit_code").alias("__limit_unit"),
        F.col("factor").alias("__factor"),
    )
    by_value = factors.select(
        "unit_raw", F.col("unit_code").alias("__value_unit"), F.col("factor").alias("__value_factor")
    )
    joined = limits.join(by_limit, "unit_code", "left").join(by_value, "unit_raw", "left")
    from_spec = F.col("limit_source") == "SPEC"
    same_unit = F.coalesce(F.col("__limit_unit") == F.col("__value_unit"), F.lit(False))
    factor, value_factor = F.col("__factor"), F.col("__value_factor")
    places = power_of_ten(factor) - power_of_ten(value_factor)

    def scaled(name: str) -> Column:
        limit = F.col(name)
        exact = F.when(places.isNotNull(), shifted(limit, places)).otherwise(limit * factor / value_factor)
        return F.when(~from_spec, limit).when(factor == value_factor, limit).otherwise(exact)

    return joined.withColumns(
        {
            "lsl_applied": scaled("lsl_applied"),
            "usl_applied": scaled("usl_applied"),
            "unit_ok": ~from_spec | same_unit,
        }
    ).drop("__limit_unit", "__factor", "__value_unit", "__value_factor")


_APPLIED = (
    "spec_binding_id",
    "spec_set_id",
    "binding_status",
    "n_candidates",
    "spec_item_id",
    "limit_source",
    "lsl_applied",
    "usl_applied",
    "lower_operator_applied",
    "upper_operator_applied",
    "unit_ok",
)


def apply_spec_limits(meas: DataFrame, tables: dict[str, DataFrame], allow: bool, event_time: str) -> DataFrame:
    """Measurements with the limits that apply to them.

    The whole chain (binding, item, fallback, unit) runs on the distinct
    (context, time slot, test item) rows; the facts meet its result in a single
    equi-join.  ``tables``: bindings, spec_sets, scopes, spec_items, items, factors.
    """
    used = [f for f in SPEC_FIELDS if f in meas.columns]
    keys = [*used, "test_item_id", "parameter_code", "unit_raw", "__slot"]
    released = tables["spec_sets"].where("status = 'RELEASED'").select("spec_set_id")
    bindings = tables["bindings"].join(released, "spec_set_id", "left_semi")
    timed = slotted(meas, event_time, bindings)
    contexts = settled(timed.groupBy(*keys).agg(F.min(event_time).alias("__at")))
    bound = resolve_spec_binding(contexts, tables["bindings"], tables["spec_sets"], tables["scopes"], "__at", slot="__slot")
    matched = match_spec_item(bound, tables["spec_items"])
    limits = convert_limits(program_limit_fallback(matched, tables["items"], allow), tables["factors"])
    return join_sized(timed, limits.select(*keys, *_APPLIED), keys, "left").drop("__slot")


def evaluate_spec(
    meas: DataFrame,
    evaluation_type: str = "SPEC",
    scope_key: str = "DEFAULT",
) -> DataFrame:
    """Judge measurements that carry their resolved limits; the limits stay on the row as a snapshot.

    The first reason that applies decides.
    """
    value = F.col("value_numeric")
    lsl, usl = F.col("lsl_applied"), F.col("usl_applied")
    lower, upper = F.col("lower_operator_applied"), F.col("upper_operator_applied")
    status = F.col("measurement_status")
    low, high = ~meets_lower(value, lsl, lower), ~meets_upper(value, usl, upper)
    unmatched = F.when(F.col("binding_status") == "NO_MATCH", "NO_BINDING").otherwise("NO_ITEM")
    passed = F.when(F.col("limit_source") == "PROGRAM", "PROGRAM_LIMIT_FALLBACK").otherwise("SPEC")
    cases = [
        (
            F.col("binding_status") == "CONFIG_AMBIGUOUS",
            F.lit("CONFIG_AMBIGUOUS"),
            F.col("n_candidates").cast("string"),
        ),
        (F.col("limit_source") == "NONE", F.lit("NO_MATCH"), unmatched),
        (status == "INVALID", F.lit("INVALID_VALUE"), F.col("raw_value")),
        (status != "MEASURED", F.lit("NOT_EVALUATED"), status),
        (~F.col("unit_ok"), F.lit("NOT_EVALUATED"), F.lit("UNIT")),
        (lsl.isNull() & usl.isNull(), F.lit("NOT_EVALUATED"), F.lit("NO_LIMIT")),
        (~known_operators(lower, upper), F.lit("NOT_EVALUATED"), F.lit("BAD_OPERATOR")),
        (value.isNull(), F.lit("INVALID_VALUE"), F.col("raw_value")),
        (low, F.lit("FAIL"), F.lit("LOW")),
        (high, F.lit("FAIL"), F.lit("HIGH")),
    ]
    def verdict(result: Column, reason: Column) -> Column:
        return F.struct(result.alias("result"), reason.alias("reason"))

    chain = F.when(cases[0][0], verdict(*cases[0][1:]))
    for condition, result, reason in cases[1:]:
        chain = chain.when(condition, verdict(result, reason))
    return meas.withColumn("__verdict", chain.otherwise(verdict(F.lit("PASS"), passed))).withColumns(
        {
            "evaluation_type": F.lit(evaluation_type),
            "evaluation_scope_key": F.lit(scope_key),
            "evaluation_result": F.col("__verdict.result"),
            "evaluation_reason": F.col("__verdict.reason"),
        }
    ).drop("__verdict")


def evaluate_multi_scope(meas: DataFrame, scope_limits: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Judge each measurement under every scope side by side in one pass over the facts.

    ``scope_limits``: evaluation_type, evaluation_scope_key, test_item_id,
    lsl_applied, usl_applied and the two operators.  With ``unit_code`` among
    them and the conversion ``factors``, limits are brought to the raw unit of
    the value, and a limit of another kind of unit gives NOT_EVALUATED; without
    they are in the raw unit of their item.  Every measurement has one row in
    each scope: NO_MATCH where the scope has no limit for its item,
    CONFIG_AMBIGUOUS where it has several.  Results are never merged.
    """
    names = {"evaluation_type": "__type", "evaluation_scope_key": "__scope"}
    fields = ["lsl_applied", "usl_applied", "lower_operator_applied", "upper_operator_applied"]
    keys = ["__type", "__scope", "test_item_id"]
    in_units = factors is not None and "unit_code" in scope_limits.columns
    carried = [*fields, *(["unit_code"] if in_units else [])]
    by_item = scope_limits.withColumnsRenamed(names).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.max(F.struct(*carried)).alias("__limit")
    )
    scopes = by_item.agg(F.array_sort(F.collect_set(F.struct("__type", "__scope")))).scalar()
    limits = by_item.select(*keys, "__n", *[F.col("__limit")[f].alias(f) for f in carried])
    if in_units:
        # the units in which an item is measured are few
        used = meas.select("test_item_id", "unit_raw").distinct()
        asked = limits.join(used, "test_item_id").withColumn("limit_source", F.lit("SPEC"))
        limits = convert_limits(asked, factors).drop("unit_code", "limit_source")
        keys = [*keys, "unit_raw"]
    else:
        limits = limits.withColumn("unit_ok", F.lit(True))
    wide = meas.withColumn("__each", F.explode(scopes)).select("*", "__each.*").drop("__each")
    n = F.coalesce("__n", F.lit(0))
    status = F.when(n == 0, "NO_MATCH").when(n == 1, "MATCHED").otherwise("CONFIG_AMBIGUOUS")
    ready = join_sized(wide, limits, keys, "left").withColumns(
        {
            "binding_status": status,
            "n_candidates": n.cast("int"),
            "limit_source": F.when(n == 1, "SPEC").otherwise("NONE"),
            "unit_ok": F.coalesce("unit_ok", F.lit(True)),
            **{f: F.when(n == 1, F.col(f)) for f in fields},
        }
    )
    judged = evaluate_spec(ready.drop("__n"))
    return judged.withColumns(
        {"evaluation_type": F.col("__type"), "evaluation_scope_key": F.col("__scope")}
    ).drop("__type", "__scope")


def current_evaluation(evals: DataFrame) -> DataFrame:
    """Exactly one row per measurement, type and scope: the latest run.

    All columns travel to where the runs of a measurement meet, as packed blocks: select those that are wanted before.
    """
    keys, when = ["measurement_id", "evaluation_type", "evaluation_scope_key"], ["evaluated_at_utc", "evaluation_run_id"]
    if not packable(evals, [*keys, *when]):
        # a key has as many rows as runs: a group limit below the exchange would sort all rows and drop next to none
        latest_first = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in when])
        return evals.withColumn("__later", F.lag(F.lit(True)).over(latest_first)).where("__later IS NULL").drop("__later")

    def current(tables):
        held = None
        for table in tables:
            held = latest(table if held is None else pa.concat_tables([held, table]), keys, when)
        yield held

    return by_part([(evals, part_of(evals, stem(keys[0])))], current, evals.schema)


def resolve_bin(
    units: DataFrame, sets: DataFrame, scopes: DataFrame, event_time: str = "tested_at_utc"
) -> DataFrame:
    """Unit rows + ``bin_mapping_set_id, set_status, n_candidates``."""
    return _resolve(
        units, sets, scopes, BIN_FIELDS, ("bin_mapping_set_id",), "set_status", event_time
    )


def evaluate_bin(
    units: DataFrame, definitions: DataFrame, bin_type: str = "CP_BIN", code: str = "soft_bin"
) -> DataFrame:
    """Meaning of the raw bin under the resolved mapping; the raw code is kept as it is."""
    meanings = definitions.where(F.col("bin_type") == bin_type).select(
        "bin_mapping_set_id",
        F.col("bin_code").alias(code),
        "bin_definition_id",
        F.col("is_pass").alias("is_pass_snapshot"),
        F.col("failure_mode").alias("failure_mode_snapshot"),
    )
    joined = units.join(meanings, ["bin_mapping_set_id", code], "left")
    blank = F.col(code).isNull() | (F.trim(code) == "")
    mapping = (
        F.when(blank, "INVALID")
        .when(F.col("set_status") != "MATCHED", F.col("set_status"))
        .when(F.col("bin_definition_id").isNull(), "NO_MATCH")
        .otherwise("MATCHED")
    )
    outcome = (
        F.when(F.col("is_pass_snapshot"), "PASS")
        .when(~F.col("is_pass_snapshot"), "FAIL")
        .otherwise("UNRESOLVED")
    )
    return joined.withColumns(
        {"bin_type": F.lit(bin_type), "mapping_status": mapping, "outcome": outcome}
    )


def evaluation_run_key(
    df: DataFrame, filters: str, rule_version: str, dataset_version: str
) -> DataFrame:
    """Adds the normalised filter text, its SHA-256 and the cache key.

    ``filters`` is a map of string lists.  Keys and lists are sorted, repeats
    and empty lists go away, so equal selections give equal hashes.
    """
    entries = F.transform(
        F.array_sort(F.map_entries(filters)),
        lambda e: F.struct(e["key"].alias("key"), F.array_sort(F.array_distinct(e["value"])).alias("value")),
    )
    kept = F.filter(entries, lambda e: F.size(e["value"]) > 0)
    text = F.to_json(F.map_from_entries(kept))
    return df.withColumn("filter_json", text).withColumn(
        "filter_hash", F.sha2("filter_json", 256)
    ).withColumn(
        "cache_key", F.concat_ws("/", F.col(dataset_version), F.col(rule_version), F.col("filter_hash"))
    )


def apply_exclusions(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """Flags the rows a named rule excludes; nothing is dropped."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({"excluded": hit, "exclusion_reason": F.when(hit, name)})


def compare_rule_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many measurements moved from one result to another between two evaluation runs."""
    before = old.select("measurement_id", F.col("evaluation_result").alias("old_result"))
    after = new.select("measurement_id", F.col("evaluation_result").alias("new_result"))
    return (
        before.join(after, "measurement_id", "full")
        .groupBy("old_result", "new_result")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def persist_metric(df: DataFrame, run_id: Column, metric: str, scope_cols: Sequence[str]) -> DataFrame:
    """Aggregate rows as (run, metric, scope key, JSON)."""
    rest = [c for c in df.columns if c not in scope_cols]
    return df.select(
        run_id.alias("evaluation_run_id"),
        F.lit(metric).alias("metric_code"),
        F.concat_ws("/", *scope_cols).alias("scope_key"),
        F.to_json(F.struct(*rest)).alias("result_json"),
    )
