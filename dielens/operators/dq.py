"""Data-quality rules, the publish gate and generic constraint checks.

A rule returns issue rows: rule_code, scope_type, scope_key, run_id,
entity_type, entity_key, source_column, source_row_no, raw_value, message.  The
scope says what the finding stands against: a RUN, a FILE, a BATCH, a LOT, or
ALL.  Severity comes from the pinned rule-set version in ``dq_issues``;
``scope_closure`` brings every scope down to runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dielens.functions.columns import any_of, share
from dielens.functions.shuffles import join_sized, settled

RUN = ("RUN", "run_id")
ALL = ("ALL", None)


def _issues(
    df: DataFrame,
    code: str,
    entity_type: str,
    entity_key: Column | str,
    message: Column | str,
    column: Column | str | None = None,
    raw: Column | str | None = None,
    scope: tuple[str, str | None] = RUN,
) -> DataFrame:
    def text(value) -> Column:
        value = F.lit(value) if value is None or isinstance(value, str) else value
        return value.cast("string")

    key = F.col(entity_key) if isinstance(entity_key, str) else entity_key
    kind, scope_column = scope
    scope_key = (F.col(scope_column) if scope_column else F.lit(None)).cast("string")
    row = F.col("source_row_no") if "source_row_no" in df.columns else F.lit(None)
    return df.select(
        F.lit(code).alias("rule_code"),
        F.lit(kind).alias("scope_type"),
        scope_key.alias("scope_key"),
        (scope_key if kind == "RUN" else F.lit(None).cast("string")).alias("run_id"),
        F.lit(entity_type).alias("entity_type"),
        key.cast("string").alias("entity_key"),
        text(column).alias("source_column"),
        row.cast("long").alias("source_row_no"),
        (F.col(raw) if isinstance(raw, str) else text(raw)).cast("string").alias("raw_value"),
        text(message).alias("message"),
    )


def dq_unknown_format(detected: DataFrame) -> DataFrame:
    bad = detected.where("detection_status <> 'DETECTED'")
    return _issues(bad, "DQ_UNKNOWN_FORMAT", "receipt", "receipt_id", F.col("detection_status"), raw="candidates", scope=("FILE", "receipt_id"))


def dq_mixed_format_version(conflicts: DataFrame) -> DataFrame:
    return _issues(
        conflicts, "DQ_MIXED_FORMAT_VERSION", "import_batch", "import_batch_id", F.col("kind"), raw="n_values", scope=("BATCH", "import_batch_id")
    )


def dq_unknown_identity(units: DataFrame, fields: Sequence[str]) -> DataFrame:
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in fields])), ",")
    bad = units.withColumn("__missing", missing).where("__missing <> ''")
    return _issues(bad, "DQ_UNKNOWN_IDENTITY", "unit", "unit_id", "identity is incomplete", column=F.col("__missing"))


def dq_unknown_unit(used_units: DataFrame, factors: DataFrame) -> DataFrame:
    """``used_units``: run_id, source_column, unit_raw.  One issue per run, column and unit."""
    seen = used_units.select("run_id", "source_column", "unit_raw").distinct()
    bad = seen.join(factors.select("unit_raw"), "unit_raw", "left_anti")
    key = F.concat_ws("/", "run_id", "source_column")
    return _issues(bad, "DQ_UNKNOWN_UNIT", "test_item", key, "no conversion rule", F.col("source_column"), "unit_raw")


def dq_spec_ambiguous(resolved: DataFrame, key: Sequence[str]) -> DataFrame:
    bad = resolved.where("binding_status = 'CONFIG_AMBIGUOUS'").select(*key, "run_id", "n_candidates").distinct()
    return _issues(bad, "DQ_SPEC_AMBIGUOUS", "context", F.concat_ws("/", *key), "several bindings at top priority", raw="n_candidates")


def dq_bin_rule_unknown(bins: DataFrame) -> DataFrame:
    bad = bins.where("mapping_status <> 'MATCHED'").select("run_id", "soft_bin", "mapping_status").distinct()
    key = F.concat_ws("/", "run_id", F.coalesce("soft_bin", F.lit("")))
    return _issues(bad, "DQ_BIN_RULE_UNKNOWN", "bin", key, F.col("mapping_status"), "soft_bin", "soft_bin")


def dq_row_reconciliation(counts: DataFrame, items: DataFrame) -> DataFrame:
    """Source rows must equal units, and measurements must equal units times the items of the run's own program.

    ``items``: run_id, n_items.  A run whose program has no item list breaks the contract.
    """
    counts = counts.join(items.select("run_id", "n_items"), "run_id", "left")
    broken = (F.col("row_count_input") != F.col("unit_count_output")) | ~F.coalesce(
        F.col("measurement_count_output") == F.col("unit_count_output") * F.col("n_items"), F.lit(False)
    )
    found = F.concat_ws("/", "row_count_input", "unit_count_output", "measurement_count_output")
    return _issues(counts.where(broken), "DQ_ROW_RECONCILIATION", "run", "run_id", "row counts break the contract", raw=found)


def dq_unknown_timezone(runs: DataFrame) -> DataFrame:
    """Unknown zone, and use of the supplier's default, are both shown; neither blocks."""
    bad = runs.where("timezone_resolution IN ('UNKNOWN', 'SUPPLIER_DEFAULT')")
    return _issues(bad, "DQ_UNKNOWN_TIMEZONE", "run", "unit_id", F.col("timezone_resolution"), raw="source_timezone_iana")


def dq_duplicate_cp_coordinate(units: DataFrame) -> DataFrame:
    keys = ["run_id", "x_coord", "y_coord", "attempt_no"]
    placed = units.where(F.col("x_coord").isNotNull() & F.col("y_coord").isNotNull())
    twice = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _issues(twice, "DQ_DUPLICATE_CP_COORDINATE", "die", F.concat_ws("/", *keys), "position repeated in one attempt", raw="n")


def dq_missing_bin(units: DataFrame) -> DataFrame:
    blank = F.col("soft_bin").isNull() | (F.trim("soft_bin") == "")
    return _issues(units.where(blank), "DQ_MISSING_BIN", "unit", "unit_id", "bin is blank", "soft_bin", "soft_bin")


def _status_share(meas: DataFrame, status: str, keys: Sequence[str]) -> DataFrame:
    hit = F.count_if(F.col("measurement_status") == status)
    return meas.groupBy(*keys).agg(share(hit, F.count(F.lit(1))).alias("__share"))


def dq_invalid_numeric_value(meas: DataFrame, limit: float) -> DataFrame:
    """Runs whose share of unreadable numbers is above the rule parameter."""
    bad = _status_share(meas, "INVALID", ["run_id"]).where(F.col("__share") > limit)
    return _issues(bad, "DQ_INVALID_NUMERIC_VALUE", "run", "run_id", "too many unreadable numbers", raw=F.round("__share", 6))


def dq_ft_missing_stable_unit_id(units: DataFrame) -> DataFrame:
    return _issues(
        units.where("serial_no IS NULL"), "DQ_FT_MISSING_STABLE_UNIT_ID", "unit", "unit_id", "no serial number", "serial_no"
    )


def dq_unparseable_time(rows: DataFrame, column: str, fmt: str, key: str, run: str) -> DataFrame:
    bad = rows.where(F.col(column).isNotNull() & F.try_to_timestamp(F.col(column), F.lit(fmt)).isNull())
    return _issues(bad, "DQ_UNPARSEABLE_TIME", "row", key, "time cannot be read", column, column, ("RUN", run))


def dq_test_item_conflict(items: DataFrame, keys: Sequence[str], definition: Sequence[str]) -> DataFrame:
    """One item key with more than one definition; definitions are de-duplicated before they are counted."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in definition]
    distinct = items.select(*keys, F.concat_ws("|", *texts).alias("__definition")).distinct()
    twice = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _issues(twice, "DQ_TEST_ITEM_CONFLICT", "test_item", F.concat_ws("/", *keys), "definitions differ", raw="n", scope=ALL)


def dq_not_tested_ratio(meas: DataFrame, limit: float) -> DataFrame:
    keys = ["run_id", "parameter_code"]
    bad = _status_share(meas, "NOT_TESTED", keys).where(F.col("__share") > limit)
    return _issues(
        bad,
        "DQ_NOT_TESTED_RATIO",
        "parameter",
        F.concat_ws("/", *keys),
        "unusual share not tested",
        F.col("parameter_code"),
        F.round("__share", 6),
    )


def dq_corrupt_file(manifest: DataFrame) -> DataFrame:
    """Empty files and files whose content does not have the announced hash."""
    empty = F.coalesce(F.length("content"), F.lit(0)) == 0
    changed = F.sha2("content", 256) != F.col("announced_sha256")
    bad = manifest.withColumn("__why", F.when(empty, "empty").when(changed, "hash mismatch")).where("__why IS NOT NULL")
    return _issues(bad, "DQ_CORRUPT_FILE", "receipt", "receipt_id", F.col("__why"), scope=("FILE", "receipt_id"))


def dq_issues(issue_frames: Sequence[DataFrame], rule_version: DataFrame, version: str | None = None) -> DataFrame:
    """All issues with the severity, blocking and waivable flags of the pinned rule-set version, which stands on each row.

    A rule that the version does not have counts as a BLOCKER nobody may waive.
    """
    everything = reduce(DataFrame.unionByName, issue_frames)
    rules = rule_version.select("rule_code", "severity", "is_blocking", "waivable")
    return everything.join(rules, "rule_code", "left").withColumns(
        {
            "severity": F.coalesce("severity", F.lit("BLOCKER")),
            "is_blocking": F.coalesce("is_blocking", F.lit(True)),
            "waivable": F.coalesce("waivable", F.lit(False)),
            "rule_set_version": F.lit(version),
        }
    )


def scope_closure(runs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(scope_type, scope_key, run_id): the runs each scope stands for.

    ``runs``: run_id, lot_id, receipt_id (null: no file); ``files``: receipt_id, import_batch_id.  A file or batch that
    no run came from is known, with a null run: its findings concern no run.
    """
    own = runs.select(*[F.col(c).cast("string").alias(c) for c in ("run_id", "lot_id", "receipt_id")]).distinct()
    by = [
        own.select(F.lit("RUN").alias("scope_type"), F.col("run_id").alias("scope_key"), "run_id"),
        own.select(F.lit("LOT").alias("scope_type"), F.col("lot_id").alias("scope_key"), "run_id"),
    ]
    if files is not None:
        named = files.select(*[F.col(c).cast("string").alias(c) for c in ("receipt_id", "import_batch_id")]).distinct()
        of_file = named.join(own.select("receipt_id", "run_id"), "receipt_id", "left")
        by.append(of_file.select(F.lit("FILE").alias("scope_type"), F.col("receipt_id").alias("scope_key"), "run_id"))
        by.append(of_file.select(F.lit("BATCH").alias("scope_type"), F.col("import_batch_id").alias("scope_key"), "run_id"))
    return reduce(DataFrame.unionByName, by).distinct()


def _in_scope(issues: DataFrame) -> DataFrame:
    if "scope_type" in issues.columns:
        return issues
    return issues.withColumns({"scope_type": F.lit("RUN"), "scope_key": F.col("run_id").cast("string")})


_SEVERITIES = ("BLOCKER", "ERROR", "WARNING", "INFO")


def dq_summary(issues: DataFrame, closure: DataFrame) -> DataFrame:
    """Issues per run and resolution, one column per severity.

    An issue counts in every run its scope stands for; those that stand for no run, or for all, are in the row of the null run.
    """
    names = [s.lower() for s in _SEVERITIES]
    counted = _in_scope(issues).groupBy("scope_type", "scope_key", "resolution_status").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in _SEVERITIES]
    )
    return (
        counted.join(closure, ["scope_type", "scope_key"], "left")
        .groupBy("run_id", "resolution_status")
        .agg(*[F.sum(n).alias(n) for n in names])
    )


def publish_gate(issues: DataFrame, reconciliation: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """Whether a run may be published, with counts of what stands against it.

    ``reconciliation``: run_id, reconciled.  A waived ERROR passes only where its rule allows waiving; a BLOCKER never
    does.  ``scopes`` (:func:`scope_closure`) names the runs of each scope; every run is a scope of its own.  Issues
    are counted per scope once, and the counts are carried down to the runs.  An issue of a scope nobody knows, and one
    of scope ALL, stands against all runs, so the gate fails closed.
    """
    severity, state = F.col("severity"), F.col("resolution_status")
    blocker = (severity == "BLOCKER") & (state != "RESOLVED")
    error = (severity == "ERROR") & ((state == "OPEN") | ((state != "RESOLVED") & ~F.col("waivable")))
    rule = F.col("is_blocking") & ~severity.isin("BLOCKER", "ERROR") & (state == "OPEN")
    rule = rule | (F.col("is_blocking") & (severity == "ERROR") & (state == "IGNORED"))
    names = ["n_blockers", "n_errors", "n_blocking_rules"]
    keys = ["scope_type", "scope_key"]
    counted = _in_scope(issues).groupBy(*keys).agg(
        *[F.count_if(c).alias(n) for c, n in zip((blocker, error, rule), names, strict=True)]
    )
    counted = settled(counted.where(" + ".join(names) + " > 0"), "gate")
    # few rows, each of which may take a pass over all facts to find
    reconciliation = settled(reconciliation, "gate-runs")
    runs = reconciliation.select(F.lit("RUN").alias("scope_type"), F.col("run_id").cast("string").alias("scope_key"), "run_id")
    if scopes is not None:
        typed = scopes if "scope_type" in scopes.columns else scopes.withColumn("scope_type", F.lit("RUN"))
        runs = runs.unionByName(typed.select("scope_type", F.col("scope_key").cast("string").alias("scope_key"), "run_id")).distinct()
        runs = settled(runs, "gate-scopes")
    lost = counted.join(runs, keys, "left_anti").agg(F.coalesce(F.sum(F.expr(" + ".join(names))), F.lit(0))).scalar()
    down = counted.join(runs, keys).groupBy("run_id").agg(*[F.sum(n).alias(n) for n in names])
    joined = reconciliation.join(down, "run_id", "left").fillna(0, names)
    clear = F.col("n_blockers") + F.col("n_errors") + F.col("n_blocking_rules") == 0
    return joined.withColumn("can_publish", clear & (lost == 0) & F.coalesce("reconciled", F.lit(False)))


def dq_waiver_violations(issues: DataFrame) -> DataFrame:
    """Waivers nobody may give: of a non-waivable rule, or of any BLOCKER (waived or ignored)."""
    state, blocker = F.col("resolution_status"), F.col("severity") == "BLOCKER"
    why = F.when(blocker & state.isin("WAIVED", "IGNORED"), F.concat(F.lit("BLOCKER_"), state)).when(
        (state == "WAIVED") & ~F.col("waivable"), "NOT_WAIVABLE"
    )
    return issues.withColumn("violation", why).where("violation IS NOT NULL")


def unique_violations(df: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Keys that occur more than once, optionally only among the rows of a filtered constraint."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fk_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose reference is set and has no parent.

    The distinct references are tested first; only the missing ones meet the
    child rows again.
    """
    references = child.where(F.col(fk).isNotNull()).select(fk).distinct()
    missing = references.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
    return join_sized(child, missing, [fk], "left_semi", null_safe=False)


def check_violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row per key and failed check; a null check passes, as in SQL."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in checks.items()])
    )
    return (
        df.where(any_of([~F.coalesce(ok, F.lit(True)) for ok in checks.values()]))
        .select(F.col(key).cast("string").alias("row_key"), F.explode(failed).alias("check_name"))
    )


def valid_json(column: str) -> Column:
    return F.col(column).isNull() | F.try_parse_json(F.col(column)).isNotNull()


@dataclass
class Level:
    """One level of a reconciliation: the same columns from both sides, some of which are the key."""

    name: str
    observed: DataFrame
    expected: DataFrame
    keys: Sequence[str]


def golden_reconcile(levels: Sequence[Level], buckets: int = 4096) -> DataFrame:
    """Differences between observed and approved rows at every level, in both directions.

    Each side is folded into one digest for each bucket of keys: the number of rows and the sum of their hashes.  Only
    the keys of buckets whose digests differ are brought together, so equal data is read and summed but not exchanged.
    Result: level, entity_key, problem (MISSING, EXTRA, CHANGED), observed and expected (the other columns as text, or
    the number of rows where a key is repeated).
    """
    found = []
    for level in levels:
        values = [c for c in level.expected.columns if c not in level.keys]

        def marked(df: DataFrame, level=level, values=values) -> DataFrame:
            def text(names) -> Column:
                return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names])

            rows = df.select(text(level.keys).alias("entity_key"), text(values).alias("text"))
            # sums of 64-bit hashes, wide enough not to overflow
            return rows.withColumns(
                {
                    "bucket": F.pmod(F.xxhash64("entity_key"), F.lit(buckets)),
                    "hash": F.xxhash64("entity_key", "text").cast("decimal(38,0)"),
                }
            )

        observed, expected = marked(level.observed), marked(level.expected)

        def digest(rows: DataFrame, name: str) -> DataFrame:
            return rows.groupBy("bucket").agg(F.struct(F.count("*"), F.sum("hash")).alias(name))

        both = digest(observed, "o").join(digest(expected, "e"), "bucket", "full")
        differing = settled(both.where("NOT (o <=> e)").select("bucket"), "reconcile")

        def opened(rows: DataFrame, name: str, differing=differing) -> DataFrame:
            n = F.count("*")
            shown = F.when(n == 1, F.max("text")).otherwise(F.concat(n.cast("string"), F.lit(" rows")))
            inside = rows.join(differing, "bucket", "left_semi")
            return inside.groupBy("entity_key").agg(shown.alias(name), F.struct(n, F.sum("hash")).alias(f"__{name}"))

        sides = opened(observed, "observed").join(opened(expected, "expected"), "entity_key", "full")
        problem = F.when(F.col("__observed").isNull(), "MISSING").when(F.col("__expected").isNull(), "EXTRA").otherwise("CHANGED")
        found.append(
            sides.where("NOT (__observed <=> __expected)").select(
                F.lit(level.name).alias("level"), "entity_key", problem.alias("problem"), "observed", "expected"
            )
        )
    return reduce(DataFrame.unionByName, found)
