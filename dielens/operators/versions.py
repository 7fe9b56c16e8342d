"""Dataset versions, the current boundary, publishing and the audit trail.

Nothing is updated in place: each function gives the new state of a table,
and ``publish_snapshot`` makes it visible in one step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dielens.functions.columns import ntz
from dielens.functions.shuffles import join_sized, numbered, over_blocks, settled


def v_current_dataset_version(ds: DataFrame, dv: DataFrame) -> DataFrame:
    """Published and current versions with their dataset."""
    current = dv.where("status = 'PUBLISHED' AND is_current")
    return current.join(ds, "dataset_id")


def v_current_test_run(dv: DataFrame, dvr: DataFrame, runs: DataFrame) -> DataFrame:
    """Test runs that belong to a current version, with the version id."""
    current = dv.where("status = 'PUBLISHED' AND is_current").select("dataset_version_id")
    members = dvr.join(current, "dataset_version_id").dropDuplicates(["dataset_version_id", "processing_run_id"])
    return runs.join(members, "processing_run_id")


def _of_runs(facts: DataFrame, runs: DataFrame) -> DataFrame:
    member = runs.select("run_id", "dataset_version_id")
    return join_sized(facts, member, ["run_id"], "inner", null_safe=False)


def v_current_unit_result(current_runs: DataFrame, units: DataFrame) -> DataFrame:
    return _of_runs(units, current_runs)


def v_current_measurement(current_runs: DataFrame, meas: DataFrame) -> DataFrame:
    """Measurements of current runs.

    Facts carry their run id, so the boundary is applied with the short run
    list and the measurements never meet the unit table.
    """
    return _of_runs(meas, current_runs)


def read_pinned_version(facts: DataFrame, dvr: DataFrame, runs: DataFrame, version_ids: Sequence[int]) -> DataFrame:
    """Facts of explicitly named versions, superseded ones included."""
    members = dvr.where(F.col("dataset_version_id").isin(list(version_ids)))
    return _of_runs(facts, runs.join(members, "processing_run_id"))


def _switch(
    table: DataFrame, candidates: DataFrame, owner: str, row_id: str, waiting: Sequence[str], changes: dict[str, Column]
) -> DataFrame:
    """Make accepted candidates current and retire what was current for the same owner.

    An owner with two accepted candidates keeps its state: which one wins is
    not for the engine to guess.
    """
    accepted = candidates.where("can_publish").select(row_id).distinct()
    chosen = (
        table.where(F.col("status").isin(list(waiting)))
        .join(accepted, row_id)
        .groupBy(owner)
        .agg(F.min(row_id).alias("__new"), F.count(F.lit(1)).alias("__n"))
        .where("__n = 1")
        .drop("__n")
    )
    state = join_sized(table, chosen, [owner], "left", null_safe=False)
    promoted = F.coalesce(F.col("__new") == F.col(row_id), F.lit(False))
    retired = F.col("__new").isNotNull() & ~promoted & F.col("is_current")
    new = {
        "status": F.when(promoted, "PUBLISHED").when(retired, "SUPERSEDED").otherwise(F.col("status")),
        "is_current": F.when(promoted, True).when(retired, False).otherwise(F.col("is_current")),
        **{name: F.when(promoted, value).otherwise(F.col(name)) for name, value in changes.items()},
    }
    return state.withColumns(new).select(*table.columns)


def publish_version(dv: DataFrame, candidates: DataFrame, user: int, now: str) -> DataFrame:
    """The version table after publishing; ``candidates``: dataset_version_id, can_publish."""
    changes = {"published_by": F.lit(user).cast("long"), "published_at_utc": ntz(now)}
    return _switch(dv, candidates, "dataset_id", "dataset_version_id", ["DRAFT", "VALIDATING"], changes)


def publish_processing_run(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The same switch for the runs of one source file; ``candidates``: processing_run_id, can_publish."""
    return _switch(runs, candidates, "source_file_id", "processing_run_id", ["VALIDATING"], {})


def version_history(dv: DataFrame) -> DataFrame:
    """Every version with the counts of the one before it and the difference."""
    counts = ("row_count", "unit_count", "measurement_count")
    placed = numbered(dv, ["dataset_id"], [F.col("version_no")], F.floor(F.col("version_no") / 1000), "__pos")

    def before(window):
        return {f"previous_{c}": F.lag(c).over(window) for c in counts}

    chained = over_blocks(placed, ["dataset_id"], "__pos", 1, before).drop("__pos")
    return chained.withColumns({f"{c}_delta": F.col(c) - F.col(f"previous_{c}") for c in counts})


def merge_member_measurements(
    members: Sequence[DataFrame], keys: Sequence[str] = ("logical_unit_key", "test_item_id")
) -> tuple[DataFrame, DataFrame]:
    """All member runs as one logical dataset, and the keys more than one run delivers."""
    merged = reduce(DataFrame.unionByName, members)
    per_run = merged.groupBy(*keys, "run_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = (
        per_run.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_measurements"))
        .where("n_runs > 1")
    )
    return merged, repeated


def seed_upsert(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert if absent: existing rows are never touched, and a second call changes nothing."""
    absent = source.dropDuplicates(list(key)).join(target.select(*key), list(key), "left_anti")
    return target.unionByName(absent.select(*target.columns))


@dataclass
class Lookup:
    """How a code of the source becomes an id of the target: ``table`` has both, ``code`` names the column in the source."""

    table: DataFrame
    code: str
    table_code: str
    id: str


def seed_mapped(target: DataFrame, source: DataFrame, lookups: dict[str, Lookup], key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Insert if absent after codes have become ids: (the new target, the rows that could not be inserted).

    ``lookups`` maps a column of the target to its lookup.  A source row is UNRESOLVED where a code has no id, AMBIGUOUS
    where it has several, and CONFLICT where rows of one key differ in other columns; none of them is inserted.  Rows
    whose key the target has already are left alone, so a second call changes nothing.
    """
    rest = [c for c in target.columns if c not in key]
    rows = source
    for column, look in lookups.items():
        ids = look.table.groupBy(F.col(look.table_code).alias(look.code)).agg(
            F.countDistinct(look.id).alias(f"__n_{column}"), F.min(look.id).alias(column)
        )
        rows = join_sized(rows.drop(column), ids, [look.code], "left", null_safe=False)
    found = [F.coalesce(F.col(f"__n_{c}"), F.lit(0)) for c in lookups]
    unresolved, ambiguous = (reduce(Column.__or__, [test(n) for n in found], F.lit(False)) for test in (lambda n: n == 0, lambda n: n > 1))
    codes = [look.code for look in lookups.values()]
    named = settled(rows.withColumn("problem", F.when(unresolved, "UNRESOLVED").when(ambiguous, "AMBIGUOUS")), "seed")
    bad = named.where("problem IS NOT NULL").select(*codes, "problem").distinct()
    good = named.where("problem IS NULL")
    # repeats of one key are few: equal rows become one, different ones a conflict
    content = F.struct(*rest) if rest else F.lit(1)
    per_key = good.groupBy(*key).agg(
        F.countDistinct(content).alias("__n"), *[F.min(c).alias(c) for c in (*rest, *(c for c in codes if c not in (*rest, *key)))]
    )
    clashing = per_key.where("__n > 1").select(*codes, F.lit("CONFLICT").alias("problem"))
    absent = per_key.where("__n = 1").select(*target.columns).join(target.select(*key), list(key), "left_anti")
    return target.unionByName(absent), bad.unionByName(clashing)


def backfill_evaluation_run(evals: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill the missing run of historic evaluations where exactly one run fits; the rest is marked."""
    fitting = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("evaluation_run_id").alias("__run")
    )
    joined = join_sized(evals, fitting, list(keys), "left", null_safe=False)
    given = F.col("evaluation_run_id").isNotNull()
    how = (
        F.when(given, "GIVEN")
        .when(F.col("__n") == 1, "BACKFILLED")
        .when(F.col("__n") > 1, "SEVERAL_RUNS")
        .otherwise("NO_RUN")
    )
    found = F.coalesce(F.col("evaluation_run_id"), F.when(F.col("__n") == 1, F.col("__run")))
    return joined.withColumns({"backfill_status": how, "evaluation_run_id": found}).drop("__n", "__run")


def audit_diff(audit: DataFrame) -> DataFrame:
    """One row per field a governed action changed."""
    before, after = (F.from_json(c, "map<string,string>") for c in ("before_json", "after_json"))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    maps = audit.withColumns({"__b": F.coalesce(before, empty), "__a": F.coalesce(after, empty)})
    fields = F.array_union(F.map_keys("__b"), F.map_keys("__a"))
    rows = maps.select("audit_id", "operation", "__b", "__a", F.explode(fields).alias("field"))
    old, new = (F.element_at(m, F.col("field")) for m in ("__b", "__a"))
    return rows.select(
        "audit_id", "operation", "field", old.alias("old_value"), new.alias("new_value")
    ).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def audit_search(audit: DataFrame, since: str | None = None, until: str | None = None, **equal: str) -> DataFrame:
    """Governed actions by actor, operation, entity_type, entity_id or correlation_id, newest first."""
    found = audit
    for column, value in equal.items():
        found = found.where(F.col(column) == value)
    if since:
        found = found.where(F.col("occurred_at_utc") >= ntz(since))
    if until:
        found = found.where(F.col("occurred_at_utc") < ntz(until))
    return found.orderBy(F.desc("occurred_at_utc"), F.desc("audit_id"))


def retention_due(derived: DataFrame, now: str) -> DataFrame:
    """Derived rows or exports past their expiry; facts have none and never qualify."""
    return derived.where(F.col("expires_at_utc") <= ntz(now))


def publish_snapshot(df: DataFrame, root: str) -> str:
    """Write the next snapshot of a state table; it exists for readers once it is complete.

    The commit marker Spark writes last is the switch.  One writer at a time
    is assumed.
    """
    done = _snapshots(df.sparkSession, root)
    path = f"{root.rstrip('/')}/snapshot={max(done, default=0) + 1:08d}"
    df.write.mode("overwrite").parquet(path)
    return path


def current_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete snapshot."""
    done = _snapshots(spark, root)
    if not done:
        raise FileNotFoundError(f"no complete snapshot below {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/snapshot={max(done):08d}")


def _snapshots(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the snapshots that have a commit marker."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/snapshot=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [int(status.getPath().getParent().getName().split("=")[1]) for status in found]
