"""Attempts, retest, yield and bin reports.

A unit row needs ``unit_id``, ``logical_unit_key`` and the attempt order
(``run_attempt_no``, ``attempt_no`` and ``unit_sequence`` or ``source_row_no``).
Reports also need ``outcome``: PASS, FAIL or UNRESOLVED, as given by
``evaluate_bin`` or ``result_outcome``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dielens.functions.columns import share
from dielens.functions.moments import pair_moments
from dielens.functions.shuffles import settled, top_one


def _attempt_order(df: DataFrame, descending: bool) -> list[Column]:
    present = [c for c in ("unit_sequence", "source_row_no") if c in df.columns]
    columns = [c for c in ("run_attempt_no", "attempt_no") if c in df.columns]
    order = [F.col(c) for c in columns] + [F.coalesce(*present), F.col("unit_id")]
    return [c.desc() if descending else c.asc() for c in order]


def result_outcome(units: DataFrame) -> DataFrame:
    """Outcome from the tester's overall result (final-test PASS/FAIL views)."""
    result = F.col("overall_result")
    return units.withColumn("outcome", F.when(result.isin("PASS", "FAIL"), result).otherwise("UNRESOLVED"))


def first_pass_units(units: DataFrame) -> DataFrame:
    return top_one(units, ["logical_unit_key"], _attempt_order(units, False))


def final_units(units: DataFrame) -> DataFrame:
    """The largest (run attempt, unit attempt, source sequence), not the largest attempt number."""
    return top_one(units, ["logical_unit_key"], _attempt_order(units, True))


def final_units_disposition(units: DataFrame, flag: str, final_value: str, rule_version: str) -> DataFrame:
    """An explicit vendor flag wins; the tuple decides among rows that are equal in it."""
    flagged = F.coalesce(F.col(flag) == final_value, F.lit(False))
    chosen = top_one(
        units, ["logical_unit_key"], [flagged.desc(), *_attempt_order(units, True)]
    )
    return chosen.withColumns(
        {
            "selected_by": F.when(flagged, "VENDOR_FLAG").otherwise("ATTEMPT_ORDER"),
            "disposition_rule": F.lit(rule_version),
        }
    )


def all_attempts(units: DataFrame) -> DataFrame:
    """Every attempt, marked ``is_first`` and ``is_final``.

    The attempts of a unit are few, so both ranks come from one exchange.
    """
    def leads(last: bool) -> Column:
        window = Window.partitionBy("logical_unit_key").orderBy(*_attempt_order(units, last))
        return F.row_number().over(window) == 1

    return units.withColumns({"is_first": leads(False), "is_final": leads(True)})


def by_basis(units: DataFrame, basis: str) -> DataFrame:
    """Units under a named attempt basis: ``first``, ``final`` or ``all``."""
    chosen = {"first": first_pass_units, "final": final_units, "all": lambda u: u}
    return chosen[basis](units)


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("outcome") == "PASS").alias("n_pass"),
        F.count_if(F.col("outcome") == "FAIL").alias("n_fail"),
        F.count_if(F.col("outcome") == "UNRESOLVED").alias("unresolved"),
    ]


def yield_by(units: DataFrame, keys: Sequence[str], basis: str = "final") -> DataFrame:
    return (
        by_basis(units, basis)
        .groupBy(*keys)
        .agg(*_counts())
        .withColumns({"yield": share(F.col("n_pass"), F.col("total")), "basis": F.lit(basis)})
    )


def yield_rollup(units: DataFrame, keys: Sequence[str], basis: str = "final") -> DataFrame:
    """Subtotals of a hierarchy in one pass; ``level`` is 0 for the full key.

    The finest level is aggregated first, so the rollup multiplies group rows
    and not units.
    """
    fine = by_basis(units, basis).groupBy(*keys).agg(*_counts())
    sums = [F.sum(c).alias(c) for c in ("total", "n_pass", "n_fail", "unresolved")]
    return (
        fine.rollup(*keys)
        .agg(*sums, F.grouping_id().alias("level"))
        .withColumns({"yield": share(F.col("n_pass"), F.col("total")), "basis": F.lit(basis)})
    )


def retest_gain(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First-pass and final yield, and the units recovered or lost by retest, in one pass.

    The outcome of the two ends of a unit's attempt order is taken with
    mergeable aggregates, so the unit rows are shuffled once for both bases.
    """
    order = F.struct(*_plain_order(units))
    ends = units.groupBy(*keys, "logical_unit_key").agg(
        F.min_by("outcome", order).alias("first_outcome"),
        F.max_by("outcome", order).alias("final_outcome"),
    )
    first_ok, final_ok = F.col("first_outcome") == "PASS", F.col("final_outcome") == "PASS"
    return (
        ends.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(first_ok).alias("first_pass"),
            F.count_if(final_ok).alias("final_pass"),
            F.count_if(~first_ok & final_ok).alias("recovered"),
            F.count_if(first_ok & ~final_ok).alias("lost"),
        )
        .withColumns(
            {
                "first_yield": share(F.col("first_pass"), F.col("total")),
                "final_yield": share(F.col("final_pass"), F.col("total")),
            }
        )
    )


def _plain_order(df: DataFrame) -> list[Column]:
    present = [c for c in ("unit_sequence", "source_row_no") if c in df.columns]
    columns = [F.col(c) for c in ("run_attempt_no", "attempt_no") if c in df.columns]
    return [*columns, F.coalesce(*present).alias("source_sequence"), F.col("unit_id")]


def yield_trend(
    units: DataFrame, keys: Sequence[str], period: str, instant: str = "tested_at_utc", basis: str = "final"
) -> DataFrame:
    """Yield per period with the change from the period before; the window runs over the aggregate."""
    per_period = (
        by_basis(units, basis)
        .groupBy(*keys, F.date_trunc(period, instant).cast("timestamp_ntz").alias("period_start"))
        .agg(*_counts())
        .withColumn("yield", share(F.col("n_pass"), F.col("total")))
    )
    before = F.lag("yield").over(Window.partitionBy(*keys).orderBy("period_start"))
    return per_period.withColumns({"yield_change": F.col("yield") - before, "basis": F.lit(basis)})


def result_counts(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    result = F.col("overall_result")
    return units.groupBy(*keys).agg(
        *[F.count_if(result == r).alias(r.lower()) for r in ("PASS", "FAIL", "ABORT", "UNKNOWN")]
    )


def bin_summary(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units per raw bin and the meaning it was given."""
    return units.groupBy(*keys, "soft_bin", "mapping_status", "failure_mode_snapshot", "is_pass_snapshot").agg(
        F.count(F.lit(1)).alias("n_units")
    )


def wafer_yield_wide(units: DataFrame, bins: Sequence[str], basis: str = "final") -> DataFrame:
    """One row per wafer, one column per listed fail bin; the list comes from metadata.

    ``fail_other`` keeps the fail units of unlisted bins, so the row still adds up.
    """
    failed = F.col("outcome") == "FAIL"
    columns = [F.count_if(failed & (F.col("soft_bin") == b)).alias(f"fail_bin_{b}") for b in bins]
    other = F.count_if(failed & ~F.coalesce(F.col("soft_bin").isin(list(bins)), F.lit(False)))
    return (
        by_basis(units, basis)
        .groupBy("lot_id", "wafer_id")
        .agg(*_counts(), *columns, other.alias("fail_other"))
        .withColumn("yield", share(F.col("n_pass"), F.col("total")))
    )


def _pareto(counts: DataFrame, keys: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Share, cumulative share and rank over per-item counts (a handful of rows per key)."""
    order = [F.desc("n"), *item]
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    running = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns(
        {
            "share": F.col("n") / F.sum("n").over(whole),
            "cum_share": F.sum("n").over(running) / F.sum("n").over(whole),
            "rank": F.row_number().over(whole.orderBy(*order)),
        }
    )


def bin_pareto(units: DataFrame, keys: Sequence[str], basis: str = "final") -> DataFrame:
    failed = by_basis(units, basis).where("outcome = 'FAIL'")
    counts = failed.groupBy(*keys, "soft_bin").agg(F.count(F.lit(1)).alias("n"))
    return _pareto(counts, keys, ["soft_bin"])


def fail_item_pareto(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Failing units by the first test they failed."""
    failed = units.where(F.col("fail_test_no").isNotNull())
    counts = failed.groupBy(*keys, "fail_test_no").agg(F.count(F.lit(1)).alias("n"))
    return _pareto(counts, keys, ["fail_test_no"])


def bin_cooccurrence(units: DataFrame, bins: Sequence[str], keys: Sequence[str] = ("product_code",)) -> DataFrame:
    """How often two of the bins fall on the same die position of different wafers; pairs follow the order of the list.

    Positions are reduced to one count per bin first; the number of unit pairs
    is the product of two counts, summed block by block (:func:`pair_moments`),
    so no pair of units is ever produced and no pair of bins is an expression.
    """
    names = units.sparkSession.createDataFrame(list(enumerate(bins)), "i int, soft_bin string")
    counted = units.join(F.broadcast(names), "soft_bin").groupBy(*keys, "x_coord", "y_coord", "i").agg(
        F.count("*").cast("double").alias("v")
    )
    per_position = counted.groupBy(*keys, "x_coord", "y_coord").agg(F.collect_list(F.struct("i", "v")).alias("entries"))
    label = F.array(*[F.lit(b) for b in bins])
    return pair_moments(per_position, keys, len(bins)).where("n > 0").select(
        *keys,
        F.get(label, F.col("i")).alias("bin_a"),
        F.get(label, F.col("j")).alias("bin_b"),
        F.col("n").alias("n_positions"),
        F.round("sxy").cast("long").alias("n_pairs"),
    )


def compare_groups(units: DataFrame, by: Sequence[str]) -> DataFrame:
    """Yield and parameter value side by side per tester, site, program, condition or batch."""
    return (
        units.groupBy(*by)
        .agg(
            *_counts(),
            F.avg("value_numeric").alias("mean_value"),
            F.stddev_samp("value_numeric").alias("std_value"),
        )
        .withColumn("yield", share(F.col("n_pass"), F.col("total")))
    )


def wafer_summary(units: DataFrame, meas: DataFrame, params: Sequence[str], basis: str = "final") -> DataFrame:
    """One row per wafer: dice, yield, worst fail bin, mean and deviation of the listed parameters, all over the same attempts.

    The chosen attempts are settled; both sides are aggregated to wafers before
    they meet.
    """
    wafer = ["lot_id", "wafer_id"]
    chosen = settled(by_basis(units, basis).select("unit_id", *wafer, "outcome", "soft_bin"), "wafers")
    per_bin = (
        chosen
        .groupBy(*wafer, "outcome", "soft_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    failed = F.col("outcome") == "FAIL"
    base = (
        per_bin.groupBy(*wafer)
        .agg(
            F.sum("n").alias("total"),
            F.sum(F.when(F.col("outcome") == "PASS", F.col("n")).otherwise(0)).alias("n_pass"),
            F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_fail"),
            F.min_by(
                F.when(failed, F.col("soft_bin")), F.when(failed, F.struct(-F.col("n"), "soft_bin"))
            ).alias("top_fail_bin"),
        )
        .withColumn("yield", share(F.col("n_pass"), F.col("total")))
    )
    ok = F.col("measurement_status") == "MEASURED"
    stats = []
    for p in params:
        value = F.when(ok & (F.col("parameter_code") == p), F.col("value_numeric"))
        stats += [F.avg(value).alias(f"mean_{p.lower()}"), F.stddev_samp(value).alias(f"std_{p.lower()}")]
    listed = meas.where(F.col("parameter_code").isin(list(params)))
    of_units = listed.select("unit_id", "parameter_code", "measurement_status", "value_numeric").join(
        chosen.select("unit_id", *wafer), "unit_id"
    )
    values = of_units.groupBy(*wafer).agg(*stats)
    return base.join(values, wafer, "left").withColumn("basis", F.lit(basis))


_STATUSES = (
    "MEASURED",
    "OVER_RANGE",
    "UNDER_RANGE",
    "NOT_TESTED",
    "MISSING",
    "INVALID",
    "NOT_APPLICABLE",
)


def not_tested_matrix(meas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of every measurement status per parameter."""
    status = F.col("measurement_status")
    return meas.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        *[(F.count_if(status == s) / F.count(F.lit(1))).alias(s.lower()) for s in _STATUSES],
    )


def out_of_spec_rate(evals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FAIL share among judged measurements; the rest is counted beside it."""
    result = F.col("evaluation_result")
    judged = F.count_if(result.isin("PASS", "FAIL"))
    return evals.groupBy(*keys).agg(
        judged.alias("n_judged"),
        F.count_if(result == "FAIL").alias("n_fail"),
        F.count_if(~result.isin("PASS", "FAIL")).alias("n_not_judged"),
        share(F.count_if(result == "FAIL"), judged).alias("fail_rate"),
    )
