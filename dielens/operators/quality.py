"""Part-average limits, statistical bin and yield limits, control charts.

Formulas follow AEC-Q001, AEC-Q002 and Montgomery's individuals chart; their
parameters come from a rule version and stay on every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dielens.functions.columns import measured
from dielens.functions.shuffles import exact_quantiles, join_null_safe, join_sized, numbered, over_blocks, settled
from dielens.operators.rules import evaluate_multi_scope
from dielens.operators.stats import QUARTILES

# Control chart constants for moving ranges of two.
IMR_LIMIT = 2.66
MR_LIMIT = 3.267
# Fixed value: quartile distance of a normal distribution in standard deviations.
QUARTILE_SIGMA = 1.35


def pat_limits(baseline: DataFrame, keys: Sequence[str], rule_version: str, baseline_id: str, k: float = 6.0) -> DataFrame:
    """Median plus and minus k robust deviations; with the lot among the keys the limits are dynamic."""
    used = baseline.where(measured())
    box = exact_quantiles(used, keys, "value_numeric", QUARTILES)
    sigma = (F.col("p75") - F.col("p25")) / QUARTILE_SIGMA
    return box.select(
        *keys,
        F.col("n").alias("n_baseline"),
        F.col("p50").alias("robust_mean"),
        sigma.alias("robust_sigma"),
        (F.col("p50") - k * sigma).alias("pat_lower"),
        (F.col("p50") + k * sigma).alias("pat_upper"),
        F.lit(rule_version).alias("rule_version"),
        F.lit(baseline_id).alias("baseline_id"),
    )


def evaluate_pat(meas: DataFrame, limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PAT result rows next to, and never instead of, the spec result; the baseline is the scope key."""
    placed = join_sized(meas, limits, keys, "left")
    value, low, high = F.col("value_numeric"), F.col("pat_lower"), F.col("pat_upper")
    result = (
        F.when(low.isNull(), "NO_MATCH")
        .when(F.col("measurement_status") == "INVALID", "INVALID_VALUE")
        .when(~measured(), "NOT_EVALUATED")
        .when((value < low) | (value > high), "FAIL")
        .otherwise("PASS")
    )
    return placed.withColumns(
        {
            "evaluation_type": F.lit("PAT"),
            "evaluation_scope_key": F.col("baseline_id"),
            "evaluation_result": result,
        }
    )


def sbl_syl_limits(lot_rates: DataFrame, keys: Sequence[str], rule_version: str, baseline: Column) -> DataFrame:
    """Statistical limits of a lot-level rate over the baseline lots, and every lot held against them.

    ``lot_rates``: keys, lot_id, rate, kind (YIELD looks for low lots, BIN for
    high ones).  Lots are aggregates, so the table is short.
    """
    history = lot_rates.where(baseline).groupBy(*keys, "kind").agg(
        F.count(F.lit(1)).alias("n_baseline_lots"), F.avg("rate").alias("mean_rate"), F.stddev_samp("rate").alias("std_rate")
    )
    joined = join_null_safe(lot_rates, history, [*keys, "kind"], "left")
    sign = F.when(F.col("kind") == "YIELD", -1).otherwise(1)
    first, second = (F.col("mean_rate") + sign * n * F.col("std_rate") for n in (3, 4))
    beyond = [(F.col("rate") - limit) * sign > 0 for limit in (first, second)]
    flag = (
        F.when(F.col("std_rate").isNull(), "NO_BASELINE")
        .when(beyond[1], "BEYOND_LIMIT_2")
        .when(beyond[0], "BEYOND_LIMIT_1")
        .otherwise("WITHIN")
    )
    return joined.withColumns(
        {"limit_1": first, "limit_2": second, "flag": flag, "rule_version": F.lit(rule_version)}
    )


def evaluate_safe_launch(
    meas: DataFrame, limits: DataFrame, scope_key: str, factors: DataFrame | None = None
) -> DataFrame:
    """The spec comparison under a tightened limit set, as its own evaluation type; limits with a unit are converted."""
    scoped = limits.withColumns(
        {"evaluation_type": F.lit("SAFE_LAUNCH"), "evaluation_scope_key": F.lit(scope_key)}
    )
    return evaluate_multi_scope(meas, scoped, factors)


def spc_imr(
    series: DataFrame, keys: Sequence[str], order: Sequence[Column], pieces: Column | None, rule_version: str
) -> DataFrame:
    """Individuals and moving-range chart points with centre line, limits and an out-of-control flag.

    ``pieces`` as in :func:`numbered`.
    """
    placed = numbered(series.where(measured()), keys, order, pieces, "position")

    def ranges(window):
        return {"moving_range": F.abs(F.col("value_numeric") - F.lag("value_numeric").over(window))}

    points = settled(over_blocks(placed, keys, "position", 1, ranges))
    lines = points.groupBy(*keys).agg(
        F.avg("value_numeric").alias("centre"),
        F.avg("moving_range").alias("mr_mean"),
        F.count(F.lit(1)).alias("n_points"),
    )
    charted = join_sized(points, lines, keys, "inner")
    ucl = F.col("centre") + IMR_LIMIT * F.col("mr_mean")
    lcl = F.col("centre") - IMR_LIMIT * F.col("mr_mean")
    mr_ucl = MR_LIMIT * F.col("mr_mean")
    value = F.col("value_numeric")
    out = (value > ucl) | (value < lcl) | F.coalesce(F.col("moving_range") > mr_ucl, F.lit(False))
    return charted.withColumns(
        {
            "ucl": ucl,
            "lcl": lcl,
            "mr_ucl": mr_ucl,
            "out_of_control": F.coalesce(out, F.lit(False)),
            "rule_version": F.lit(rule_version),
        }
    )


def spc_run_rules(points: DataFrame, keys: Sequence[str], run: int = 8) -> DataFrame:
    """Run rules on chart points: beyond the limits, and ``run`` points in a row on one side of the centre."""
    value, centre = F.col("value_numeric"), F.col("centre")
    side = F.when(value > centre, 1).when(value < centre, -1).otherwise(0)

    def streak(window):
        return {"__side_sum": F.sum("__side").over(window.rowsBetween(1 - run, 0))}

    judged = over_blocks(points.withColumn("__side", side), keys, "position", run - 1, streak)
    return judged.withColumns(
        {
            "rule_beyond_limits": (value > F.col("ucl")) | (value < F.col("lcl")),
            "rule_one_side": F.abs("__side_sum") == run,
        }
    ).drop("__side", "__side_sum")
