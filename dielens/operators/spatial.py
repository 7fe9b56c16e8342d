"""Wafer maps and spatial summaries of probed dice.

Every map and summary shows eligible wafers only (:func:`spatial_eligibility`):
``eligible`` is that table, or is derived from the units themselves.  Every
result names the attempts it is based on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dielens.functions.columns import measured, share
from dielens.functions.shuffles import join_null_safe, join_sized, settled
from dielens.operators.units import by_basis

WAFER = ["lot_id", "wafer_id"]


def spatial_eligibility(units: DataFrame) -> DataFrame:
    """Wafers that may be shown on a map; a wafer with any untrusted identity or position is refused."""
    counts = units.groupBy(*WAFER).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(F.col("x_coord").isNull() | F.col("y_coord").isNull()).alias("n_without_position"),
    )
    reason = (
        F.when(F.col("lot_id").isNull(), "NO_LOT")
        .when(F.col("wafer_id").isNull(), "NO_WAFER")
        .when(F.col("n_without_position") > 0, "NO_POSITION")
    )
    return counts.withColumns({"eligible": reason.isNull(), "reason": reason})


def normalize_coordinates(units: DataFrame, runs: DataFrame) -> DataFrame:
    """Coordinates in one frame: x to the right, y up, notch down.

    ``runs``: run_id, origin_position, x_direction, y_direction,
    rotation_degree, notch_orientation.  A corner origin implies the directions
    that are not stated; the notch gives the rotation where none is stated.
    An unknown word or a rotation that is no quarter turn gives no position.
    """
    frame = ["origin_position", "x_direction", "y_direction", "rotation_degree", "notch_orientation"]
    joined = join_sized(units, runs.select("run_id", *frame), ["run_id"], "left", null_safe=False)
    origin, notch = F.upper("origin_position"), F.upper("notch_orientation")
    x_to = F.coalesce(F.upper("x_direction"), F.when(origin.endswith("RIGHT"), "LEFT").otherwise("RIGHT"))
    y_to = F.coalesce(F.upper("y_direction"), F.when(origin.startswith("UPPER"), "DOWN").otherwise("UP"))
    x = F.col("x_coord") * F.when(x_to == "RIGHT", 1).when(x_to == "LEFT", -1)
    y = F.col("y_coord") * F.when(y_to == "UP", 1).when(y_to == "DOWN", -1)
    by_notch = (
        F.when(notch.isNull() | (notch == "DOWN"), 0)
        .when(notch == "LEFT", 90)
        .when(notch == "UP", 180)
        .when(notch == "RIGHT", 270)
    )
    turn = F.coalesce(F.pmod(-F.col("rotation_degree"), F.lit(360)), by_notch)
    turned_x = F.when(turn == 0, x).when(turn == 90, -y).when(turn == 180, -x).when(turn == 270, y)
    turned_y = F.when(turn == 0, y).when(turn == 90, x).when(turn == 180, -y).when(turn == 270, -x)
    return joined.withColumns({"x_norm": turned_x, "y_norm": turned_y}).drop(*frame)


def _gated(units: DataFrame, eligible: DataFrame | None) -> DataFrame:
    """The units of wafers whose identity and positions can be trusted."""
    allowed = (spatial_eligibility(units) if eligible is None else eligible).where("eligible").select(*WAFER)
    return join_sized(units, allowed, WAFER, "left_semi", null_safe=False)


def _of_wafer(df: DataFrame, lot: str | None, wafer: str | None) -> DataFrame:
    if lot is not None:
        df = df.where(F.col("lot_id") == lot)
    return df if wafer is None else df.where(F.col("wafer_id") == wafer)


def wafer_map_bin(
    units: DataFrame, lot: str | None = None, wafer: str | None = None, basis: str = "final", eligible: DataFrame | None = None
) -> DataFrame:
    """Position, raw bin and result of every die of one wafer, or of all eligible ones."""
    chosen = by_basis(_gated(_of_wafer(units, lot, wafer), eligible), basis)
    return chosen.select(*WAFER, "x_coord", "y_coord", "soft_bin", "outcome", F.lit(basis).alias("basis"))


def wafer_map_parameter(
    units: DataFrame, meas: DataFrame, parameter: str, lot: str | None = None, wafer: str | None = None, basis: str = "final",
    eligible: DataFrame | None = None,
) -> DataFrame:
    """Position, value and status of one parameter for the chosen attempt of every die."""
    chosen = by_basis(_gated(_of_wafer(units, lot, wafer), eligible), basis)
    chosen = chosen.select("unit_id", *WAFER, "x_coord", "y_coord", F.lit(basis).alias("basis"))
    values = _of_wafer(meas, lot, wafer).where(F.col("parameter_code") == parameter)
    return chosen.join(values.select("unit_id", "value_numeric", "measurement_status"), "unit_id", "left")


def stacked_fail_map(
    units: DataFrame, keys: Sequence[str] = ("product_code",), basis: str = "final", eligible: DataFrame | None = None
) -> DataFrame:
    """Fails and fail rate per die position over the eligible wafers of a group."""
    failed = F.count_if(F.col("outcome") == "FAIL")
    return by_basis(_gated(units, eligible), basis).groupBy(*keys, "x_coord", "y_coord").agg(
        F.count(F.lit(1)).alias("n_units"),
        failed.alias("n_fail"),
        share(failed, F.count(F.lit(1))).alias("fail_rate"),
        F.lit(basis).alias("basis"),
    )


def parameter_fail_overlay(
    units: DataFrame, meas: DataFrame, parameter: str, bins: Sequence[str], basis: str = "final", eligible: DataFrame | None = None
) -> DataFrame:
    """The parameter map with a mark on the dice that fell into one of the given fail bins."""
    marked = _gated(units, eligible).withColumn("fail_mark", F.coalesce(F.col("soft_bin").isin(list(bins)), F.lit(False)))
    marks = by_basis(marked, basis).select("unit_id", *WAFER, "x_coord", "y_coord", "soft_bin", "fail_mark", F.lit(basis).alias("basis"))
    values = meas.where(F.col("parameter_code") == parameter)
    return marks.join(values.select("unit_id", "value_numeric", "measurement_status"), "unit_id", "left")


def zones(rule: dict) -> Column:
    """Ring and quadrant of a die as an array of (zone_kind, zone); the edges come from the rule version.

    A die without a position is in no ring or quadrant but in NO_POSITION.
    """
    dx = (F.col("x_coord") - rule["center_x"]) / rule["radius_x"]
    dy = (F.col("y_coord") - rule["center_y"]) / rule["radius_y"]
    distance = dx * dx + dy * dy
    inner, outer = rule["center_share"] ** 2, rule["edge_share"] ** 2
    placed = F.col("x_coord").isNotNull() & F.col("y_coord").isNotNull()
    ring = F.when(~placed, "NO_POSITION").when(distance <= inner, "CENTER").when(distance <= outer, "MIDDLE").otherwise("EDGE")
    quadrant = F.when(~placed, "NO_POSITION").otherwise(F.concat(F.when(dy >= 0, "UPPER_").otherwise("LOWER_"), F.when(dx >= 0, "RIGHT").otherwise("LEFT")))
    return F.array(
        F.struct(F.lit("RING").alias("zone_kind"), ring.alias("zone")),
        F.struct(F.lit("QUADRANT").alias("zone_kind"), quadrant.alias("zone")),
    )


def zone_summary(
    units: DataFrame,
    meas: DataFrame,
    rule: dict,
    params: Sequence[str],
    keys: Sequence[str] = ("product_code",),
    basis: str = "final",
    eligible: DataFrame | None = None,
) -> DataFrame:
    """Yield and parameter means per ring and quadrant, both over the same attempts of eligible wafers.

    The chosen attempts are settled; their measurements take the zone from
    them, and both sides are aggregated to zones before they are joined.
    """
    group = [*keys, "zone_kind", "zone"]
    chosen = by_basis(_gated(units, eligible), basis).select("unit_id", *keys, "x_coord", "y_coord", "outcome")
    chosen = settled(chosen, "zones")
    dice = chosen.select(*keys, "outcome", F.inline(zones(rule)))
    passed = F.count_if(F.col("outcome") == "PASS")
    yields = dice.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_units"), passed.alias("n_pass"), share(passed, F.count(F.lit(1))).alias("yield")
    )
    listed = meas.where(measured() & F.col("parameter_code").isin(list(params)))
    of_units = listed.select("unit_id", "parameter_code", "value_numeric").join(chosen, "unit_id")
    placed = of_units.select(*keys, "parameter_code", "value_numeric", F.inline(zones(rule)))
    means = placed.groupBy(*group).agg(
        *[F.avg(F.when(F.col("parameter_code") == p, F.col("value_numeric"))).alias(f"mean_{p.lower()}") for p in params]
    )
    return join_null_safe(yields, means, group, "left").withColumn("basis", F.lit(basis))


def neighbour_fail_count(units: DataFrame, basis: str = "final", eligible: DataFrame | None = None) -> DataFrame:
    """Failing dice among the eight around each die.

    Failing dice send one to each neighbouring position; positions are then
    matched by equality, so no die is compared with another.  A die without a
    position has no count.
    """
    dice = by_basis(_gated(units, eligible), basis).select(
        *WAFER, "x_coord", "y_coord", "unit_id", "outcome", F.lit(basis).alias("basis")
    )
    steps = F.array(
        *[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    )
    sent = (
        dice.where("outcome = 'FAIL'")
        .select(*WAFER, "x_coord", "y_coord", F.inline(steps))
        .groupBy(*WAFER, (F.col("x_coord") + F.col("dx")).alias("x_coord"), (F.col("y_coord") + F.col("dy")).alias("y_coord"))
        .agg(F.count(F.lit(1)).alias("n_fail_neighbours"))
    )
    placed = F.col("x_coord").isNotNull() & F.col("y_coord").isNotNull()
    counted = dice.join(sent, [*WAFER, "x_coord", "y_coord"], "left")
    return counted.withColumn("n_fail_neighbours", F.when(placed, F.coalesce("n_fail_neighbours", F.lit(0))))
